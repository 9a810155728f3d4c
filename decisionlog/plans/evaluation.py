"""Queries on logged calls, ticks, commands and poses (events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlog.functions.jsontext import strict_json
from decisionlog.operators import commands as C
from decisionlog.operators import evaluate as E
from decisionlog.operators import poses as P
from decisionlog.operators import profile as R
from decisionlog.operators import reannotate as A
from decisionlog.operators.perturb import corrupt_commands
from decisionlog.operators.toolcalls import call_violations, read_call
from decisionlog.operators.triage import parse_questions, triage_generations
from decisionlog.plans import views as V
from decisionlog.plans.registry import query, sql_draw, sql_pick, sql_uniform, unfold

_RATE = "CASE WHEN SUM({b}) > 0 THEN CAST(SUM({a}) AS DOUBLE) / SUM({b}) ELSE 0.0 END"


def _rate(a: str, b: str) -> str:
    return _RATE.format(a=a, b=b)


def _report_sql(keys: str, motions: str = "motion_n") -> str:
    lead = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}COUNT(*) AS n, round({_rate('json_valid', '1')}, 6) AS json_valid_rate, round({_rate('schema_valid', '1')}, 6) AS schema_valid_rate,
    round({_rate('tool_correct', '1')}, 6) AS tool_accuracy, round({_rate('motion_obj_correct', motions)}, 6) AS motion_obj_accuracy,
    round({_rate('motion_tool_correct', motions)}, 6) AS motion_tool_accuracy, round({_rate('interact_kind_correct', 'interact_n')}, 6) AS interact_kind_accuracy,
    round({_rate('interact_choices_valid', 'interact_n')}, 6) AS interact_choices_valid_rate, round({_rate('strict_exact', '1')}, 6) AS strict_exact_rate,
    CAST(SUM(json_errors) AS BIGINT) AS json_errors, CAST(SUM(schema_errors) AS BIGINT) AS schema_errors,
    CAST(SUM({motions}) AS BIGINT) AS motion_n, CAST(SUM(interact_n) AS BIGINT) AS interact_n, CAST(0 AS BIGINT) AS missing FROM scored{group}"""


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def scored(t):
    return E.score(V.logged_calls(V.Spread(t.spark, t.directory)))


def counted(t, *dims):
    return E.score_counted(V.logged_calls(t), dims)


@query(_report_sql("mode"), "scored")
def accuracy_report(t):
    return _rounded(E.accuracy_report(counted(t, "mode"), ["mode"]))


@query(_report_sql("", "motion_both_n"), "scored")
def accuracy_report_online(t):
    return _rounded(E.accuracy_report(counted(t), motion_denominator="both"))


@query(
    """SELECT mode, COUNT(*) AS n, CAST(SUM(CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing,
    CAST(SUM(CASE WHEN k % 11 = 0 THEN 0 ELSE tool_correct END) AS BIGINT) AS tool_correct FROM scored GROUP BY mode""",
    "scored",
)
def joined_predictions(t):
    calls = V.logged_calls(t)
    answers = calls.select("id", F.when(F.col("k") % 11 != 0, F.col("raw")).alias("raw"))
    joined = E.join_predictions(calls.drop("raw"), answers)
    return E.count_scores(E.score(joined), ["mode"]).select("mode", "n", "missing", "tool_correct")


CONFUSION_LABELS = """list_filter([CASE WHEN json_errors = 1 THEN 'INVALID_JSON' END, CASE WHEN schema_errors = 1 THEN 'INVALID_SCHEMA' END,
    CASE WHEN ok THEN pred_tool END], lambda x: x IS NOT NULL)"""
_CONFUSION = f"SELECT gt_tool, unnest({CONFUSION_LABELS}) AS pred_tool FROM scored WHERE gt_ok"


@query(f"SELECT gt_tool, pred_tool, COUNT(*) AS n FROM ({_CONFUSION}) GROUP BY gt_tool, pred_tool", "scored")
def tool_confusion(t):
    return E.tool_confusion(counted(t))


@query(
    f"""SELECT gt_tool, pred_tool, round(CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY gt_tool), 6) AS share FROM (
    SELECT gt_tool, pred_tool, COUNT(*) AS n FROM ({_CONFUSION}) WHERE pred_tool NOT IN ('INVALID_JSON', 'INVALID_SCHEMA', 'DANCE') GROUP BY gt_tool, pred_tool)""",
    "scored",
)
def confusion_normalised(t):
    return _rounded(E.normalise_confusion(E.tool_confusion(counted(t))))


_COUNTERS = ("json_valid", "schema_valid", "tool_correct", "tool_wrong", "motion_n", "motion_obj_correct", "interact_n", "strict_exact")
_SUMS = ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in _COUNTERS)


@query(
    f"""SELECT 'context' AS dim, context AS key, COUNT(*) AS n, {_SUMS} FROM scored GROUP BY context
    UNION ALL SELECT 'mode', mode, COUNT(*), {_SUMS} FROM scored GROUP BY mode
    UNION ALL SELECT 'cands', CASE WHEN n_cands <= 5 THEN 'cands_' || n_cands ELSE 'cands_6+' END AS b, COUNT(*), {_SUMS} FROM scored GROUP BY b""",
    "scored",
)
def breakdown_sets(t):
    return E.breakdowns(counted(t, "context", "mode", "n_cands")).select("dim", "key", "n", *_COUNTERS)


@query(
    """SELECT context, n, round(correct, 6) AS correct, round(greatest(0.0, 1.0 - correct - js - ss), 6) AS wrong_tool, round(ss, 6) AS schema_invalid,
    round(js, 6) AS json_invalid, tc AS correct_n, greatest(0, n - tc - je - se) AS wrong_tool_n, se AS schema_invalid_n, je AS json_invalid_n FROM (
    SELECT context, COUNT(*) AS n, CAST(SUM(tool_correct) AS BIGINT) AS tc, CAST(SUM(json_errors) AS BIGINT) AS je, CAST(SUM(schema_errors) AS BIGINT) AS se,
    CAST(SUM(tool_correct) AS DOUBLE) / COUNT(*) AS correct, CAST(SUM(json_errors) AS DOUBLE) / COUNT(*) AS js, CAST(SUM(schema_errors) AS DOUBLE) / COUNT(*) AS ss
    FROM scored GROUP BY context)""",
    "scored",
)
def error_decomposition(t):
    return _rounded(E.error_decomposition(E.accuracy_report(counted(t, "context"), ["context"]), ["context"]))


@query("SELECT context, round(CAST(SUM(tool_correct) AS DOUBLE) / COUNT(*), 6) AS accuracy, COUNT(*) AS n FROM scored GROUP BY context", "scored")
def context_heat(t):
    from decisionlog.functions.text import ratio

    b = E.breakdowns(counted(t, "context"), ("context",))
    return b.select(F.col("key").alias("context"), F.round(ratio(F.col("tool_correct"), F.col("n")), 6).alias("accuracy"), "n")


@query(
    """SELECT event_id AS id, CASE WHEN json_errors = 1 THEN 'json_parse' ELSE 'tool_mismatch' END AS error_type FROM scored
    WHERE json_errors = 1 OR tool_wrong = 1 ORDER BY event_id LIMIT 200""",
    "scored",
)
def mistakes_capped(t):
    return E.cap_mistakes(scored(t), 200, "event_id").select("id", "error_type")


@query(
    """SELECT mode, gt_tool, COUNT(*) AS entries FROM (SELECT DISTINCT mode, gt_tool, p FROM (
    SELECT mode, gt_tool, unnest(list_filter([CASE WHEN json_errors = 1 THEN 'INVALID_JSON' END, CASE WHEN schema_errors = 1 THEN 'INVALID_SCHEMA' END,
    CASE WHEN ok THEN pred_tool END], lambda x: x IS NOT NULL)) AS p FROM scored WHERE gt_ok)) GROUP BY mode, gt_tool""",
    "scored",
)
def result_cells(t):
    cells = E.result_cells(scored(t), ["mode"])
    return cells.select("mode", F.explode("tool_confusion").alias("gt_tool", "_row")).select("mode", "gt_tool", F.size("_row").cast("bigint").alias("entries"))


@query(
    """SELECT CASE r WHEN 0 THEN 'json_error' WHEN 5 THEN 'not_an_object' ELSE CASE WHEN r IN (6, 8) AND NOT gt_ok THEN CASE WHEN r = 6 THEN 'json_error' ELSE 'ok' END ELSE 'ok' END END AS class,
    COUNT(*) AS n FROM answered GROUP BY 1""",
    "answered",
)
def generation_triage(t):
    return triage_generations(V.logged_calls(t), "raw").groupBy(F.col("parsed_class").alias("class")).agg(F.count("*").alias("n"))


@query(
    """SELECT variant, CAST(SUM(CASE WHEN json_valid(txt) THEN 1 ELSE 0 END) AS BIGINT) AS valid, COUNT(*) AS n FROM (
    SELECT unnest([{'variant': 'as_is', 'txt': props}, {'variant': 'trailing', 'txt': props || ' x'}, {'variant': 'member', 'txt': props || ',"q":1'},
    {'variant': 'cut', 'txt': substr(props, 1, length(props) - 1)}, {'variant': 'array', 'txt': '[' || props || ']'}], recursive := true) FROM ev) GROUP BY variant""",
    "ev",
)
def strict_json_triage(t):
    p = F.col("props")
    forms = {"as_is": p, "trailing": F.concat(p, F.lit(" x")), "member": F.concat(p, F.lit(',"q":1')), "cut": F.substring(p, F.lit(1), F.length(p) - 1), "array": F.concat(F.lit("["), p, F.lit("]"))}
    rows = t.events.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), x.alias("txt")) for n, x in forms.items()])).alias("_f")).select("_f.*")
    valid = strict_json(F.col("txt")).isNotNull().cast("bigint")
    return rows.groupBy("variant").agg(F.sum(valid).alias("valid"), F.count("*").alias("n"))


@query()
def page_triage(t):
    return triage_generations(t.pages.select("page_id", "html"), "html").groupBy(F.col("parsed_class").alias("class")).agg(F.count("*").alias("n"))


@query(
    """SELECT rule, COUNT(*) AS n FROM (SELECT unnest(CASE
    WHEN r IN (0, 5) THEN ['not_an_object', 'tool', 'args'] WHEN NOT gt_ok AND r = 6 THEN ['not_an_object', 'tool', 'args']
    WHEN r = 1 THEN ['not_an_object', 'tool', 'args'] WHEN r = 2 THEN ['tool'] WHEN r = 3 THEN ['interact_too_many_choices']
    WHEN r = 4 THEN ['tool'] ELSE [] END) AS rule FROM answered) GROUP BY rule""",
    "answered",
)
def toolcall_violations(t):
    calls = read_call(V.logged_calls(t), "raw", "call", normalise=None)
    return unfold(calls.select(call_violations(F.col("call")).alias("v")), "v", "rule").groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """SELECT tool, kind, COUNT(*) AS n FROM (SELECT CASE WHEN NOT (gt_ok AND r NOT IN (0, 1, 5)) AND NOT (NOT gt_ok AND r IN (2, 3, 4, 7, 8, 9)) THEN 'None' ELSE
    CASE WHEN NOT gt_ok AND r = 8 THEN 'APPROACH' ELSE pred_tool END END AS tool,
    CASE WHEN r = 3 THEN 'QUESTION' WHEN r = 4 THEN 'CONFIRM' WHEN r = 6 AND gt_tool = 'INTERACT' THEN 'QUESTION' WHEN r = 8 AND gt_tool = 'INTERACT' THEN 'CONFIRM' END AS kind
    FROM answered) GROUP BY tool, kind""",
    "answered",
)
def normalised_calls(t):
    calls = read_call(V.logged_calls(t), "raw", "call")
    return calls.groupBy(F.col("call.tool").alias("tool"), F.col("call.kind").alias("kind")).agg(F.count("*").alias("n"))


@query(
    """SELECT kind, n_choices, COUNT(*) AS n FROM (SELECT CASE WHEN r = 3 OR r = 6 THEN 'QUESTION' ELSE 'CONFIRM' END AS kind0,
    CASE WHEN r = 4 THEN 'QUESTION' WHEN r IN (3, 6) THEN 'QUESTION' ELSE 'CONFIRM' END AS kind,
    CASE WHEN r = 3 THEN 5 WHEN r IN (4, 6) THEN 2 ELSE 1 END AS n_choices FROM answered
    WHERE r IN (3, 4) OR (r IN (6, 8) AND gt_tool = 'INTERACT')) GROUP BY kind, n_choices""",
    "answered",
)
def parsed_questions(t):
    rows = parse_questions(V.logged_calls(t), "raw").filter(F.col("question").isNotNull())
    return rows.groupBy("question.kind", F.size("question.choices").alias("n_choices")).agg(F.count("*").alias("n"))


# ---- episodes


@query("SELECT CAST(SUM(c) AS BIGINT) AS rows, COUNT(*) AS episodes, MIN(c) AS min_len, MAX(c) AS max_len, round(AVG(c), 6) AS avg_len FROM (SELECT user_id, COUNT(*) AS c FROM events GROUP BY user_id)")
def episode_lengths(t):
    return _rounded(R.episode_lengths(t.events, "user_id"))


_RUNS = """SELECT user_id, {v} AS v, COUNT(*) AS len FROM (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
    SELECT *, CASE WHEN {v} = lag({v}) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS brk FROM ticks)) GROUP BY user_id, {v}, run"""


@query(f"SELECT user_id, MAX(len) AS longest_run FROM ({_RUNS.format(v='tool')}) GROUP BY user_id", "ticks")
def longest_runs(t):
    return R.longest_run(V.ticks(t), "tool", V.USER, V.user_order(t))


@query(
    """SELECT user_id, CAST(SUM(CASE WHEN prompt = before THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_transitions FROM (
    SELECT *, lag(prompt) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM ticks) GROUP BY user_id""",
    "ticks",
)
def duplicate_transitions(t):
    return R.duplicate_transitions(V.ticks(t), "prompt", V.USER, V.user_order(t))


@query(
    "\nUNION ALL\n".join(
        f"""(SELECT '{v}' AS what, user_id AS episode, run FROM (SELECT user_id, MAX(CASE WHEN v IS NULL THEN 1 ELSE len END) AS run FROM ({_RUNS.format(v=v)}) GROUP BY user_id)
        JOIN (SELECT user_id, MIN(event_id) AS first FROM ticks GROUP BY user_id) USING (user_id) ORDER BY run DESC, first LIMIT 1)"""
        for v in ("tool", "prompt")
    ),
    "ticks",
)
def worst_runs(t):
    return R.worst_runs(V.ticks(t), V.user_order(t), {"tool": "tool", "prompt": "prompt"}, "user_id")


@query("SELECT k, COUNT(*) AS n FROM ev GROUP BY k ORDER BY n DESC, MIN(event_id) LIMIT 10", "ev")
def top_symbols(t):
    return R.top_values(V.events(t), "k", 10, ("event_id",))


@query("SELECT user_id, arg_min(event_id, row(ts, event_id)) AS event_id, arg_min(event_type, row(ts, event_id)) AS event_type FROM events GROUP BY user_id")
def first_rows(t):
    return R.first_row(t.events.select("user_id", "event_id", "event_type", "ts"), V.USER, V.event_order()).select("user_id", "event_id", "event_type")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick_idx FROM events")
def renumbered_ticks(t):
    return P.renumber(t.events.select("user_id", "event_id", "ts"), V.USER, V.user_order(t)).select("event_id", "tick_idx")


@query(
    "SELECT event_id, coalesce(array_to_string(list(tool) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS last_calls FROM ticks",
    "ticks",
)
def rolling_calls(t):
    rows = P.last_k(V.ticks(t), "tool", V.USER, V.user_order(t))
    return rows.select("event_id", F.array_join("last_tool_calls", ",").alias("last_calls"))


_ALERT = f"""CASE WHEN tb IS NULL THEN 'episode_start' WHEN tb <> 'INTERACT' THEN 'post_execution'
    WHEN list_sort(list_distinct([c1, c2])) <> list_sort(list_distinct([b1, b2])) THEN 'candidate_change'
    WHEN {sql_uniform(sql_draw("CAST(event_id AS VARCHAR)", 'alert', 0))} < 0.15 THEN 'stochastic' END"""


@query(
    f"""SELECT event_id, {_ALERT} AS alert_reason FROM (SELECT *, lag(tool) OVER w AS tb, lag(c1) OVER w AS b1, lag(c2) OVER w AS b2 FROM ticks
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "ticks",
)
def decision_points(t):
    return P.decision_points(V.ticks(t), V.USER, V.user_order(t), id_col="event_id").select("event_id", "alert_reason")


@query(
    """SELECT event_id, episode_no, record_no FROM (SELECT event_id, e.no AS episode_no, row_number() OVER (ORDER BY e.no, event_id) - 1 - 5 AS record_no
    FROM events JOIN (SELECT user_id, row_number() OVER (ORDER BY MIN(event_id)) - 1 AS no FROM events GROUP BY user_id) e USING (user_id)
    WHERE e.no >= 3 AND e.no < 43) WHERE record_no >= 0 AND record_no < 1500"""
)
def episode_slice(t):
    from decisionlog.operators.ordered import by_number

    rows = A.episode_slice(t.events.select("user_id", "event_id"), by_number("event_id"), episode="user_id", skip_episodes=3, max_episodes=40, skip_records=5, max_records=1500)
    return rows.select("event_id", "episode_no", "record_no")


@query(
    """SELECT alert_reason, tool, COUNT(*) AS n FROM (SELECT CASE WHEN tool <> 'INTERACT' THEN 'auto_motion' WHEN value >= 20 THEN 'replay' ELSE 'unanswered' END AS alert_reason,
    CASE WHEN tool = 'INTERACT' AND value >= 20 THEN 'GRAB' ELSE tool END AS tool FROM ticks) GROUP BY alert_reason, tool""",
    "ticks",
)
def reannotation_merge(t):
    rows = P.renumber(V.ticks(t).select("user_id", "event_id", "ts", "tool", "value"), V.USER, V.user_order(t))
    decisions = rows.select("user_id", "tick_idx", F.struct("tool").alias("target_tool_call"))
    people = rows.filter(F.col("value") >= 20).select("user_id", "tick_idx", F.struct(F.lit("GRAB").alias("tool")).alias("tool_call"))
    merged = A.merge_reannotation(decisions, people, keys=("user_id", "tick_idx"))
    return merged.groupBy("alert_reason", F.col("tool_call.tool").alias("tool")).agg(F.count("*").alias("n"))


# ---- commands

_MAX_BURST = 200_000.0
_ACTIVE = "type IN ('cartesian_velocity', 'gripper')"
_SWITCHES = f"""SELECT user_id, CAST(SUM(CASE WHEN mode <> before THEN 1 ELSE 0 END) AS BIGINT) AS mode_switches FROM (
    SELECT *, lag(mode) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM commands WHERE {_ACTIVE}) GROUP BY user_id"""
_REVERSALS = """SELECT user_id, CAST(SUM(CASE WHEN direction <> before THEN 1 ELSE 0 END) AS BIGINT) AS direction_reversals FROM (
    SELECT *, lag(direction) OVER (PARTITION BY user_id, mode, axis ORDER BY ts, event_id) AS before FROM commands
    WHERE type = 'cartesian_velocity' AND direction <> 0) GROUP BY user_id"""
_BURSTS = f"""SELECT user_id, mode AS burst_mode, axis, since, stamp, stamp - since AS seconds FROM (
    SELECT *, lag(stamp) OVER w AS since, lag(type) OVER w AS opened FROM commands WHERE type IN ('cartesian_velocity', 'stop')
    WINDOW w AS (PARTITION BY user_id, mode, axis ORDER BY ts, event_id)) WHERE type = 'stop' AND opened = 'cartesian_velocity'
    AND stamp - since > 0 AND stamp - since < {_MAX_BURST}"""


@query(_SWITCHES, "commands")
def mode_switches(t):
    return C.mode_switches(V.commands(t), V.USER, V.user_order(t))


@query(_REVERSALS, "commands")
def direction_reversals(t):
    return C.direction_reversals(V.commands(t), V.USER, V.user_order(t))


@query(f"SELECT user_id, burst_mode, axis, round(since, 3) AS start, round(seconds, 3) AS seconds FROM ({_BURSTS})", "commands")
def bursts(t):
    rows = C.bursts(V.commands(t), V.USER, V.user_order(t), _MAX_BURST)
    return rows.select("user_id", "burst_mode", "axis", F.round("start", 3).alias("start"), F.round("seconds", 3).alias("seconds"))


@query(
    f"""SELECT user_id, CAST(SUM(CASE WHEN {_ACTIVE} THEN 1 ELSE 0 END) AS BIGINT) AS total_commands, round(min(stamp) FILTER ({_ACTIVE}), 3) AS first_stamp,
    round(max(stamp) FILTER ({_ACTIVE}), 3) AS last_stamp FROM commands GROUP BY user_id""",
    "commands",
)
def active_span(t):
    return _rounded(C.active_span(V.commands(t), V.USER, V.user_order(t)), 3)


PRIORS_SQL = f"""SELECT user_id, {', '.join(f"round(CASE WHEN tot > 0 THEN coalesce({m}, 0) / tot ELSE 0.0 END, 4) AS {m}_share" for m in ('translation', 'rotation', 'gripper'))},
    round(CASE WHEN nb > 0 THEN tot / nb ELSE 0.0 END, 4) AS mean_active_burst_sec,
    round(CASE WHEN win > 0 THEN coalesce(mode_switches, 0) / win ELSE 0.0 END, 4) AS mode_switches_per_sec,
    round(CASE WHEN win > 0 THEN coalesce(direction_reversals, 0) / win ELSE 0.0 END, 4) AS direction_reversals_per_sec,
    round(coalesce(tot, 0.0), 3) AS total_active_time_sec, total_commands FROM (
    SELECT user_id, CAST(SUM(CASE WHEN {_ACTIVE} THEN 1 ELSE 0 END) AS BIGINT) AS total_commands,
    max(stamp) FILTER ({_ACTIVE}) - min(stamp) FILTER ({_ACTIVE}) AS win FROM commands GROUP BY user_id)
    LEFT JOIN ({_SWITCHES}) USING (user_id) LEFT JOIN ({_REVERSALS}) USING (user_id)
    LEFT JOIN (SELECT user_id, SUM(seconds) AS tot, COUNT(*) AS nb, SUM(seconds) FILTER (burst_mode = 'translation') AS translation,
    SUM(seconds) FILTER (burst_mode = 'rotation') AS rotation, SUM(seconds) FILTER (burst_mode = 'gripper') AS gripper FROM ({_BURSTS}) GROUP BY user_id) USING (user_id)"""


@query(PRIORS_SQL, "commands")
def user_priors(t):
    return C.user_priors(V.commands(t), V.USER, V.user_order(t), _MAX_BURST)


def _tok(salt: str) -> str:
    return sql_draw("CAST(event_id AS VARCHAR)", salt, 11)


@query(
    f"""SELECT event_id, CASE WHEN bent AND sw THEN CASE axis WHEN 'x' THEN 'y' ELSE CASE {sql_pick('how', 2)} WHEN 0 THEN 'y' ELSE 'x' END END ELSE axis END AS axis,
    CASE WHEN bent AND NOT sw THEN -direction ELSE direction END AS direction, bent AS direction_perturbed, dropped, round(lat, 6) AS latency_sec,
    CASE WHEN sel THEN (ri + 1 + {sql_pick('ch', 3)}) % 4 ELSE ri END AS reply_idx FROM (
    SELECT event_id, axis, direction, k % 4 AS ri, {_tok('bend-how')} AS how, {_tok('choose')} AS ch,
    mode <> 'gripper' AND {sql_uniform(_tok('bend'))} < 0.3 AS bent, {sql_uniform(_tok('bend-how'))} < 0.5 AS sw,
    {sql_uniform(_tok('drop'))} < 0.1 AS dropped, 0.1 + {sql_uniform(_tok('latency'))} * 0.4 AS lat, {sql_uniform(_tok('choose'))} < 0.25 AS sel FROM commands)""",
    "commands",
)
def corrupted_commands(t):
    out = corrupt_commands(V.commands(t), (0.3, 0.25, 0.1, True), 11)
    return _rounded(out.select("event_id", "axis", "direction", "direction_perturbed", "dropped", "latency_sec", "reply_idx"))


# ---- poses

_HIST = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
_CHANGES = "list_sum([CASE WHEN {a}[i] <> {a}[i - 1]{more} THEN 1 ELSE 0 END for i in range(2, len({a}) + 1)])"


@query(
    f"""SELECT event_id, full6 AND nmax >= 4 AND len(list_distinct(ys)) = 2 AND {_CHANGES.format(a='ys', more='')} >= 3 AS yaw_osc,
    full6 AND n1 >= 2 AND n2 >= 2 AND {_CHANGES.format(a='cs', more='')} >= 2 AS cell_osc,
    CASE WHEN len(cs) < 2 THEN 'translation' WHEN cs[-1] <> cs[-2] THEN 'translation' WHEN ys[-1] <> ys[-2] THEN 'rotation' WHEN zs[-1] <> zs[-2] THEN 'gripper' ELSE 'translation' END AS input_mode
    FROM (SELECT *, len(cs) = 6 AS full6, greatest(n1, n2) AS nmax FROM (SELECT event_id, list(cell) OVER w AS cs, list(yaw) OVER w AS ys, list(z) OVER w AS zs,
    COUNT(*) FILTER (cell = 'A1') OVER w AS n1, COUNT(*) FILTER (cell = 'A2') OVER w AS n2 FROM poses WINDOW w AS {_HIST}))""",
    "poses",
)
def oscillation_flags(t):
    rows = P.pose_history(V.poses(t), V.USER, V.user_order(t))
    h = F.col("gripper_hist")
    return rows.select(
        "event_id",
        P.yaw_oscillation(h)["triggered"].alias("yaw_osc"),
        P.cell_oscillation(h, F.lit("A1"), F.lit("A2")).alias("cell_osc"),
        P.infer_mode(h).alias("input_mode"),
    )
