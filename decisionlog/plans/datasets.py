"""Queries on examples, dialogues, ratings, rollouts and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlog.operators import agreement as K
from decisionlog.operators import contracts as C
from decisionlog.operators import profile as R
from decisionlog.operators import reports as S
from decisionlog.operators import sampling as G
from decisionlog.operators.ordered import trailing
from decisionlog.plans import views as V
from decisionlog.plans.registry import checksum, query, sql_checksum, sql_draw, sql_uniform
from decisionlog.schemas import ENV_SKILLS


def _count():
    return F.count("*").alias("n")


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---- examples


@query("SELECT split, source, tool, COUNT(*) AS n FROM examples GROUP BY split, source, tool", "examples")
def tool_distribution(t):
    return R.distribution(V.examples(t), "tool", ["split", "source"])


@query("SELECT coalesce(context, 'none') AS context, tool, COUNT(*) AS n FROM examples GROUP BY 1, 2", "examples")
def context_crosstab(t):
    return R.crosstab(V.examples(t), "context", "tool")


_DIMS = ("env", "tool", "mode", "context")


@query("\nUNION ALL ".join(f"SELECT split, '{d}' AS dim, {d} AS value, COUNT(*) AS n FROM examples WHERE {d} IS NOT NULL GROUP BY split, {d}" for d in _DIMS), "examples")
def value_distributions(t):
    return R.distributions(V.examples(t), _DIMS, ["split"])


@query(
    "\nUNION ALL ".join(
        f"""SELECT '{d}' AS dim, round(max(abs(a - b)), 6) AS max_abs_prop_delta FROM (SELECT round(COUNT(*) FILTER (split = 'train') / SUM(COUNT(*) FILTER (split = 'train')) OVER (), 6) AS a,
        round(COUNT(*) FILTER (split = 'valid') / SUM(COUNT(*) FILTER (split = 'valid')) OVER (), 6) AS b FROM examples WHERE {d} IS NOT NULL GROUP BY {d})"""
        for d in _DIMS
    ),
    "examples",
)
def distribution_similarity(t):
    x = V.examples(t)
    return R.similarity(x.filter("split = 'train'"), x.filter("split = 'valid'"), _DIMS)


@query(
    "SELECT split, 'rows' AS dim, 'all' AS value, COUNT(*) AS n FROM examples GROUP BY split UNION ALL "
    + " UNION ALL ".join(f"SELECT split, '{d}', {d}, COUNT(*) FROM examples GROUP BY split, {d}" for d in ("tool", "env", "mode")),
    "examples",
)
def split_summary(t):
    return R.dataset_summary(V.examples(t))


_KEEP = sql_uniform(sql_draw("id", "rebalance", 7)) + " < 0.4"
_ACTS = "tool IN ('APPROACH', 'ALIGN_YAW', 'STACK', 'GRAB', 'POUR', 'RELEASE')"


@query(
    f"""SELECT tool, COUNT(*) AS n, {sql_checksum('id')} FROM (SELECT tool, CASE WHEN rep IS NULL THEN id ELSE id || '_m' || rep END AS id FROM (
    SELECT tool, id, unnest(CASE WHEN {_ACTS} THEN [0, 1, 2] WHEN tool = 'INTERACT' AND {_KEEP} THEN [NULL] ELSE [] END) AS rep FROM examples)) GROUP BY tool""",
    "examples",
)
def rebalance(t):
    return G.rebalance(V.examples(t).select("id", "tool"), 3, 0.4, 7).groupBy("tool").agg(_count(), checksum("id"))


@query(
    f"""SELECT ki AS kept_interact, km AS kept_motion, di AS dropped_interact, u AS unknown, ki + 3 * km AS written FROM (
    SELECT COUNT(*) FILTER (tool = 'INTERACT' AND {_KEEP}) AS ki, COUNT(*) FILTER ({_ACTS}) AS km, COUNT(*) FILTER (tool = 'INTERACT' AND NOT {_KEEP}) AS di,
    COUNT(*) FILTER (tool <> 'INTERACT' AND NOT ({_ACTS})) AS u FROM examples)""",
    "examples",
)
def rebalance_stats(t):
    return G.rebalance_stats(V.examples(t).select("id", "tool"), 3, 0.4, 7)


def _ranked(strata: str, salt: str, seed: int) -> str:
    over = f"PARTITION BY {strata} " if strata else ""
    whole = f"PARTITION BY {strata}" if strata else ""
    return f"SELECT *, row_number() OVER ({over}ORDER BY {sql_draw('id', salt, seed)}, id) AS rk, COUNT(*) OVER ({whole}) AS total FROM examples"


_VALID = "least(greatest(1, CAST(round_even(total * {f}, 0) AS BIGINT)), total - 1)"


@query(
    f"SELECT source, CASE WHEN rk <= {_VALID.format(f=0.1)} THEN 'valid' ELSE 'train' END AS part, COUNT(*) AS n, {sql_checksum('id')} FROM ({_ranked('source', 'split', 4)}) GROUP BY 1, 2",
    "examples",
)
def stratified_split(t):
    out = G.split_by_source(V.examples(t).select("id", "source"), 0.1, 4, name="part")
    return out.groupBy("source", "part").agg(_count(), checksum("id"))


@query(
    f"SELECT CASE WHEN rk <= {_VALID.format(f=0.05)} THEN 'valid' ELSE 'train' END AS part, COUNT(*) AS n, {sql_checksum('id')} FROM ({_ranked('', 'split', 0)}) GROUP BY 1",
    "examples",
)
def auto_split(t):
    return G.auto_split(V.examples(t).select("id"), name="part").groupBy("part").agg(_count(), checksum("id"))


_QUOTAS = ", ".join(
    f"('{e}', '{tool}', {n}, {G.TARGETS['valid'][e].get(tool, 0)})" for e, tools in G.TARGETS["train"].items() for tool, n in tools.items()
)


@query(
    f"""SELECT part, env, tool, COUNT(*) AS n, {sql_checksum('id')} FROM (SELECT r.*, CASE WHEN rk <= tr THEN 'train' WHEN rk <= tr + va THEN 'valid' END AS part
    FROM ({_ranked('env, tool', 'quota', 7)}) r JOIN (VALUES {_QUOTAS}) q(env, tool, tr, va) USING (env, tool)) WHERE part IS NOT NULL GROUP BY part, env, tool""",
    "examples",
)
def quota_split(t):
    rows = V.examples(t).select("id", "env", "tool")
    return G.quota_split(rows, G.quotas(t.spark), 7, name="part").groupBy("part", "env", "tool").agg(_count(), checksum("id"))


@query(f"SELECT COUNT(*) AS n, {sql_checksum('id')} FROM ({_ranked('', 'sample', 3)}) WHERE rk <= 2500", "examples")
def uniform_sample(t):
    return G.uniform_sample(V.examples(t).select("id"), 2500, 3).agg(_count(), checksum("id"))


@query("SELECT COUNT(*) AS n, MIN(event_id) AS lo, MAX(event_id) AS hi FROM events WHERE event_id <= 400")
def head_sample(t):
    return G.head_sample(t.events.select("event_id"), 400, "event_id").agg(_count(), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query(
    f"""SELECT CASE split WHEN 'train' THEN 'base' ELSE 'people' END AS mixture_source, tool, CAST(SUM(CASE WHEN split = 'valid' AND {_ACTS} THEN 3 ELSE 1 END) AS BIGINT) AS n
    FROM examples WHERE tool <> 'WAIT' GROUP BY 1, 2""",
    "examples",
)
def mixture_counts(t):
    x = V.examples(t).select("id", "tool", "split")
    out = G.mix({"base": (x.filter("split = 'train'"), 1, 1.0), "people": (x.filter("split = 'valid'"), 3, 1.0)}, 23)
    return out.groupBy("mixture_source", "tool").agg(_count())


@query("SELECT env, split, COUNT(*) AS n FROM examples WHERE mode = 'translation' AND tool <> 'WAIT' GROUP BY env, split", "examples")
def trainable_by_env(t):
    x = V.examples(t)
    named = x.withColumn("id", F.concat(F.lit("woz_"), "env", F.lit("_"), "id")).drop("env")
    return C.filter_trainable(G.split_by_env(named)).groupBy("env", "split").agg(_count())


_SKILLS = " OR ".join("(env = '{}' AND tool IN ({}))".format(e, ", ".join(f"'{s}'" for s in skills)) for e, skills in ENV_SKILLS.items())


@query(
    f"""SELECT env, tool, COUNT(*) AS n, COUNT(*) FILTER (NOT ({_SKILLS})) AS not_allowed FROM examples GROUP BY env, tool""",
    "examples",
)
def env_skill_check(t):
    from decisionlog.operators.toolcalls import call_violations, read_call

    x = V.examples(t)
    question = F.lit('{"tool":"INTERACT","args":{"kind":"CONFIRM","text":"","choices":["1) YES"]}}')
    pour = F.lit('{"tool":"POUR","args":{"obj":"o1","amount":"HALF"}}')
    plain = F.concat(F.lit('{"tool":"'), F.col("tool"), F.lit('","args":{"obj":"o1"}}'))
    x = x.withColumn("text", F.when(F.col("tool") == "INTERACT", question).when(F.col("tool") == "POUR", pour).otherwise(plain))
    bad = F.size(call_violations(F.col("call"), F.col("env"))) > 0
    calls = read_call(x.select("env", "tool", "text"), "text", "call", normalise=None)
    return calls.groupBy("env", "tool").agg(_count(), F.sum(bad.cast("bigint")).alias("not_allowed"))


_ROUGH = "CASE WHEN length(html) % 3 = 0 THEN '{\"page\":' || page_id || '}' WHEN length(html) % 3 = 1 THEN '{\"page\":' ELSE NULL END"


@query(f"SELECT violation, COUNT(*) AS n FROM (SELECT CASE WHEN o IS NULL THEN 'missing output' WHEN NOT json_valid(o) THEN 'output is not JSON' ELSE 'ok' END AS violation FROM (SELECT {_ROUGH} AS o FROM pages)) GROUP BY violation")
def contract_validate(t):
    n = F.length("html") % 3
    output = F.when(n == 0, F.concat(F.lit('{"page":'), F.col("page_id").cast("string"), F.lit("}"))).when(n == 1, F.lit('{"page":'))
    rows = t.pages.select(F.col("page_id").cast("string").alias("id"), F.lit("i").alias("instruction"), F.col("url").alias("input"), output.alias("output"))
    ok, bad = C.validate_contract(rows)
    found = bad.select(F.explode("violations").alias("violation")).unionByName(ok.select(F.lit("ok").alias("violation")))
    return found.groupBy("violation").agg(_count())


# ---- dialogues


@query(
    """SELECT conv_id, turn, len(w) AS kept, array_to_string(w, '>') AS roles FROM (SELECT conv_id, turn,
    list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w FROM conversations)"""
)
def dialog_truncate(t):
    rows = trailing(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], V.turn_order(), "role", 12, "_all", include_current=True)
    kept = C.truncate_dialogs(F.col("_all"), 3)
    return rows.select("conv_id", "turn", F.size(kept).cast("bigint").alias("kept"), F.array_join(kept, ">").alias("roles"))


@query(
    """SELECT conv_id || '-' || turn AS id, CAST(3 AS BIGINT) AS messages, md5(role || chr(10) || chr(10) || 'Input:' || chr(10) || text) AS user_digest, length(text) AS answer_length FROM conversations"""
)
def dialog_chat(t):
    c = t.conversations
    contract = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("instruction"), F.col("text").alias("input"), F.col("text").alias("output"))
    m = F.col("messages")
    return C.to_chat(contract, "system").select("id", F.size(m).cast("bigint").alias("messages"), F.md5(m[1]["content"]).alias("user_digest"), F.length(m[2]["content"]).cast("bigint").alias("answer_length"))


@query(
    """SELECT conv_id, CAST(SUM(CASE WHEN r0 = 'user' AND r1 <> 'user' AND r2 = 'user' AND r3 <> 'user' AND r1 = 'assistant' AND r3 = 'assistant' AND trim(c1) = trim(c3)
    AND ((upper(trim(c0)) = 'YES' AND upper(trim(c2)) = 'NO') OR (upper(trim(c0)) = 'NO' AND upper(trim(c2)) = 'YES')) THEN 1 ELSE 0 END) AS BIGINT) AS flip_flops FROM (
    SELECT conv_id, role AS r0, content AS c0, lag(role, 1) OVER w AS r1, lag(content, 1) OVER w AS c1, lag(role, 2) OVER w AS r2, lag(content, 2) OVER w AS c2,
    lag(role, 3) OVER w AS r3, lag(content, 3) OVER w AS c3 FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id""",
    "turns",
)
def dialog_flipflops(t):
    return R.flip_flops(V.turns(t), "conv_id", V.turn_order())


_SAID = "CAST(SUM(CASE WHEN {} THEN 1 ELSE 0 END) AS BIGINT) AS {}"


@query(
    "SELECT context, COUNT(*) AS replies, "
    + ", ".join(_SAID.format(f"upper(trim(content)) = '{w}'", n) for n, w in (("yes", "YES"), ("no", "NO"), ("none_of_them", "NONE OF THEM"), ("mode_approach", "APPROACH"), ("mode_align_yaw", "ALIGN_YAW")))
    + " FROM turns WHERE role = 'user' GROUP BY context",
    "turns",
)
def reply_distribution(t):
    return R.reply_distribution(V.turns(t))


@query(
    "SELECT context, " + ", ".join(_SAID.format(f"contains(upper(content), '{w}')", n) for n, w in (("yes", "YES"), ("no", "NO"), ("none_of_them", "NONE"), ("ok", "OK"))) + " FROM turns WHERE role = 'user' GROUP BY context",
    "turns",
)
def reply_keywords(t):
    return R.reply_keywords(V.turns(t).filter("role = 'user'"), "content", ["context"])


@query(
    """SELECT conv_id, CAST(SUM(CASE WHEN p = '' THEN 0 ELSE 1 END) AS BIGINT) AS unified FROM (SELECT conv_id, unnest(CASE WHEN role = 'user' THEN [content] ELSE [content, 'r'] END) AS p FROM turns) GROUP BY conv_id""",
    "turns",
)
def unified_turns(t):
    v = V.turns(t)
    asked = F.col("role") != "user"
    none = F.lit(None).cast("string")
    turn = F.struct(
        F.when(asked, none).otherwise(F.col("role")).alias("role"),
        F.when(asked, none).otherwise(F.col("content")).alias("content"),
        F.when(asked, F.col("content")).alias("prompt"),
        F.when(asked, F.lit("r")).alias("reply"),
    )
    rows = v.select("conv_id", F.size(C.unify_dialogs(F.array(turn))).cast("bigint").alias("n"))
    return rows.groupBy("conv_id").agg(F.sum("n").alias("unified"))


# ---- dialogues and pages as they stand; the queries above read words chosen by the length of a text


_FLIPS_SQL = """SELECT conv_id, CAST(SUM(CASE WHEN r0 = 'user' AND r1 = 'assistant' AND r2 = 'user' AND r3 = 'assistant' AND trim(c1, {space}) = trim(c3, {space})
    AND ((upper(trim(c0, {space})) = 'YES' AND upper(trim(c2, {space})) = 'NO') OR (upper(trim(c0, {space})) = 'NO' AND upper(trim(c2, {space})) = 'YES')) THEN 1 ELSE 0 END) AS BIGINT) AS flip_flops FROM (
    SELECT conv_id, role AS r0, content AS c0, lag(role, 1) OVER w AS r1, lag(content, 1) OVER w AS c1, lag(role, 2) OVER w AS r2, lag(content, 2) OVER w AS c2,
    lag(role, 3) OVER w AS r3, lag(content, 3) OVER w AS c3 FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id"""
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_REPLIES = "replies AS (SELECT context, upper(content) AS u, upper(trim(content, {})) AS word, content FROM said WHERE role = 'user')".format(_SPACE)


@query(_FLIPS_SQL.format(space=_SPACE), "said")
def said_flipflops(t):
    return R.flip_flops(V.said(t), "conv_id", V.turn_order())


def _with_texts(rows, counts):
    """Counts per context beside a checksum of the texts they were taken from."""
    return counts.join(rows.groupBy("context").agg(checksum("content")), "context")


@query(
    f"SELECT context, COUNT(*) AS replies, {', '.join(_SAID.format(f"word = '{w}'", n) for n, w in (('yes', 'YES'), ('no', 'NO'), ('none_of_them', 'NONE OF THEM'), ('mode_approach', 'APPROACH'), ('mode_align_yaw', 'ALIGN_YAW')))},"
    f" {sql_checksum('content')} FROM (WITH {_REPLIES} SELECT * FROM replies) GROUP BY context",
    "said",
)
def said_replies(t):
    v = V.said(t)
    return _with_texts(v.filter("role = 'user'"), R.reply_distribution(v))


@query(
    f"SELECT context, {', '.join(_SAID.format(f"contains(u, '{w}')", n) for n, w in (('yes', 'YES'), ('no', 'NO'), ('none_of_them', 'NONE'), ('ok', 'OK')))},"
    f" {sql_checksum('content')} FROM (WITH {_REPLIES} SELECT * FROM replies) GROUP BY context",
    "said",
)
def said_keywords(t):
    rows = V.said(t).filter("role = 'user'")
    return _with_texts(rows, R.reply_keywords(rows, "content", ["context"]))


@query(
    f"""SELECT conv_id, COUNT(*) AS unified, {sql_checksum("role || ':' || content")} FROM said WHERE content IS NOT NULL GROUP BY conv_id""",
    "said",
)
def said_unified(t):
    """What the assistant says is a prompt, its reply the user's own turn."""
    asked = F.col("role") == "assistant"
    none = F.lit(None).cast("string")
    turn = F.struct(
        F.when(asked, none).otherwise(F.col("role")).alias("role"),
        F.when(asked, none).otherwise(F.col("content")).alias("content"),
        F.when(asked, F.col("content")).alias("prompt"),
        none.alias("reply"),
    )
    rows = V.said(t).select("conv_id", F.explode(C.unify_dialogs(F.array(turn))).alias("_t"))
    return rows.select("conv_id", F.concat_ws(":", "_t.role", "_t.content").alias("said")).groupBy("conv_id").agg(F.count("*").alias("unified"), checksum("said"))


@query(
    f"""SELECT violation, COUNT(*) AS n, {sql_checksum('o')} FROM (SELECT o, CASE WHEN o IS NULL THEN 'missing output' WHEN NOT json_valid(o) THEN 'output is not JSON' ELSE 'ok' END AS violation
    FROM (SELECT html AS o FROM pages)) GROUP BY violation"""
)
def page_contract(t):
    rows = t.pages.select(F.col("page_id").cast("string").alias("id"), F.lit("i").alias("instruction"), F.coalesce("url", F.lit("")).alias("input"), F.col("html").alias("output"))
    ok, bad = C.validate_contract(rows)
    found = bad.select(F.explode("violations").alias("violation"), "output").unionByName(ok.select(F.lit("ok").alias("violation"), "output"))
    return found.groupBy("violation").agg(_count(), checksum("output"))


# ---- ratings


def _kappa_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS rater_a, '{b}' AS rater_b, n, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT COUNT(*) AS n, AVG(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END) AS po,
    AVG({a}) * AVG({b}) + (1 - AVG({a})) * (1 - AVG({b})) AS pe FROM r)"""


_NAMED = "SELECT * FROM ({}) "


@query("SELECT * FROM (WITH r AS (SELECT a AS quality, b AS toxic, c AS length FROM ratings) " + " UNION ALL ".join(_kappa_sql(a, b) for a, b in (("quality", "toxic"), ("quality", "length"), ("toxic", "length"))) + ")", "ratings")
def cohen_kappa(t):
    aligned = K.align_raters(V.ratings(t), ["doc_id"], "rater", "label", V.RATERS, "seq")
    return _rounded(K.cohen_kappa(aligned, V.RATERS))


@query(
    """SELECT items, 3 AS raters, round((pbar - pe) / (1 - pe), 6) AS kappa FROM (SELECT COUNT(*) AS items, AVG(((s * s + (3 - s) * (3 - s)) - 3) / 6.0) AS pbar,
    pow(AVG(s / 3.0), 2) + pow(1 - AVG(s / 3.0), 2) AS pe FROM (SELECT a + b + c AS s FROM ratings))""",
    "ratings",
)
def fleiss_kappa(t):
    aligned = K.align_raters(V.ratings(t), ["doc_id"], "rater", "label", V.RATERS, "seq")
    return _rounded(K.fleiss_kappa(aligned, V.RATERS))


@query("SELECT quality, toxic, COUNT(*) AS n, COUNT(*) FILTER (quality <> toxic) AS tool_differs, COUNT(*) FILTER (quality <> toxic OR doc_id % 2 = 1) AS call_differs FROM labels GROUP BY quality, toxic")
def baseline_disagreement(t):
    call = lambda tool, obj: F.struct(tool.cast("string").alias("tool"), F.struct(obj.alias("obj")).alias("args"))
    rows = t.labels.select(
        "quality", "toxic", call(F.col("quality"), F.col("doc_id") % 2).alias("target_tool_call"), call(F.col("toxic"), F.lit(0).cast("bigint")).alias("oracle_baseline_call")
    )
    return S.baseline_disagreement(rows, ["quality", "toxic"])


# ---- rollouts and cells


@query("SELECT * FROM summary", "summary")
def condition_summary(t):
    return S.condition_summary(V.rollouts(t))


_WEIGHTED = "SELECT condition, round(SUM(success_rate * n_rollouts) / SUM(n_rollouts), 6) AS success_rate, round(SUM(mean_interactions * n_rollouts) / SUM(n_rollouts), 6) AS mean_interactions, CAST(SUM(n_rollouts) AS BIGINT) AS n FROM summary WHERE mode = 'assisted'{} GROUP BY condition"


@query(_WEIGHTED.format(""), "summary")
def weighted_condition(t):
    return _rounded(S.weighted_conditions(S.condition_summary(V.rollouts(t)), "assisted"))


@query(_WEIGHTED.format(" AND difficulty = 'hard'"), "summary")
def weighted_condition_hard(t):
    return _rounded(S.weighted_conditions(S.condition_summary(V.rollouts(t)), "assisted", "hard"))


@query(
    """SELECT regexp_extract(cell, '^(.*)__(.*)$', 1) AS model, regexp_extract(cell, '^(.*)__(.*)$', 2) AS rerank, round(round(AVG(s), 4) * 100, 1) AS success_pct, round(round(AVG(i), 3), 2) AS mean_interactions,
    CAST(SUM(n) AS BIGINT) AS n_rollouts, round(max(g), 3) AS mean_ig_bits FROM (SELECT cell, condition, difficulty, round(avg(success), 4) AS s, round(avg(interactions), 2) AS i, COUNT(*) AS n
    FROM rollouts WHERE mode = 'assisted' GROUP BY cell, condition, difficulty) LEFT JOIN (SELECT cell, avg(interactions / 8.0) AS g FROM rollouts GROUP BY cell) USING (cell) GROUP BY cell""",
    "rollouts",
)
def ablation_table(t):
    r = V.rollouts(t)
    cells = S.cell_means(S.condition_summary(r, ["cell", "mode", "condition", "difficulty"]), "assisted")
    ig = S.cell_ig(r.select("cell", F.lit("chosen").alias("selector"), (F.col("interactions") / 8).alias("ig_bits")))
    table = S.ablation_table(cells, ig)
    return table.select("model", "rerank", F.round("success_pct", 1).alias("success_pct"), F.round("mean_interactions", 2).alias("mean_interactions"), "n_rollouts", "mean_ig_bits")


_AVG = "AVG(acc) FILTER (flavor = '{}')"


@query(
    "SELECT m AS _model_safe, " + ", ".join(f"round(MAX(acc) FILTER (flavor = 'oracle' AND env = '{e}'), 6) AS {e}" for e in S.ENVS) + f", round({_AVG.format('oracle')}, 6) AS avg3 FROM cells GROUP BY m",
    "cells",
)
def macro_average(t):
    return _rounded(S.macro_average(V.cells(t)))


@query(f"SELECT m AS _model_safe, round({_AVG.format('oracle')}, 6) AS clean, round({_AVG.format('ambiguous')}, 6) AS ambiguous, round({_AVG.format('ambiguous')} - {_AVG.format('oracle')}, 6) AS gap FROM cells GROUP BY m", "cells")
def clean_gap(t):
    return _rounded(S.clean_gap(V.cells(t)))


@query(
    f"""SELECT p.panel_no, p.place, m AS _model_safe, round(avg3, 6) AS avg3, round(amb, 6) AS ambiguous FROM (VALUES (0, 0, 'woz_lora'), (0, 1, 'oracle_lora'), (0, 2, 'oracle_woz_lora'), (1, 0, 'oracle_woz_lora'), (2, 0, 'oracle_lora')) p(panel_no, place, m)
    JOIN (SELECT m, {_AVG.format('oracle')} AS avg3, {_AVG.format('ambiguous')} AS amb FROM cells GROUP BY m) USING (m)""",
    "cells",
)
def ablation_panels(t):
    return _rounded(S.ablation_panels(V.cells(t)).select("panel_no", "place", "_model_safe", "avg3", "ambiguous"))


@query(
    "SELECT m AS _model_safe, " + ", ".join(f"bool_or(flavor = '{f}' AND env = '{e}') AS {s}" for f, sets in S.EVAL_SETS.items() for e, s in sets.items()) + " FROM cells GROUP BY m",
    "cells",
)
def coverage_matrix(t):
    return S.coverage_matrix(V.cells(t), [s for sets in S.EVAL_SETS.values() for s in sets.values()])


@query("SELECT m AS _model_safe, CASE flavor WHEN 'oracle' THEN 'oracle_valid_' ELSE 'ambiguous_' END || env AS _eval_set, round(eps, 6) AS examples_per_sec, round(acc * 100, 6) AS accuracy_pct FROM cells", "cells")
def throughput(t):
    return _rounded(S.throughput(V.cells(t)))


@query("SELECT flavor, env, m AS best_model FROM (SELECT *, row_number() OVER (PARTITION BY flavor, env ORDER BY acc DESC, m) AS rk FROM cells) WHERE rk = 1", "cells")
def best_models(t):
    c = V.cells(t)
    best = S.flag_best(c, "tool_accuracy", keys=["_eval_set"], ties=["_model_safe"]).filter("best")
    flavor = F.when(F.startswith(F.col("_eval_set"), F.lit("oracle")), "oracle").otherwise("ambiguous")
    return best.select(flavor.alias("flavor"), F.regexp_extract("_eval_set", "([a-z]+)$", 1).alias("env"), F.col("_model_safe").alias("best_model"))


_JOINED = "SELECT o_orderpriority, o_totalprice, n FROM orders JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'"


def _trial_metrics(t):
    inter = t.lineitem.groupBy(F.col("l_orderkey").alias("trial_id")).agg(F.count("*").alias("n_interactions"))
    o = t.orders
    mode = F.when(F.col("o_orderstatus") == "P", "manual").otherwise("assistive")
    master = o.select(
        F.col("o_orderkey").alias("trial_id"), mode.alias("mode"), F.col("o_totalprice").alias("n_plausible_targets"), F.lit(None).cast("int").alias("n_tool_failures"), F.col("o_orderpriority").alias("priority")
    )
    return S.join_trial_metrics(inter, master)


@query(f"SELECT o_orderpriority AS priority, COUNT(*) AS n, round(corr(o_totalprice, n), 6) AS r FROM ({_JOINED}) GROUP BY o_orderpriority")
def interaction_corr(t):
    return _rounded(S.correlate(_trial_metrics(t), "n_plausible_targets", "n_interactions", ["priority"]))


@query(f"SELECT o_orderpriority AS priority, round(regr_slope(n, o_totalprice) * 1000000, 6) AS slope, round(regr_intercept(n, o_totalprice), 6) AS intercept FROM ({_JOINED}) GROUP BY o_orderpriority")
def interaction_trend(t):
    return _rounded(S.trend(_trial_metrics(t), "n_plausible_targets", "n_interactions", ["priority"]).withColumn("slope", F.col("slope") * 1_000_000))


@query("SELECT o_orderstatus AS status, COUNT(*) AS pending, MIN(o_orderkey) AS first_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderstatus")
def incremental_append(t):
    grid = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    todo = S.pending(grid, t.lineitem.select(F.col("l_orderkey").alias("key")), ["key"])
    return todo.groupBy("status").agg(F.count("*").alias("pending"), F.min("key").alias("first_key"))


@query("SELECT o_orderstatus AS status, condition, mode, CAST(COUNT(*) * 3 AS BIGINT) AS runs FROM orders, (VALUES ('clean'), ('noisy')) c(condition), (VALUES ('assisted'), ('manual')) m(mode) GROUP BY 1, 2, 3")
def sweep_grid(t):
    grid = S.sweep_grid(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), ("clean", "noisy"), ("assisted", "manual"), 3)
    return grid.groupBy("status", "condition", "mode").agg(F.count("*").alias("runs"))
