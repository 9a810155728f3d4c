"""Queries on scenes, policies, questions, layouts and scenarios (orders and line items)."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlog.functions.geometry import CELLS, YAW_BINS, yaw_bin
from decisionlog.functions.text import ratio
from decisionlog.operators import contracts as C
from decisionlog.operators import evaluate as E
from decisionlog.operators import perturb as N
from decisionlog.operators import policies as B
from decisionlog.operators import poses as P
from decisionlog.operators import profile as R
from decisionlog.operators import questions as Q
from decisionlog.operators import trials as T
from decisionlog.operators.ordered import by_number
from decisionlog.plans import views as V
from decisionlog.plans.registry import checksum, query, sql_checksum, sql_draw, sql_pick, sql_uniform, unfold

BY_ID = lambda: by_number("id")


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---- candidates


@query("SELECT id, COUNT(*) AS n, string_agg(oid, '|' ORDER BY slot) AS ids, string_agg(label, '|' ORDER BY slot) AS labels FROM cands GROUP BY id", "cands")
def candidate_radius(t):
    rows = B.candidate_labels(V.scenes(t))
    ids = F.col("obs.memory.candidates")
    return rows.filter(F.size(ids) > 0).select(
        "id", F.size(ids).cast("bigint").alias("n"), F.array_join(ids, "|").alias("ids"), F.array_join("candidate_labels", "|").alias("labels")
    )


@query("SELECT cur AS cell_index, COUNT(*) AS pairs FROM cands GROUP BY cur", "cands")
def candidate_pairs(t):
    s = V.scenes(t).select(F.col("id").alias("order_key"), F.get("obs.gripper_hist", F.lit(5))["cell"].alias("cell"))
    objects = V.scene_rows(t).select("order_key", "is_held", F.col("cell").alias("object_cell"))
    pairs = P.candidate_join(s, objects, ["order_key"], 2)
    index = F.array_position(F.array(*[F.lit(c) for c in CELLS]), F.col("cell")) - 1
    return pairs.groupBy(index.alias("cell_index")).agg(F.count("*").alias("pairs"))


@query(
    """SELECT id, string_agg(d_cur || ':' || oid, '|' ORDER BY d_cur, oid) AS ranked FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d_cur, oid) AS rk FROM cands)
    WHERE rk <= 3 GROUP BY id""",
    "cands",
)
def candidate_rank(t):
    rows = P.rank_candidates(V.scenes(t), 3).filter(F.size("ranked") > 0)
    shown = F.transform("ranked", lambda r: F.concat(r["dist"].cast("string"), F.lit(":"), r["id"]))
    return rows.select("id", F.array_join(shown, "|").alias("ranked"))


@query("SELECT id, string_agg(oid, '|' ORDER BY slot) AS live FROM cands WHERE NOT (id % 5 = 0 AND oid = 'obj_1') GROUP BY id", "cands")
def live_candidates(t):
    return Q.live_candidates(V.scenes(t)).filter(F.size("live") > 0).select("id", F.array_join("live", "|").alias("live"))


# ---- profiles of scenes


_HEAD = "seen WHERE id IN (SELECT MIN(id) FROM scene_heads GROUP BY customer)"


@query(
    f"""SELECT COUNT(*) AS episodes, COUNT(*) FILTER (most >= 2) AS episodes_with_overlap, round(AVG(CASE WHEN most >= 2 THEN 1.0 ELSE 0.0 END), 6) AS overlap_rate,
    MIN(most) AS min_sharing, MAX(most) AS max_sharing, round(AVG(most), 6) AS avg_sharing FROM (
    SELECT customer, MAX(n) AS most FROM (SELECT customer, ci, COUNT(*) AS n FROM {_HEAD} GROUP BY customer, ci) GROUP BY customer)""",
    "seen",
)
def object_overlap(t):
    rows = V.scenes(t).select("id", "customer", F.col("obs.objects").alias("objects"))
    return _rounded(R.object_overlap(rows, BY_ID(), "customer"))


@query(f"SELECT label, COUNT(*) AS n FROM {_HEAD} GROUP BY label ORDER BY n DESC, MIN(row(id, slot)) LIMIT 5", "seen")
def label_coverage(t):
    rows = V.scenes(t).select("id", "customer", F.col("obs.objects").alias("objects"))
    return R.label_coverage(rows, BY_ID(), 5, "customer")


@query(
    f"""SELECT 'cell' AS symbol, {V.sql_slot(CELLS, 'v')} AS value, COUNT(*) AS n FROM (SELECT unnest([(customer + i * (id % 4)) % 9 for i in range(6)]) AS v FROM scene_heads) GROUP BY 2
    UNION ALL SELECT 'yaw', {V.sql_slot(YAW_BINS, 'v')}, COUNT(*) FROM (SELECT unnest([(customer + i) % 8 for i in range(6)]) AS v FROM scene_heads) GROUP BY 2
    UNION ALL SELECT 'z', {V.sql_slot(('HIGH', 'MID', 'LOW'), 'id')}, COUNT(*) * 6 FROM scene_heads GROUP BY 2
    UNION ALL SELECT 'candidates', CAST(coalesce(n, 0) AS VARCHAR), COUNT(*) FROM scene_heads LEFT JOIN menus USING (id) GROUP BY 2""",
    "scene_heads",
    "menus",
)
def symbol_coverage(t):
    s = V.scenes(t).select("obs.*")
    return R.symbol_coverage(s)


@query(
    f"""SELECT COUNT(*) AS states, {sql_checksum('first')} FROM (SELECT MIN(id) AS first FROM (SELECT h.id, (h.cur, (h.customer + 5) % 8, h.id % 5 = 0,
    (SELECT string_agg(s.id || s.ci || s.yi || s.is_held, ',' ORDER BY s.slot) FROM scene_rows s WHERE s.order_key = h.id)) AS state FROM scene_heads h) GROUP BY state)""",
    "scene_heads",
)
def distinct_states(t):
    # held objects are no candidates, so a state tells held from free objects unless they are out of reach
    rows = V.scenes(t).withColumn("obs", F.col("obs").withField("objects", F.transform("obs.objects", lambda o: o.withField("id", F.concat(o["id"], F.when(o["is_held"], "h").otherwise(""))))))
    return Q.dedup_states(rows.select("id", "obs"), BY_ID(), columns=["id"]).agg(F.count("*").alias("states"), checksum("id"))


# ---- policies

_ACT_TOOL = "CASE WHEN near THEN 'APPROACH' ELSE 'ALIGN_YAW' END"
_VERB = "CASE WHEN near THEN 'approach' ELSE 'align yaw to' END"
_MENU = "array_to_string(list_concat([i || ') ' || shown[i] for i in range(1, len(shown) + 1)], [(len(shown) + 1) || ') None of them']), '|')"
_OUT = """SELECT id, CASE WHEN act IS NOT NULL THEN {tool} ELSE 'INTERACT' END AS tool, CASE WHEN act IS NOT NULL THEN NULL WHEN confirm IS NOT NULL THEN 'CONFIRM' ELSE 'QUESTION' END AS kind,
    CASE WHEN act IS NOT NULL THEN NULL WHEN confirm IS NOT NULL THEN 'Do you want me to ' || {verb} || ' the ' || confirm || '?' ELSE text END AS text,
    CASE WHEN act IS NOT NULL THEN NULL WHEN menu IS NOT NULL AND confirm IS NULL THEN menu ELSE '1) YES|2) NO' END AS choices, act AS obj FROM ({inner})""".format(
    tool=_ACT_TOOL, verb=_VERB, inner="{}"
)
_H = "scene_heads h LEFT JOIN menus m USING (id)"
_NOTHING = "I don''t see any nearby candidates. What do you want help with?"


def _plain(df):
    p = F.col("pred")
    return df.select("id", p["tool"].alias("tool"), p["args"]["kind"].alias("kind"), p["args"]["text"].alias("text"), F.array_join(p["args"]["choices"], "|").alias("choices"), p["args"]["obj"].alias("obj"))


@query(
    _OUT.format(f"SELECT h.*, CASE WHEN n = 1 THEN first_id END AS act, NULL AS confirm, CASE WHEN n >= 2 THEN {_MENU} END AS menu, CASE WHEN n IS NULL THEN '{_NOTHING}' ELSE 'Which object do you want help with?' END AS text FROM {_H}"),
    "scene_heads",
    "menus",
)
def policy_ask_if_ambiguous(t):
    return _plain(B.ask_if_ambiguous(V.scenes(t)))


@query(
    _OUT.format(f"SELECT h.*, CAST(NULL AS VARCHAR) AS act, CASE WHEN n = 1 THEN first_label END AS confirm, CASE WHEN n >= 2 THEN {_MENU} END AS menu, CASE WHEN n IS NULL THEN '{_NOTHING}' ELSE 'Which object do you want help with?' END AS text FROM {_H}"),
    "scene_heads",
    "menus",
)
def policy_always_ask(t):
    return _plain(B.always_ask(V.scenes(t)))


def _shares(score: str) -> str:
    return f"""SELECT id, slot, oid, label, e / SUM(e) OVER (PARTITION BY id) AS p, COUNT(*) OVER (PARTITION BY id) AS k FROM (
    SELECT *, exp(v - MAX(v) OVER (PARTITION BY id)) AS e FROM (SELECT *, {score} AS v FROM cands))"""


@query(
    _OUT.format(
        f"""SELECT h.*, CASE WHEN n = 1 OR bp >= 0.6 THEN best END AS act, NULL AS confirm, CASE WHEN n >= 2 AND bp < 0.6 THEN {_MENU} END AS menu,
        CASE WHEN n IS NULL THEN 'What do you want help with?' ELSE 'Which object do you want help with?' END AS text FROM {_H}
        LEFT JOIN (SELECT id, MAX(p) AS bp, arg_max(oid, row(round(p, 9), -slot)) AS best FROM ({_shares('-1.5 * d_cur + 0.5 * (d_prev - d_cur)')}) GROUP BY id) USING (id)"""
    ),
    "scene_heads",
    "menus",
)
def policy_predict_assist(t):
    return _plain(B.predict_then_assist(V.scenes(t)))


@query(
    _OUT.format(
        f"""SELECT h.*, CASE WHEN n = 1 OR ent < 0.3 THEN best END AS act, CASE WHEN n >= 2 AND ent >= 0.3 AND ent < 0.7 THEN bl END AS confirm,
        CASE WHEN n >= 2 AND ent >= 0.7 THEN {_MENU.replace('shown', 'ranked')} END AS menu, CASE WHEN n IS NULL THEN 'What do you want help with?' ELSE 'Which object do you want help with?' END AS text
        FROM {_H} LEFT JOIN (SELECT id, -SUM(p * ln(p + 1e-10)) / CASE WHEN MAX(k) > 1 THEN ln(MAX(k)) ELSE 1 END AS ent, arg_max(oid, row(round(p, 9), -slot)) AS best,
        arg_max(label, row(round(p, 9), -slot)) AS bl, list(label ORDER BY round(p, 9) DESC, slot)[1:4] AS ranked
        FROM ({_shares('-d_cur + 1.5 * (d_start - d_cur)')}) GROUP BY id) USING (id)"""
    ),
    "scene_heads",
    "menus",
)
def policy_bayes(t):
    return _plain(B.bayes_intent(V.scenes(t)))


@query(f"SELECT id, COUNT(*) AS n, round(MAX(p), 6) AS top, round(MIN(p), 6) AS low FROM ({_shares('-1.5 * d_cur + 0.5 * CASE WHEN cur <> prev THEN d_prev - d_cur ELSE 0 END')}) GROUP BY id", "cands")
def motion_prior(t):
    rows = B.motion_prior(V.scenes(t)).filter(F.size("prior") > 0)
    ps = F.transform("prior", lambda s: s["p"])
    return rows.select("id", F.size("prior").cast("bigint").alias("n"), F.round(F.array_max(ps), 6).alias("top"), F.round(F.array_min(ps), 6).alias("low"))


_NEAR = {c: N_ for c, N_ in ((i, [j for j in (i - 3, i + 3, i - 1 if i % 3 else -9, i + 1 if i % 3 < 2 else -9) if 0 <= j < 9]) for i in range(9))}
_NEAR_SQL = "[" + ", ".join("[" + ", ".join(map(str, v)) + "]" for v in _NEAR.values()) + "]"
_LAST = sql_draw("id || '#5'", "pose-cell", 0)


@query(
    f"""SELECT status, noise_level, COUNT(*) AS n, round(100.0 * AVG(CASE WHEN (pn = 1) = (gn = 1) THEN 1 ELSE 0 END), 2) AS tool_acc,
    round(100.0 * AVG(CASE WHEN (pn = 1) = (gn = 1) AND (pn = 0) = (gn = 0) AND (pn = 0 OR (pn = 1 AND pids = gids) OR (pn >= 2 AND plabels = glabels)) THEN 1 ELSE 0 END), 2) AS strict_match,
    round(CASE WHEN SUM(CASE WHEN gn = 1 THEN 1 ELSE 0 END) > 0 THEN 100.0 * SUM(CASE WHEN gn = 1 AND pn = 1 AND pids = gids THEN 1 ELSE 0 END) / SUM(CASE WHEN gn = 1 THEN 1 ELSE 0 END) ELSE 0 END, 2) AS motion_obj_acc
    FROM (SELECT x.id, status, noise_level, COUNT(oid) FILTER (near_new) AS pn, COUNT(oid) FILTER (near_old) AS gn,
    string_agg(oid, '|' ORDER BY slot) FILTER (near_new) AS pids, string_agg(oid, '|' ORDER BY slot) FILTER (near_old) AS gids,
    list(label ORDER BY slot) FILTER (near_new)[1:4] AS plabels, list(label ORDER BY slot) FILTER (near_old)[1:4] AS glabels FROM (
    SELECT s.*, noise_level, NOT is_held AND abs(ci // 3 - nc // 3) + abs(ci % 3 - nc % 3) <= 1 AS near_new, NOT is_held AND d_cur <= 1 AS near_old FROM (
    SELECT seen.*, noise_level, CASE WHEN {sql_uniform(_LAST)} < noise_level THEN {_NEAR_SQL}[CAST(cur AS INT) + 1][CAST({sql_pick(_LAST, f'len({_NEAR_SQL}[CAST(cur AS INT) + 1])')} AS INT) + 1] ELSE cur END AS nc
    FROM seen, (VALUES (0.0), (0.1), (0.2), (0.3), (0.5)) l(noise_level)) s) x GROUP BY x.id, status, noise_level) GROUP BY status, noise_level""",
    "seen",
)
def robustness_curve(t):
    # the true call is the policy's answer to the clean input with candidates one step away
    clean = N.perturb_user_input(V.scenes(t), 0.0)
    truth = B.ask_if_ambiguous(clean).withColumnRenamed("pred", "gt_call")
    return E.robustness_curve(truth, N.perturb_user_input, B.ask_if_ambiguous, keys=["status"])


def _jitter_sql(token: str, cell: str) -> str:
    near = f"{_NEAR_SQL}[CAST({cell} AS INT) + 1]"
    return f"CASE WHEN {sql_uniform(token)} < 0.3 THEN {near}[CAST({sql_pick(token, f'len({near})')} AS INT) + 1] ELSE {cell} END"


@query(
    f"""SELECT id, string_agg(nc, '|' ORDER BY i) AS cells, string_agg(ny, '|' ORDER BY i) AS yaws FROM (SELECT id, i, {V.sql_slot(CELLS, _jitter_sql(sql_draw("id || '#' || i", 'pose-cell', 5), 'c'))} AS nc,
    {V.sql_slot(YAW_BINS, f"CASE WHEN {sql_uniform(sql_draw('''id || '#' || i''', 'pose-yaw', 5))} < 0.3 THEN CASE {sql_pick(sql_draw('''id || '#' || i''', 'pose-yaw', 5), 2)} WHEN 0 THEN y + 7 ELSE y + 1 END ELSE y END")} AS ny
    FROM (SELECT id, i, (customer + i * (id % 4)) % 9 AS c, (customer + i) % 8 AS y FROM scene_heads, range(6) r(i))) GROUP BY id""",
    "scene_heads",
)
def perturb_poses(t):
    rows = N.perturb_user_input(V.scenes(t), 0.3, 5)
    part = lambda f: F.array_join(F.transform("obs.gripper_hist", lambda h: h[f]), "|")
    return rows.select("id", part("cell").alias("cells"), part("yaw").alias("yaws"))


_OBJ = "id || '#' || ix"


@query(
    f"""SELECT id, string_agg({V.sql_slot(CELLS, 'nc')}, '|' ORDER BY ix) AS cells, string_agg(nl, '|' ORDER BY ix) AS labels FROM (SELECT id, ix, {_jitter_sql(sql_draw(_OBJ, 'object-cell', 5), 'ci')} AS nc,
    CASE WHEN {sql_uniform(sql_draw(_OBJ, 'label', 5))} < 0.3 THEN list_filter({V._LIST(V.OBJECT_LABELS)}, lambda x: x <> label)[CAST({sql_pick(sql_draw(_OBJ, 'label', 5), 9)} AS INT) + 1] ELSE label END AS nl
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY slot) - 1 AS ix FROM seen)) GROUP BY id""",
    "seen",
)
def perturb_objects(t):
    rows = N.perturb_labels(N.perturb_grid(V.scenes(t), 0.3, 5), 0.3, 5)
    part = lambda f: F.array_join(F.transform("obs.objects", lambda o: o[f]), "|")
    return rows.select("id", part("cell").alias("cells"), part("label").alias("labels"))


@query(
    f"""SELECT id, COUNT(*) FILTER (is_c AND NOT {sql_uniform(sql_draw("id || '#' || cx", 'candidate-drop', 5))} < 0.3) AS kept,
    COUNT(*) FILTER (NOT is_c AND {sql_uniform(sql_draw("id || '#' || nx", 'candidate-add', 5))} < 0.3) AS added FROM (
    SELECT *, COUNT(*) FILTER (is_c) OVER w - 1 AS cx, COUNT(*) FILTER (NOT is_c) OVER w - 1 AS nx FROM (SELECT *, d_cur <= 2 AND NOT is_held AS is_c FROM seen)
    WINDOW w AS (PARTITION BY id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY id""",
    "seen",
)
def perturb_candidates(t):
    rows = N.perturb_candidates(V.scenes(t).withColumn("was", F.col("obs.memory.candidates")), 0.3, 5)
    now = F.col("obs.memory.candidates")
    kept = F.size(F.array_intersect(now, "was")).cast("bigint")
    return rows.select("id", kept.alias("kept"), (F.size(now) - kept).alias("added"))


# ---- questions

_H2 = "CASE WHEN {0} > 1 THEN log2({0}) ELSE 0.0 END"
_QUESTIONS = f"""SELECT id, customer, status, n_all, coalesce(n, 0) AS n, k, CAST(coalesce(p, 0) AS BIGINT) AS p, coalesce(l, 0) AS l, coalesce(f, 0) AS f FROM (SELECT id, customer, status FROM scene_heads) LEFT JOIN (
    SELECT id, n AS n_all, len(shown) + 1 AS k FROM menus) USING (id) LEFT JOIN (SELECT id, COUNT(*) AS n FROM cands WHERE NOT (id % 5 = 0 AND oid = 'obj_1') GROUP BY id) USING (id)
    LEFT JOIN (SELECT id, COUNT(*) AS p, COUNT(DISTINCT label) AS l FROM (SELECT id, unnest(shown) AS label FROM menus) JOIN (SELECT id, label FROM cands WHERE NOT (id % 5 = 0 AND oid = 'obj_1') GROUP BY id, label HAVING COUNT(*) = 1) USING (id, label) GROUP BY id) USING (id)
    LEFT JOIN (SELECT m.id, COUNT(*) AS f FROM menus m JOIN cands c ON c.id = m.id AND c.label = m.first_label AND NOT (c.id % 5 = 0 AND c.oid = 'obj_1') GROUP BY m.id) USING (id)"""
_MENU_IG = f"""CASE WHEN n_all >= 2 AND p >= 2 THEN greatest({_H2.format('n')} - ({_H2.format('(n - l)')} + (k - p - 1) * {_H2.format('n')}) / k, 0.0) ELSE 0.0 END"""


def _questions(t):
    """The policy's question about every scene."""
    rows = B.always_ask(V.scenes(t))
    return rows.withColumn("question", F.col("pred.args"))


@query(f"SELECT id, CASE WHEN n_all >= 2 AND p >= 2 THEN 'candidate_choice' WHEN n_all = 1 AND f = 1 THEN 'binary_confirm' ELSE 'noop' END AS intent, n AS n_before, round({_H2.format('n')}, 6) AS h_before_bits, round({_MENU_IG}, 6) AS ig_bits FROM ({_QUESTIONS})", "scene_heads", "menus")
def question_ig(t):
    rows = Q.information_gain(Q.classify_questions(Q.live_candidates(_questions(t))))
    return _rounded(rows.select("id", F.col("intent.kind").alias("intent"), F.size("live").cast("bigint").alias("n_before"), "h_before_bits", "ig_bits"))


@query()
def question_ig_motion(t):
    rows = Q.information_gain(Q.classify_questions(Q.live_candidates(_questions(t))), "motion_weighted")
    return _rounded(rows.select("id", "h_before_bits", "h_after_expected_bits", "ig_bits"))


@query(
    f"""SELECT id, CASE WHEN n_all >= 2 THEN k ELSE 2 END AS replies, CAST(CASE WHEN n_all >= 2 AND p >= 2 THEN p + (n - l) + (k - p - 1) * n
    WHEN n_all = 1 AND f = 1 THEN 1 + 0 ELSE (CASE WHEN n_all >= 2 THEN k ELSE 2 END) * n END AS BIGINT) AS left_over FROM ({_QUESTIONS})""",
    "scene_heads",
    "menus",
)
def simulated_replies(t):
    rows = Q.simulate_replies(Q.classify_questions(Q.live_candidates(_questions(t))))
    left = F.aggregate("replies", F.lit(0), lambda a, r: a + F.size(r["candidates"]))
    return rows.select("id", F.size("replies").cast("bigint").alias("replies"), left.cast("bigint").alias("left_over"))


def _alternatives(t):
    """Three questions per scene with candidates: the menu, a confirmation of the first candidate, an open one."""
    rows = B.ask_if_ambiguous(V.scenes(t)).filter(F.size("obs.memory.candidates") >= 2)
    first = B.first_label(F.col("obs.objects"), F.get("obs.memory.candidates", F.lit(0)))
    yes_no = F.array(F.lit("1) YES"), F.lit("2) NO"))
    ask = lambda kind, text, choices: F.struct(F.lit(kind).alias("kind"), text.alias("text"), choices.alias("choices"))
    each = F.array(
        ask("QUESTION", F.col("pred.args.text"), F.col("pred.args.choices")),
        ask("CONFIRM", F.concat(F.lit("Do you mean the "), first, F.lit("?")), yes_no),
        ask("SUGGESTION", F.lit("Can I help?"), yes_no),
    )
    return rows.select("id", "customer", "obs", F.posexplode(each).alias("sample_idx", "question"))


def _gains(t):
    """The selectors' gains per scene: what :func:`question_log` scores, without the log's own fields."""
    # of a scene, questions read names and candidates only
    rows = _alternatives(t).withColumn("obs", F.struct(F.transform("obs.objects", lambda o: F.struct(o["id"].alias("id"), o["label"].alias("label"))).alias("objects"), "obs.memory"))
    long = Q.profile_gain(Q.reply_profile(Q.classify_questions(Q.live_candidates(rows))))
    call = F.struct(F.struct("question.kind", "question.choices").alias("args"))
    item = F.struct("sample_idx", call.alias("tool_call"), "ig_bits")
    # three questions per scene
    rows = long.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("candidates"), F.any_value("profile.live").alias("n_candidates_before"))
    rows = Q.select_question(rows, "info_gain", id_cols=("id",))
    taken = F.get("candidates", F.col("picked"))
    return Q.selector_scores(rows.withColumns({"ig_bits": taken["ig_bits"], "interact_kind": F.upper(taken["tool_call"]["args"]["kind"])}))


def question_log(t, selector="info_gain"):
    """Logged questions of all scenes, one per order, in order of the customer's orders."""
    long = Q.information_gain(Q.classify_questions(Q.live_candidates(_alternatives(t))))
    call = F.struct(F.lit("INTERACT").alias("tool"), F.col("question").alias("args"))
    item = F.struct("sample_idx", call.alias("tool_call"), "ig_bits", F.col("h_after_expected_bits").alias("h_after"), "per_reply")
    # three questions per scene
    scored = long.groupBy("customer", "id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", item.alias("c")))).alias("_c"), F.any_value("obs").alias("obs"), F.any_value("live").alias("live"))
    scored = scored.withColumn("candidates", F.transform("_c", lambda x: x["c"])).drop("_c")
    return Q.question_log(scored, ["customer"], BY_ID(), selector)


_IGS = f"""SELECT id, customer, n, round({_MENU_IG}, 6) AS g0, round(CASE WHEN f = 1 THEN greatest({_H2.format('n')} - {_H2.format('(n - 1)')} / 2, 0.0) ELSE 0.0 END, 6) AS g1, 0.0 AS g2, k FROM ({_QUESTIONS}) WHERE n_all >= 2"""


@query(
    f"""SELECT customer, row_number() OVER (PARTITION BY customer ORDER BY id) - 1 AS tick, n AS n_candidates_before, round(greatest(g0, g1, g2), 6) AS ig_bits,
    CASE WHEN g1 >= g0 AND g1 >= g2 AND (g1 > g0 OR 2 < k) THEN 'CONFIRM' WHEN g0 >= g2 AND (g0 > g2 OR k <= 2) THEN 'QUESTION' ELSE 'SUGGESTION' END AS interact_kind FROM ({_IGS})""",
    "scene_heads",
    "menus",
)
def question_log_rows(t):
    return _rounded(question_log(t).select("customer", "tick", F.col("n_candidates_before").cast("bigint").alias("n_candidates_before"), "ig_bits", "interact_kind"))


_LONG = f"""SELECT selector, round(ig_bits, 6) AS ig_bits, n FROM (SELECT n, unnest([{{'selector': 'chosen', 'ig_bits': greatest(g0, g1, g2)}}, {{'selector': 'no_rerank', 'ig_bits': g0}},
    {{'selector': 'random', 'ig_bits': (g0 + g1 + g2) / 3}}, {{'selector': 'info_gain', 'ig_bits': greatest(g0, g1, g2)}}], recursive := true) FROM ({_IGS}))"""


@query(f"SELECT selector, COUNT(*) AS n, round(AVG(ig_bits), 4) AS mean, round(MEDIAN(ig_bits), 4) AS median, round(AVG(CASE WHEN ig_bits >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS frac_ge_gate FROM ({_LONG}) GROUP BY selector", "scene_heads", "menus")
def ig_stats(t):
    return Q.ig_stats(_gains(t), ["selector"])


@query(f"SELECT selector, COUNT(*) AS n, round(AVG(ig_bits), 5) AS mean_ig FROM ({_LONG}) GROUP BY selector", "scene_heads", "menus")
def selector_compare(t):
    s = _gains(t)
    return s.groupBy("selector").agg(F.count("*").alias("n"), F.round(F.avg("ig_bits"), 5).alias("mean_ig"))


@query(f"SELECT selector, CAST(least(floor(round(least(ig_bits, 2.0) / 0.05, 9)), 39) AS INT) AS bin, COUNT(*) AS n FROM ({_LONG}) GROUP BY 1, 2", "scene_heads", "menus")
def ig_histogram(t):
    return Q.ig_histogram(_gains(t), ["selector"], multi_candidate_only=False).select("selector", "bin", "n")


@query(f"SELECT selector, bin, n, round(n / SUM(n) OVER (PARTITION BY selector) / 0.25, 6) AS density FROM (SELECT selector, CAST(floor(round(ig_bits / 0.25, 9)) AS INT) AS bin, COUNT(*) AS n FROM ({_LONG}) GROUP BY 1, 2)", "scene_heads", "menus")
def ig_density(t):
    return _rounded(Q.ig_histogram(_gains(t), ["selector"], 0.25, 4.0, density=True).select("selector", "bin", "n", "density"))


@query(f"SELECT COUNT(*) AS n, round(AVG(ig_bits), 5) AS mean_ig_bits, round(MEDIAN(ig_bits), 5) AS median_ig_bits, round(AVG(CASE WHEN ig_bits > 0 THEN 1.0 ELSE 0.0 END), 5) AS frac_gt_0 FROM ({_LONG}) WHERE selector = 'chosen' AND n > 1", "scene_heads", "menus")
def ig_overview(t):
    s = _gains(t).filter("selector = 'chosen' and n_candidates_before > 1")
    return _rounded(Q.ig_overview(s).select("n", "mean_ig_bits", "median_ig_bits", "frac_gt_0"), 5)


@query("SELECT CASE n_all WHEN 1 THEN 'CONFIRM' ELSE 'QUESTION' END AS interact_kind, COUNT(*) AS n, round(AVG(round(" + _MENU_IG + f", 6)), 5) AS mean_ig FROM ({_QUESTIONS}) GROUP BY 1", "scene_heads", "menus")
def contract_ig(t):
    contract = B.always_ask(V.scenes(t)).withColumnRenamed("pred", "gt_call")
    return Q.score_contract_ig(contract).groupBy("interact_kind").agg(F.count("*").alias("n"), F.round(F.avg("ig_bits"), 5).alias("mean_ig"))


@query("SELECT id, COUNT(*) AS questions FROM menus, (VALUES (0), (1), (2)) q(i) WHERE n >= 2 GROUP BY id", "menus")
def distinct_questions(t):
    rows = _alternatives(t).select("id", "sample_idx", "question")
    # every question is sampled twice; the copies fall together
    twice = rows.unionByName(rows.withColumn("sample_idx", F.col("sample_idx") + 3))
    return Q.distinct_questions(twice, ["id"]).groupBy("id").agg(F.count("*").alias("questions"))


# ---- layouts


@query("SELECT trial, id, label, cell, yaw, held AS is_held FROM deduped", "deduped")
def dedup_objects(t):
    return T.dedup_objects(V.layouts(t), ["trial"], V.layout_order()).select("trial", "id", "label", "cell", "yaw", "is_held")


_SIZES = "(SELECT subject, difficulty, COUNT(DISTINCT trial) AS n_trials FROM deduped GROUP BY subject, difficulty)"


def _deduped(t, *more):
    order = V.layout_order()
    return T.dedup_objects(V.layouts(t), ["trial", *more], order)


@query(
    f"""SELECT subject, difficulty, 'obj_' || row_number() OVER (PARTITION BY subject, difficulty ORDER BY cell, label) AS id, label, cell, yaw, support, n_trials FROM (
    SELECT subject, difficulty, label, cell, arg_min(yaw, trial) AS yaw, COUNT(*) AS support FROM deduped GROUP BY ALL) JOIN {_SIZES} USING (subject, difficulty) WHERE support >= 8""",
    "deduped",
)
def layout_templates(t):
    return T.template_objects(_deduped(t, "subject", "difficulty"), ["subject", "difficulty"], ["trial"], min_support=8)


@query(
    """SELECT difficulty, 'obj_' || row_number() OVER (PARTITION BY difficulty ORDER BY cell, label) AS id, label, cell, support FROM (
    SELECT difficulty, label, cell, COUNT(*) AS support FROM deduped GROUP BY ALL) JOIN (SELECT difficulty, COUNT(DISTINCT trial) AS n FROM deduped GROUP BY difficulty) USING (difficulty)
    WHERE support >= greatest(1, floor(n * 0.05))""",
    "deduped",
)
def pooled_templates(t):
    return T.template_objects(_deduped(t, "subject", "difficulty"), ["difficulty"], ["subject", "trial"], frac=0.05).select("difficulty", "id", "label", "cell", "support")


@query("SELECT subject, difficulty, cell || '/' || yaw || '/' || z AS pose, total AS n_source_trials FROM (SELECT *, SUM(n) OVER (PARTITION BY subject, difficulty)::BIGINT AS total, row_number() OVER (PARTITION BY subject, difficulty ORDER BY n DESC, first) AS rk FROM (SELECT subject, difficulty, cell, yaw, z, COUNT(*) AS n, MIN(trial) AS first FROM start_poses GROUP BY ALL)) WHERE rk = 1", "start_poses")
def start_pose_vote(t):
    v = T.template_poses(V.start_poses(t), ["subject", "difficulty"], ["trial"])
    return v.select("subject", "difficulty", F.concat_ws("/", "gripper_init.cell", "gripper_init.yaw", "gripper_init.z").alias("pose"), "n_source_trials")


_ASSISTED = "subject IN ('1-URGENT', '2-HIGH')"


@query(
    f"""SELECT subject, difficulty, COUNT(*) AS trials, CASE WHEN {_ASSISTED} THEN 'own' WHEN difficulty = 'P' THEN 'dropped' ELSE 'pooled' END AS layout,
    CASE WHEN difficulty = 'P' AND NOT ({_ASSISTED}) THEN 0 WHEN {_ASSISTED} THEN (SELECT COUNT(DISTINCT (label, cell)) FROM deduped d WHERE d.subject = s.subject AND d.difficulty = s.difficulty)
    ELSE (SELECT COUNT(*) FROM (SELECT label, cell, COUNT(*) AS c FROM deduped d WHERE d.difficulty = s.difficulty AND {_ASSISTED} GROUP BY label, cell) q
      WHERE c >= greatest(1, floor(0.05 * (SELECT COUNT(DISTINCT trial) FROM deduped d WHERE d.difficulty = s.difficulty AND {_ASSISTED})))) END AS objects
    FROM start_poses s GROUP BY subject, difficulty""",
    "deduped",
    "start_poses",
)
def template_fallback(t):
    seen = V.layouts(t).filter("subject in ('1-URGENT', '2-HIGH')")
    deduped = T.dedup_objects(seen, ["trial", "subject", "difficulty"], V.layout_order())
    poses = V.start_poses(t).filter("subject in ('1-URGENT', '2-HIGH')")
    own = T.layout_templates(deduped, poses, ["subject", "difficulty"], ["trial"])
    pooled = T.pooled_templates(deduped, poses, ["subject", "trial"], 0.05).filter("difficulty <> 'P'")
    trials = V.start_poses(t).select("trial", "subject", "difficulty")
    placed, dropped = T.inherit_layout(trials, own, pooled)
    kind = F.when(F.startswith(F.col("notes"), F.lit("template=own")), "own").otherwise("pooled")
    rows = placed.select("subject", "difficulty", kind.alias("layout"), F.size("objects").alias("objects"))
    rows = rows.unionByName(dropped.select("subject", "difficulty", F.lit("dropped").alias("layout"), F.lit(0).alias("objects")))
    return rows.groupBy("subject", "difficulty", "layout", "objects").agg(F.count("*").alias("trials"))


_CALLS = "SELECT l_orderkey AS trial, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN 'INTERACT' WHEN 1 THEN 'APPROACH' ELSE 'ALIGN_YAW' END AS tool, CASE WHEN l_tax > 0 THEN 'obj_' || (l_partkey % 9) END AS target FROM lineitem"


@query(f"SELECT trial, arg_max(target, row(l_linenumber, l_partkey, l_suppkey)) AS target FROM ({_CALLS}) WHERE tool <> 'INTERACT' AND target IS NOT NULL GROUP BY trial")
def last_target(t):
    x = t.lineitem
    calls = x.select(
        F.col("l_orderkey").alias("trial"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        V.slot(("INTERACT", "APPROACH", "ALIGN_YAW"), F.col("l_linenumber")).alias("tool_name"),
        F.when(F.col("l_tax") > 0, F.concat(F.lit("obj_"), (F.col("l_partkey") % 9).cast("string"))).alias("target_object_id"),
    )
    return T.last_target(calls, V.layout_order(), ["trial"])


@query(
    """SELECT l.trial, d.id AS target_obj_id FROM (SELECT trial, label, cell FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rk FROM layouts) WHERE rk = 1) l
    JOIN deduped d USING (trial, label, cell)""",
    "layouts",
    "deduped",
)
def remapped_targets(t):
    objects = V.layouts(t).withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey")).withColumn("id", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey"))
    last = objects.groupBy("trial").agg(F.max_by("id", "pos").alias("target"))
    return T.remap_targets(last, objects, _deduped(t), ["trial"])


# ---- scenarios


@query(
    """SELECT rule, COUNT(*) AS n, COUNT(*) AS faults FROM (SELECT unnest(list_filter([CASE WHEN n < 2 THEN 'objects.few' END, CASE WHEN id % 2 = 0 AND has = 0 THEN 'target.absent' END], lambda x: x IS NOT NULL)) AS rule
    FROM (SELECT h.id, COUNT(*) AS n, COUNT(*) FILTER (s.id = 'obj_' || (h.id % 9)) AS has FROM scene_heads h JOIN scene_rows s ON s.order_key = h.id GROUP BY h.id)) GROUP BY rule""",
    "scene_heads",
)
def scenario_rules(t):
    rows = unfold(T.scenario_violations(V.scenarios(t)), "violations", "v")
    return rows.groupBy("v.rule").agg(F.count("*").alias("n"), F.sum("v.faults").alias("faults"))


@query(
    """SELECT CAST(h.id AS VARCHAR) AS id, COUNT(*) FILTER (NOT s.is_held AND abs(s.ci // 3 - h.start // 3) + abs(s.ci % 3 - h.start % 3) <= 1) AS candidates, COUNT(*) AS objects
    FROM scene_heads h JOIN scene_rows s ON s.order_key = h.id WHERE h.id % 2 = 0 GROUP BY h.id""",
    "scene_heads",
)
def scenario_contract(t):
    rows = C.observe(T.scenarios_to_contract(V.scenarios(t), skip_unlabeled=True))
    return rows.select("id", F.col("n_cands").cast("bigint").alias("candidates"), F.size("obs.objects").cast("bigint").alias("objects"))


@query(
    """SELECT CAST(h.id AS VARCHAR) AS id, CASE WHEN s.id IS NULL THEN 1 ELSE greatest(1, abs(s.ci // 3 - h.start // 3) + abs(s.ci % 3 - h.start % 3)
    + least(abs(s.yi - h.customer % 8), 8 - abs(s.yi - h.customer % 8)) + 2 - h.id % 3 + 1) END AS path_length
    FROM scene_heads h LEFT JOIN scene_rows s ON s.order_key = h.id AND h.id % 2 = 0 AND s.id = 'obj_' || (h.id % 9)""",
    "scene_heads",
)
def path_lengths(t):
    return T.path_length(V.scenarios(t)).select(F.col("scenario_id").alias("id"), F.col("path_length").cast("bigint").alias("path_length"))


_LABELS = "SELECT l_orderkey AS sid, l_linenumber, l_partkey, l_suppkey, 'obj_' || (l_suppkey % 9) AS tgt FROM lineitem"


@query(
    f"""SELECT CAST(h.id AS VARCHAR) AS id, coalesce(a.tgt, CASE WHEN h.id % 2 = 0 THEN 'obj_' || (h.id % 9) END) AS target, CASE WHEN a.tgt IS NOT NULL THEN 'hand_label' WHEN h.id % 2 = 0 THEN 'tool_call' ELSE 'unlabeled' END AS source
    FROM scene_heads h LEFT JOIN (SELECT sid, arg_max(tgt, row(l_linenumber, l_partkey, l_suppkey)) AS tgt FROM ({_LABELS}) x JOIN scene_rows s ON s.order_key = sid AND s.id = tgt GROUP BY sid) a ON a.sid = h.id""",
    "scene_heads",
)
def label_overlay(t):
    x = t.lineitem
    text = lambda v: F.lit(v).cast("string")
    labels = x.select(
        F.col("l_orderkey").cast("string").alias("scenario_id"),
        F.concat(F.lit("obj_"), (F.col("l_suppkey") % 9).cast("string")).alias("target_obj_id"),
        text("").alias("layout_override"),
        text("").alias("notes"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("row"),
    )
    out, _ = T.overlay_labels(V.scenarios(t), labels)
    return out.select(F.col("scenario_id").alias("id"), F.col("target_obj_id").alias("target"), F.col("target_label_source").alias("source"))


@query("SELECT priority AS subject, COUNT(*) AS n FROM scene_heads WHERE id % 2 = 1 GROUP BY priority", "scene_heads")
def label_stubs(t):
    return T.label_stub(V.scenarios(t)).groupBy("subject").agg(F.count("*").alias("n"))


@query(
    """SELECT 'total' AS dim, CASE WHEN bad THEN 'invalid' ELSE 'valid' END AS key, COUNT(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'mode', 'manual', COUNT(*) FROM v WHERE NOT bad
    UNION ALL SELECT 'layout_source', 'state_snapshot', COUNT(*) FROM v WHERE NOT bad UNION ALL SELECT 'target_source', CASE WHEN id % 2 = 0 THEN 'tool_call' ELSE 'unlabeled' END AS src, COUNT(*) FROM v WHERE NOT bad GROUP BY 2
    UNION ALL SELECT 'subject_difficulty', priority || '/' || status, COUNT(*) FROM v WHERE NOT bad GROUP BY 2""".replace(
        "FROM v",
        "FROM (SELECT h.id, h.priority, h.status, COUNT(*) < 2 OR (h.id % 2 = 0 AND COUNT(*) FILTER (s.id = 'obj_' || (h.id % 9)) = 0) AS bad FROM scene_heads h JOIN scene_rows s ON s.order_key = h.id GROUP BY h.id, h.priority, h.status) v",
    ),
    "scene_heads",
)
def extraction_report(t):
    rows = V.scenarios(t)
    return T.extraction_report(rows, rows.limit(0))


@query(
    """SELECT rule, COUNT(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN id % 7 = 0 THEN 'gripper_hist length' END, CASE WHEN status = 'P' AND id % 3 = 0 THEN 'user_state.mode' END,
    CASE WHEN coalesce(n, 0) <> 1 AND id % 11 = 0 THEN 'tool call: interact_choices' END], lambda x: x IS NOT NULL)) AS rule FROM scene_heads LEFT JOIN menus USING (id)) GROUP BY rule""",
    "scene_heads",
    "menus",
)
def decision_rules(t):
    k = F.col("id")
    s = B.ask_if_ambiguous(V.scenes(t))
    asked = F.col("pred.tool") == "INTERACT"
    args = F.col("pred.args").withField("choices", F.when(asked & (k % 11 == 0), F.array().cast("array<string>")).otherwise(F.col("pred.args.choices")))
    rows = s.select(
        "id",
        k.alias("episode_id"),
        F.col("obs.objects").alias("objects"),
        F.when(k % 7 == 0, F.slice("obs.gripper_hist", 1, 5)).otherwise(F.col("obs.gripper_hist")).alias("gripper_hist"),
        F.col("obs.memory").alias("memory"),
        F.struct(F.when((F.col("status") == "P") & (k % 3 == 0), F.lit("other")).otherwise(F.col("obs.user_state.mode")).alias("mode")).alias("user_state"),
        F.col("pred").withField("args", args).alias("target_tool_call"),
    )
    return unfold(C.validate_decisions(rows), "violations", "rule").groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """SELECT h.id || '_' || h.id AS id, CASE WHEN m.n = 1 THEN 1 ELSE 0 END AS acts, coalesce(m.n, 0) AS n_cands, CASE status WHEN 'F' THEN 'translation' WHEN 'O' THEN 'rotation' ELSE 'gripper' END AS mode
    FROM scene_heads h LEFT JOIN menus m USING (id)""",
    "scene_heads",
    "menus",
)
def contract_rows(t):
    s = B.ask_if_ambiguous(V.scenes(t))
    memory = F.col("obs.memory").withField("past_dialogs", F.array().cast("array<struct<role:string,content:string>>"))
    rows = s.select(F.col("id").alias("episode_id"), F.col("id").alias("seq"), F.col("obs.objects").alias("objects"), F.col("obs.gripper_hist").alias("gripper_hist"), memory.alias("memory"), F.col("obs.user_state").alias("user_state"), F.col("pred").alias("target_tool_call"))
    ok, _ = C.validate_contract(C.to_contract(rows))
    seen = C.observe(ok)
    acts = (~F.contains("output", F.lit("INTERACT"))).cast("int")
    return seen.select("id", acts.alias("acts"), F.col("n_cands").cast("bigint").alias("n_cands"), "mode")
