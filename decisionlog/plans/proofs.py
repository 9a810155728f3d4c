"""Queries that show by content what others only count: overrides and notes of hand labels, dropped trials, labels, contexts, flat metrics, the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisionlog.functions.labels import CANONICAL, CATALOGUE, canonical_label, catalogue_label
from decisionlog.operators import contracts as C
from decisionlog.operators import evaluate as E
from decisionlog.operators import reports as R
from decisionlog.operators import trials as T
from decisionlog.plans import views as V
from decisionlog.plans.evaluation import _rounded, counted
from decisionlog.plans.registry import query

# ---- hand labels with layouts and notes

_OBJECT = '{"id":"obj_%s","label":"mug","raw_label":"mug","cell":"A1","yaw":"N","is_held":false}'
_LAYOUT = '{"objects":[' + _OBJECT + "," + _OBJECT + '],"gripper_init":{"cell":"B2","yaw":"NE","z":"LOW"}}'
_HAND = "SELECT CAST(l_orderkey AS VARCHAR) AS sid, row(l_linenumber, l_partkey, l_suppkey) AS r, 'obj_' || (l_suppkey % 9) AS tgt, l_linenumber % 3 AS kind, l_partkey % 9 AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || l_linenumber ELSE '' END AS note FROM lineitem"


def _hand_labels(t):
    """A label for each line item: a third with a layout, a third with one that can't be read, half with a note."""
    a = F.col("l_partkey") % 9
    layout = F.format_string(_LAYOUT, a.cast("string"), ((a + 1) % 9).cast("string"))
    kind = F.col("l_linenumber") % 3
    return t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("scenario_id"),
        F.concat(F.lit("obj_"), (F.col("l_suppkey") % 9).cast("string")).alias("target_obj_id"),
        F.when(kind == 1, layout).when(kind == 2, F.lit('{"objects":[')).otherwise("").alias("layout_override"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).otherwise("").alias("notes"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("row"),
    )


_FINAL = f"""x AS ({_HAND}), lay AS (SELECT sid, arg_max(a, r) AS a FROM x WHERE kind = 1 GROUP BY sid),
ids AS (SELECT sid, unnest(['obj_' || a, 'obj_' || ((a + 1) % 9)]) AS oid FROM lay UNION ALL SELECT CAST(order_key AS VARCHAR), id FROM scene_rows WHERE CAST(order_key AS VARCHAR) NOT IN (SELECT sid FROM lay)),
judged AS (SELECT x.*, CASE WHEN kind = 2 THEN 'layout not readable' WHEN NOT EXISTS (SELECT 1 FROM ids WHERE ids.sid = x.sid AND oid = tgt) THEN 'unknown target ' || tgt END AS reason FROM x)"""


@query(
    f"""SELECT * FROM (WITH {_FINAL},
    good AS (SELECT sid, arg_max(tgt, r) AS tgt, coalesce(string_agg(note, ' | ' ORDER BY r) FILTER (note <> ''), '') AS said FROM judged WHERE reason IS NULL GROUP BY sid)
    SELECT CAST(o.o_orderkey AS VARCHAR) AS id, coalesce(good.tgt, CASE WHEN o.o_orderkey % 2 = 0 THEN 'obj_' || (o.o_orderkey % 9) END) AS target,
    CASE WHEN good.tgt IS NOT NULL THEN 'hand_label' WHEN o.o_orderkey % 2 = 0 THEN 'tool_call' ELSE 'unlabeled' END AS source,
    CASE WHEN lay.a IS NULL THEN 'state_snapshot' ELSE 'hand_label' END AS layout, coalesce(said, '') AS notes,
    CASE WHEN lay.a IS NULL THEN (SELECT string_agg(id, ',' ORDER BY slot) FROM scene_rows WHERE order_key = o.o_orderkey) ELSE 'obj_' || lay.a || ',obj_' || ((lay.a + 1) % 9) END AS objects
    FROM orders o LEFT JOIN good ON good.sid = CAST(o.o_orderkey AS VARCHAR) LEFT JOIN lay ON lay.sid = CAST(o.o_orderkey AS VARCHAR))""",
    "scene_rows",
)
def hand_layouts(t):
    """J3, J4 on whole rows: targets, layouts, notes and object ids after the overlay."""
    out, _ = T.overlay_labels(V.scenarios(t), _hand_labels(t))
    ids = F.array_join(F.transform("objects", lambda o: o["id"]), ",")
    return out.select(
        F.col("scenario_id").alias("id"), F.col("target_obj_id").alias("target"), F.col("target_label_source").alias("source"), F.col("layout_source").alias("layout"),
        F.coalesce("notes", F.lit("")).alias("notes"), F.nullif(ids, F.lit("")).alias("objects"),
    )


@query(f"SELECT * FROM (WITH {_FINAL} SELECT sid AS id, reason, COUNT(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY sid, reason)", "scene_rows")
def skipped_labels(t):
    _, skipped = T.overlay_labels(V.scenarios(t), _hand_labels(t))
    return skipped.groupBy(F.col("scenario_id").alias("id"), "reason").agg(F.count("*").alias("n"))


# ---- dropped trials

_BAD = """SELECT o_orderkey AS id, o_orderpriority AS subject, o_orderstatus AS difficulty, coalesce(n, 0) < 2 OR (o_orderkey % 2 = 0 AND coalesce(has, 0) = 0) AS bad FROM orders LEFT JOIN (
    SELECT order_key, COUNT(*) AS n, COUNT(*) FILTER (id = 'obj_' || (order_key % 9)) AS has FROM scene_rows GROUP BY order_key) ON order_key = o_orderkey"""


@query(
    f"""SELECT * FROM (WITH v AS ({_BAD}), own AS (SELECT DISTINCT subject, difficulty FROM v WHERE id % 1999 = 1),
    kept AS (SELECT v.* FROM v WHERE (subject, difficulty) IN (SELECT (subject, difficulty) FROM own) OR difficulty = 'F')
    SELECT 'total' AS dim, CASE WHEN bad THEN 'invalid' ELSE 'valid' END AS key, COUNT(*) AS n FROM kept GROUP BY 2
    UNION ALL SELECT 'total', 'dropped', COUNT(*) FROM v WHERE id NOT IN (SELECT id FROM kept) HAVING COUNT(*) > 0
    UNION ALL SELECT 'mode', 'manual', COUNT(*) FROM kept WHERE NOT bad UNION ALL SELECT 'layout_source', 'state_snapshot', COUNT(*) FROM kept WHERE NOT bad
    UNION ALL SELECT 'target_source', CASE WHEN id % 2 = 0 THEN 'tool_call' ELSE 'unlabeled' END AS src, COUNT(*) FROM kept WHERE NOT bad GROUP BY 2
    UNION ALL SELECT 'subject_difficulty', subject || '/' || difficulty, COUNT(*) FROM kept WHERE NOT bad GROUP BY 2)""",
    "scene_rows",
)
def extraction_report_dropped(t):
    """A34 over every order: trials that inherit a layout (J7) are kept, the others are its dropped side."""
    rows = V.scenarios(t)
    trials = rows.select("scenario_id", "source.subject", "source.difficulty")
    number = F.col("scenario_id").cast("bigint")
    pose = rows.schema["gripper_init"].dataType
    own = rows.filter(number % 1999 == 1).groupBy("source.subject", "source.difficulty").agg(
        F.min_by("objects", number).alias("objects"), F.min_by("gripper_init", number).cast(pose).alias("gripper_init"), F.count("*").alias("n_source_trials")
    )
    pooled = rows.filter("source.difficulty = 'F'").groupBy("source.difficulty").agg(
        F.min_by("objects", number).alias("objects"), F.min_by("gripper_init", number).alias("gripper_init"), F.count("*").alias("n_source_trials")
    )
    placed, dropped = T.inherit_layout(trials, own, pooled)
    return T.extraction_report(rows.join(placed.select("scenario_id"), "scenario_id", "left_semi"), dropped)


# ---- labels and contexts


def _sql_map(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {key} END"


_NAMES = sorted(CANONICAL)
_RAW = f"CASE p_partkey % 3 WHEN 0 THEN ' ' || upper(n) || ' ' WHEN 1 THEN n ELSE lower(p_name) END"
_CANON = f"SELECT p_partkey, {_sql_map(CANONICAL, 'lower(trim(raw))')} AS label FROM (SELECT p_partkey, {_RAW} AS raw FROM (SELECT *, {str(_NAMES)}[p_partkey % {len(_NAMES)} + 1] AS n FROM part))"


@query(f"SELECT p_partkey AS id, label, {_sql_map(CATALOGUE, 'label')} AS catalogue FROM ({_CANON})")
def canonical_labels(t):
    """Aliases in any case, with blanks, and names that are no label."""
    n = V.slot(_NAMES, F.col("p_partkey"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.upper(n), F.lit(" "))).when(F.col("p_partkey") % 3 == 1, n).otherwise(F.lower("p_name"))
    label = canonical_label(raw)
    return t.part.select(F.col("p_partkey").alias("id"), label.alias("label"), catalogue_label(label).alias("catalogue"))


@query(
    """SELECT event_id AS id, CASE k % 7 WHEN 0 THEN 'no_context' WHEN 1 THEN 'no_memory' WHEN 2 THEN 'invalid_input_json' WHEN 3 THEN event_type WHEN 4 THEN 'unknown' WHEN 5 THEN 'no_context' ELSE 'unknown' END AS context,
    CASE k % 7 WHEN 0 THEN 'no_last_prompt' WHEN 1 THEN 'no_memory' WHEN 2 THEN 'invalid_input_json' WHEN 3 THEN event_type WHEN 4 THEN 'unknown' WHEN 5 THEN 'no_context' ELSE 'unknown' END AS online FROM ev""",
    "ev",
)
def context_buckets(t):
    """X7, offline and online."""
    prompt = lambda kind: F.concat(F.lit('{"memory":{"last_prompt":{"kind":"x","context":{"type":"'), kind, F.lit('"}}}}'))
    forms = [F.lit('{"memory":{"n_interactions":0}}'), F.lit("{}"), F.lit("{]"), prompt(F.col("event_type")), prompt(F.lit(" ")), F.lit('{"memory":{"last_prompt":{"kind":"x"}}}'), F.lit('{"memory":{"last_prompt":{"context":{"obj_id":"o1"}}}}')]
    rows = V.events(t)
    text = forms[-1]
    for i in reversed(range(6)):
        text = F.when(F.col("k") % 7 == i, forms[i]).otherwise(text)
    rows = rows.select(F.col("event_id").alias("id"), text.alias("input"))
    offline = C.observe(rows).select("id", "input", "context")
    return C.observe(offline.withColumnRenamed("context", "offline"), online=True).select("id", F.col("offline").alias("context"), F.col("context").alias("online"))


# ---- result cells


def _cells(t):
    """A cell per (mode, context): its rates, with metadata on some."""
    report = E.accuracy_report(counted(t, "mode", "context"), ["mode", "context"])
    n, odd = F.col("n"), F.substring("context", -1, 1).cast("int") % 2 == 1
    return report.select(
        F.col("mode").alias("_model_safe"), F.when(odd, F.upper("mode")).alias("_display"), F.lit("trained").alias("_group"), F.col("context").alias("_eval_set"), F.lit("pouring").alias("_env"),
        F.lit("plain").alias("_flavor"), "n", "tool_accuracy", "schema_valid_rate", "strict_exact_rate", "motion_obj_accuracy", "interact_kind_accuracy",
        F.when(odd, F.struct((n / 7.0).alias("examples_per_sec"))).alias("timing"),
        F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.concat(F.lit("/m/"), "mode").alias("model_path")).alias("model"),
    )


_RATE = "round(CASE WHEN {1} > 0 THEN CAST(SUM({0}) AS DOUBLE) / {1} ELSE 0.0 END, 4) AS {2}"
_SUMS = [("tool_correct", "COUNT(*)", "tool_accuracy"), ("schema_valid", "COUNT(*)", "schema_valid_rate"), ("strict_exact", "COUNT(*)", "strict_exact_rate"), ("motion_obj_correct", "SUM(motion_n)", "motion_obj_accuracy"), ("interact_kind_correct", "SUM(interact_n)", "interact_kind_accuracy")]


@query(
    f"""SELECT mode AS model_safe, CASE WHEN odd THEN upper(mode) END AS model_display, 'trained' AS "group", context AS eval_set, 'pouring' AS env, 'plain' AS flavor, COUNT(*) AS n,
    {", ".join(_RATE.format(*s) for s in _SUMS)}, round(CASE WHEN odd THEN COUNT(*) / 7.0 ELSE 0.0 END, 2) AS examples_per_sec
    FROM (SELECT *, CAST(right(context, 1) AS INT) % 2 = 1 AS odd FROM scored) GROUP BY mode, context, odd""",
    "scored",
)
def flat_metrics(t):
    """A21."""
    return _rounded(R.flat_metrics(_cells(t)), 4)


@query(
    """SELECT mode AS model, context AS eval_set, CASE WHEN mode = 'rotation' THEN 'Turns' WHEN CAST(right(context, 1) AS INT) % 2 = 1 THEN upper(mode) ELSE mode END AS model_display,
    CASE WHEN mode = 'rotation' THEN 'rule' ELSE 'llm' END AS model_kind, '/m/' || mode AS model_path, CASE WHEN mode = 'rotation' THEN 'base' ELSE 'trained' END AS model_group,
    CASE WHEN context = 'ctx_3' THEN 'cube_stacking' ELSE 'pouring' END AS eval_env, CASE WHEN context = 'ctx_3' THEN 'hard' ELSE 'plain' END AS eval_flavor,
    CASE WHEN context = 'ctx_3' THEN 'Third' ELSE context END AS eval_display FROM scored GROUP BY mode, context""",
    "scored",
)
def resolved_registry(t):
    """One model and one evaluation set are registered; the other cells speak for themselves."""
    models = t.spark.createDataFrame([("rotation", "Turns", "rule", None, "base")], "safe_name string, display string, kind string, model_path string, group string")
    sets = t.spark.createDataFrame([("ctx_3", "cube_stacking", "hard", "Third")], "name string, env string, flavor string, display string")
    found = R.resolve_registry(_cells(t), models, sets)
    return found.select(F.col("_model_safe").alias("model"), F.col("_eval_set").alias("eval_set"), "model_display", "model_kind", "model_path", "model_group", "eval_env", "eval_flavor", "eval_display")
