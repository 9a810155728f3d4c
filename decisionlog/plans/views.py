"""Role views: the benchmark tables read as decision logs.

Each view derives the columns an operator family needs from a whole table, row by row or by a bounded aggregate. ``CTES``
holds the same views as SQL for the oracle.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decisionlog.functions.bind import once
from decisionlog.functions.geometry import CELLS, YAW_BINS, literal_array
from decisionlog.operators.ordered import Order, balanced, by_number, by_time, epoch_seconds
from decisionlog.operators.perturb import near_candidates
from decisionlog.schemas import OBJECT_LABELS

USER = ["user_id"]
TOOL_BY_EVENT = {"signup": "INTERACT", "view": "APPROACH", "click": "ALIGN_YAW", "purchase": "STACK", "error": "APPROACH"}
TOOL_BY_LINE = ("INTERACT", "APPROACH", "ALIGN_YAW", "STACK", "GRAB", "POUR", "INTERACT", "WAIT")
ENV_BY_FLAG = {"R": "reach_to_grasp_ycb", "A": "cube_stacking", "N": "pouring"}


class Tables:
    """The benchmark tables of one directory."""

    furnished = False

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


class Spread(Tables):
    """The same with the events dealt out by rows: their file is small for the work on a row, and a scan's tasks go by bytes."""

    @property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/events.parquet").repartition("event_id", "ts")


class Furnished(Tables):
    """The same where scenes are of orders with line items only, as some of the oracle SQL has them."""

    furnished = True


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def slot(values, index: Column) -> Column:
    """``values[index mod n]``."""
    return F.get(literal_array(values), F.pmod(index, F.lit(len(values))).cast("int"))


def event_order(width_seconds: int = 86_400) -> Order:
    return by_time("ts", "event_id", width_seconds=width_seconds)


#: rows of one user and day that a task takes at once; more are cut at their quantiles
CROWD = 20_000
_orders: dict[tuple[str, str], Order] = {}


def user_order(t: Tables) -> Order:
    """The events' order per user, crowded days cut again; the histogram is taken once per session and table."""
    key = (t.spark.sparkContext.applicationId, t.directory)
    if key not in _orders:
        if not t.spark.sparkContext.getCheckpointDir():
            t.spark.sparkContext.setCheckpointDir(shared_folder(t.spark))
        _orders[key] = balanced(t.events, USER, event_order(), CROWD)
    return _orders[key]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint directory; a folder of this machine only under a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="decisionlog-")
    return f"{base.rstrip('/')}/decisionlog-{uuid.uuid4().hex}"


def events(t: Tables) -> DataFrame:
    """Events with ``k`` (0..99) from their properties and the stamp in seconds."""
    e = t.events
    return e.select("event_id", "user_id", "event_type", "ts", "value", "props", F.get_json_object("props", "$.k").cast("int").alias("k"), epoch_seconds(F.col("ts")).alias("stamp"))


def _call_text(tool: Column | str, obj: Column) -> Column:
    return F.concat(F.lit('{"tool":"'), tool if isinstance(tool, Column) else F.lit(tool), F.lit('","args":{"obj":"o'), obj.cast("string"), F.lit('"}}'))


def logged_calls(t: Tables) -> DataFrame:
    """True calls and raw model answers as text, with context, mode and candidate count.

    Answers are right, wrong, mis-spelled, wrapped in chatter, cut short or no object at all, by ``k``.
    """
    e = events(t)
    k, kind = F.col("k"), F.col("event_type")
    ask = F.concat(F.lit('{"tool":"INTERACT","args":{"kind":"QUESTION","text":"'), k.cast("string"), F.lit('","choices":["1) YES","2) NO"]}}'))
    obj = k % 5
    truth = (
        F.when(kind == "signup", ask)
        .when((kind == "error") & (k % 3 == 0), F.lit('{"tool":'))
        .when(kind == "error", _call_text("APPROACH", k % 3))
        .otherwise(_call_text(lookup(TOOL_BY_EVENT, kind), obj))
    )
    many = '{"tool":"INTERACT","args":{"kind":"QUESTION","text":"t","choices":["1) a","2) b","3) c","4) d","5) e","6) f"]}}'
    same = F.when(kind == "signup", F.lit('{"args":{"choices":["1) YES","2) NO"],"text":"other words","kind":"QUESTION"},"tool":"INTERACT"}')).otherwise(truth)
    near = F.when(kind == "signup", F.lit('{"tool":"INTERACT","args":{"kind":"CONFIRM","text":"","choices":["1) YES"]}}')).otherwise(
        _call_text(lookup(TOOL_BY_EVENT, kind), (k + 1) % 5)
    )
    answers = [
        F.lit('{"tool":"INTERACT"'),
        F.lit('ok {"tool":" approach ","args":{"obj":"o1","why":"near"}} done'),
        F.lit('{"tool":"DANCE","args":{}}'),
        F.lit(many),
        F.lit('{"tool":"interact","args":{"type":"confirm","choices":["1) YES","2) NO"]}}'),
        F.lit("[1,2]"),
        same,
        _call_text("APPROACH", obj),
        near,
        _call_text("ALIGN_YAW", obj),
    ]
    raw = answers[-1]
    for i in reversed(range(9)):
        raw = F.when(k % 10 == i, answers[i]).otherwise(raw)
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        "ts",
        "event_id",
        "event_type",
        "k",
        truth.alias("output"),
        raw.alias("raw"),
        F.concat(F.lit("ctx_"), (k % 7).cast("string")).alias("context"),
        slot(("translation", "rotation", "gripper"), k).alias("mode"),
        (k % 9).alias("n_cands"),
    )


def ticks(t: Tables) -> DataFrame:
    """Decision ticks per user: tool, prompt text and candidate set."""
    e = events(t)
    k = F.col("k")
    tool = lookup(TOOL_BY_EVENT, F.col("event_type"))
    return e.select(
        "event_id",
        "user_id",
        "ts",
        "value",
        "k",
        tool.alias("tool"),
        F.when(tool == "INTERACT", F.concat(F.lit("q"), (k % 3).cast("string"))).alias("prompt"),
        F.array(F.concat(F.lit("o"), (k % 2).cast("string")), F.concat(F.lit("o"), F.floor(k / 50).cast("string"))).alias("candidates"),
    )


def commands(t: Tables) -> DataFrame:
    """Control commands of users: moves, turns, gripper actions and releases."""
    e = events(t)
    k, kind = F.col("k"), F.col("event_type")
    turned = (kind == "view") | ((kind == "error") & (k % 2 == 1))
    typed = F.when(kind.isin("click", "view"), "cartesian_velocity").when(kind == "purchase", "gripper").when(kind == "error", "stop").otherwise("mode_change")
    return e.select(
        "event_id",
        "user_id",
        "ts",
        typed.alias("type"),
        F.when(kind == "purchase", "gripper").when(turned, "rotation").otherwise("translation").alias("command_mode"),
        F.when(turned, "z").otherwise("x").alias("axis"),
        (k % 3 - 1).alias("direction"),
        kind.isin("click", "view").alias("active"),
        F.when(kind == "error", "release").alias("reason"),
        "stamp",
        (k % 4).alias("reply_idx"),
        F.lit(4).alias("n_choices"),
    )


def poses(t: Tables) -> DataFrame:
    """Gripper poses of users."""
    e = events(t)
    k = F.col("k")
    return e.select(
        "event_id",
        "user_id",
        "ts",
        F.when(k % 4 == 0, "A2").otherwise("A1").alias("cell"),
        F.when(k % 2 == 0, "N").otherwise("NE").alias("yaw"),
        F.when(k % 3 == 0, "LOW").otherwise("HIGH").alias("z"),
    )


def examples(t: Tables) -> DataFrame:
    """Training examples: one per line item, with environment, tool, split, source and context."""
    x = t.lineitem
    row_id = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    taxed = F.round(F.col("l_tax") * 100).cast("int")
    return x.select(
        row_id.alias("id"),
        slot(TOOL_BY_LINE, F.col("l_linenumber")).alias("tool"),
        lookup(ENV_BY_FLAG, F.col("l_returnflag")).alias("env"),
        F.when(F.col("l_linestatus") == "F", "valid").otherwise("train").alias("split"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 10).cast("string")).alias("source"),
        F.when(taxed > 0, F.concat(F.lit("tax_"), taxed.cast("string"))).alias("context"),
        slot(("translation", "rotation", "gripper"), F.col("l_partkey")).alias("mode"),
        F.col("l_orderkey").alias("order_key"),
    )


def scene_rows(t: Tables) -> DataFrame:
    """Objects of each order's scene: every line item, numbered along the whole order (an order has a few)."""
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return t.lineitem.withColumn("slot", F.row_number().over(along) - 1).select(
        F.col("l_orderkey").alias("order_key"),
        "slot",
        F.concat(F.lit("obj_"), F.col("slot").cast("string")).alias("id"),
        slot(OBJECT_LABELS, F.col("l_suppkey")).alias("label"),
        slot(CELLS, F.col("l_partkey")).alias("cell"),
        slot(YAW_BINS, F.col("l_partkey")).alias("yaw"),
        ((F.col("l_returnflag") == "R") & (F.col("slot") == 1)).alias("is_held"),
    )


def scenes(t: Tables) -> DataFrame:
    """One observation per order: its scene, empty without line items, six poses, candidates within two steps, excluded ids and user mode."""
    item = F.struct("id", "label", "cell", "yaw", "is_held")
    objects = scene_rows(t).groupBy("order_key").agg(F.array_sort(F.collect_list(F.struct("slot", item.alias("o")))).alias("_o"))
    objects = objects.select("order_key", F.transform("_o", lambda x: x["o"]).alias("objects"))
    o = t.orders.select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")
    )
    c, k = F.col("customer"), F.col("order_key")
    pose = lambda i: F.struct(slot(CELLS, c + i * (k % 4)).alias("cell"), slot(YAW_BINS, c + i).alias("yaw"), slot(("HIGH", "MID", "LOW"), k).alias("z"))
    rows = o.join(objects, "order_key", "inner" if t.furnished else "left")
    # policies and questions read these many times over
    rows = once(rows, {"objects": F.coalesce("objects", F.array().cast(objects.schema["objects"].dataType)), "gripper_hist": F.array(*[pose(i) for i in range(6)])})
    rows = once(rows, {"_near": near_candidates(F.col("objects"), F.get("gripper_hist", F.lit(5))["cell"], 2)})
    gone = F.when(k % 5 == 0, F.array(F.lit("obj_1"))).otherwise(F.array().cast("array<string>"))
    mode = F.when(F.col("status") == "F", "translation").when(F.col("status") == "O", "rotation").otherwise("gripper")
    memory = F.struct(F.col("_near").alias("candidates"), gone.alias("excluded_obj_ids"))
    obs = F.struct("objects", "gripper_hist", memory.alias("memory"), F.struct(mode.alias("mode")).alias("user_state"))
    return rows.select(k.alias("id"), "customer", "status", "priority", obs.alias("obs"))


def layouts(t: Tables) -> DataFrame:
    """Detected objects of trials: order = trial, priority = subject, status = difficulty."""
    x = t.lineitem.select(
        F.col("l_orderkey").alias("trial"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        slot(OBJECT_LABELS, F.col("l_linenumber")).alias("label"),
        slot(CELLS, F.col("l_partkey")).alias("cell"),
        (F.col("l_suppkey") % 7).cast("double").alias("yaw"),
        (F.col("l_returnflag") == "R").alias("is_held"),
    )
    o = t.orders.select(F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("difficulty"))
    return x.join(o, "trial")


def layout_order() -> Order:
    return by_number("l_linenumber", "l_partkey", "l_suppkey", size=1)


def start_poses(t: Tables) -> DataFrame:
    """Start poses of trials."""
    o = t.orders
    return o.select(
        F.col("o_orderkey").alias("trial"),
        F.col("o_orderpriority").alias("subject"),
        F.col("o_orderstatus").alias("difficulty"),
        slot(CELLS, F.col("o_custkey")).alias("cell"),
        slot(YAW_BINS, F.col("o_custkey")).alias("yaw"),
        slot(("HIGH", "MID", "LOW"), F.col("o_custkey")).alias("z"),
    )


def scenarios(t: Tables) -> DataFrame:
    """Scenario rows of orders: the scene at rest; a target on every other order, some of them unknown objects."""
    s = scenes(t)
    k = F.col("id")
    target = F.when(k % 2 == 0, F.concat(F.lit("obj_"), (k % 9).cast("string")))
    free = F.transform(F.filter("obs.objects", lambda o: ~o["is_held"]), lambda o: o["id"])
    return s.select(
        k.cast("string").alias("scenario_id"),
        F.struct(F.lit("manual").alias("mode"), F.col("priority").alias("subject"), F.col("status").alias("difficulty"), k.cast("string").alias("trial_id"), F.lit("").alias("trial_dir")).alias("source"),
        F.transform("obs.objects", lambda o: F.struct(o["id"].alias("id"), o["label"].alias("label"), o["label"].alias("raw_label"), o["cell"].alias("cell"), o["yaw"].alias("yaw"), o["is_held"].alias("is_held"))).alias("objects"),
        F.get("obs.gripper_hist", F.lit(0)).alias("gripper_init"),
        target.alias("target_obj_id"),
        F.when(target.isNull(), "unlabeled").otherwise("tool_call").alias("target_label_source"),
        F.lit("state_snapshot").alias("layout_source"),
        F.col("status").alias("difficulty"),
        free.alias("plausible_target_ids"),
        F.lit("").alias("notes"),
    )


def turns(t: Tables) -> DataFrame:
    """Dialogue turns; what was said is reduced to a few prompts and replies by text length."""
    c = t.conversations
    n = F.length("text")
    reply = slot(("YES", "NO", "None of them", "ok", "APPROACH"), n)
    said = F.when(F.col("role") == "user", F.when(n % 7 == 0, reply).otherwise(F.when(n % 2 == 0, "yes").otherwise(" no"))).otherwise(
        F.concat(F.lit("p"), (n % 2).cast("string"))
    )
    return c.select("conv_id", "turn", "role", "text", said.alias("content"), slot(("confirm", "help", "candidate_choice"), F.col("turn")).alias("context"))


def said(t: Tables) -> DataFrame:
    """Dialogue turns with what was said as it stands."""
    c = t.conversations
    return c.select("conv_id", "turn", "role", F.col("text").alias("content"), slot(("confirm", "help", "candidate_choice"), F.col("turn")).alias("context"))


def turn_order() -> Order:
    return by_number("turn", size=1_000_000)


RATERS = ("quality", "toxic", "length")


def ratings(t: Tables) -> DataFrame:
    """Three raters per labelled document."""
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    length = (F.col("n_chars") % 2).cast("int")
    each = F.array(*[F.struct(F.lit(r).alias("rater"), c.alias("label")) for r, c in zip(RATERS, (F.col("quality"), F.col("toxic"), length))])
    return rows.select("doc_id", F.explode(each).alias("_r")).select("doc_id", "_r.*", F.lit(0).alias("seq"))


def rollouts(t: Tables) -> DataFrame:
    """Rollout results: one per line item."""
    x = t.lineitem
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    return x.select(
        F.col("l_orderkey").cast("string").alias("scenario_id"),
        F.when(F.col("l_linestatus") == "O", "assisted").otherwise("manual").alias("mode"),
        F.col("l_returnflag").alias("condition"),
        F.when(n % 2 == 0, "easy").otherwise("hard").alias("difficulty"),
        ((n + p) % 3 > 0).cast("int").alias("success"),
        (F.col("l_extendedprice") / 1000).alias("completion_time_sec"),
        F.col("l_quantity").cast("int").alias("total_inputs"),
        (p % 6).cast("int").alias("interactions"),
        (p % 4).cast("int").alias("dropped_inputs"),
        (p % 5).cast("int").alias("direction_reversals"),
        (p % 7).cast("int").alias("motion_tool_calls"),
        (p % 11 == 0).cast("int").alias("target_filtered_out"),
        (p % 13 == 0).cast("int").alias("terminated_at_max_ticks"),
        F.concat(F.lit("model"), (F.col("l_suppkey") % 4).cast("string"), F.lit("__"), slot(("random", "info_gain"), F.col("l_suppkey"))).alias("cell"),
    )


def cells(t: Tables) -> DataFrame:
    """Result cells: accuracy per (model, evaluation set) of rollouts."""
    sets = {"RO": "oracle_valid_ycb", "AO": "oracle_valid_stacking", "NO": "oracle_valid_pouring", "RF": "ambiguous_ycb", "AF": "ambiguous_stacking", "NF": "ambiguous_pouring"}
    x = t.lineitem.select(
        slot(("oracle_lora", "woz_lora", "oracle_woz_lora"), F.col("l_suppkey")).alias("_model_safe"),
        lookup(sets, F.concat("l_returnflag", "l_linestatus")).alias("_eval_set"),
        ((F.col("l_linenumber") + F.col("l_partkey")) % 3 > 0).cast("int").alias("_ok"),
        "l_quantity",
    )
    g = x.groupBy("_model_safe", "_eval_set").agg(F.count("*").alias("n"), F.avg("_ok").alias("tool_accuracy"), F.avg("l_quantity").alias("_eps"))
    return g.select("*", F.struct(F.col("_eps").alias("examples_per_sec")).alias("timing"))


# ---- the same views for the oracle -------------------------------------------------------------------------------

_LIST = lambda values: "[" + ",".join(f"'{v}'" for v in values) + "]"


def sql_slot(values, index: str) -> str:
    return f"{_LIST(values)}[CAST(({index}) % {len(values)} AS INT) + 1]"


_TOOL = "CASE event_type WHEN 'signup' THEN 'INTERACT' WHEN 'click' THEN 'ALIGN_YAW' WHEN 'purchase' THEN 'STACK' ELSE 'APPROACH' END"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        "SELECT event_id, user_id, event_type, ts, value, props, CAST(json_extract_string(props, '$.k') AS INT) AS k,"
        " epoch_us(ts) / 1000000.0 AS stamp FROM events",
    ),
    "judged": (
        ("ev",),
        f"""SELECT *, k % 10 AS r, NOT (event_type = 'error' AND k % 3 = 0) AS gt_ok, {_TOOL} AS gt_tool,
        CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN k % 3 ELSE k % 5 END AS gt_obj,
        'ctx_' || (k % 7) AS context, {sql_slot(('translation', 'rotation', 'gripper'), 'k')} AS mode, k % 9 AS n_cands FROM ev""",
    ),
    "answered": (
        ("judged",),
        """SELECT *, gt_ok AND r NOT IN (0, 5) AS ok,
        CASE r WHEN 1 THEN 'APPROACH' WHEN 2 THEN 'DANCE' WHEN 3 THEN 'INTERACT' WHEN 4 THEN 'INTERACT' WHEN 7 THEN 'APPROACH'
          WHEN 9 THEN 'ALIGN_YAW' ELSE gt_tool END AS pred_tool,
        CASE WHEN r = 1 THEN 1 WHEN r IN (7, 9) THEN k % 5 WHEN r = 6 THEN gt_obj
          WHEN r = 8 AND event_type <> 'signup' THEN (k + 1) % 5 END AS pred_obj,
        CASE WHEN r IN (3, 6) THEN 'QUESTION' ELSE 'CONFIRM' END AS pred_kind,
        CASE WHEN r = 3 THEN 6 WHEN r IN (4, 6) THEN 2 WHEN r = 8 AND event_type = 'signup' THEN 1 ELSE 0 END AS pred_choices FROM judged""",
    ),
    "scored": (
        ("answered",),
        """SELECT *, CASE WHEN ok THEN 1 ELSE 0 END AS json_valid,
        CASE WHEN gt_ok AND r IN (0, 5) THEN 1 ELSE 0 END AS json_errors,
        CASE WHEN ok AND r NOT IN (2, 3) THEN 1 ELSE 0 END AS schema_valid,
        CASE WHEN ok AND r IN (2, 3) THEN 1 ELSE 0 END AS schema_errors,
        CASE WHEN ok AND gt_tool = pred_tool THEN 1 ELSE 0 END AS tool_correct,
        CASE WHEN ok AND gt_tool <> pred_tool THEN 1 ELSE 0 END AS tool_wrong,
        CASE WHEN ok AND gt_tool IN ('APPROACH', 'ALIGN_YAW') THEN 1 ELSE 0 END AS motion_n,
        CASE WHEN ok AND gt_tool IN ('APPROACH', 'ALIGN_YAW') AND pred_tool IN ('APPROACH', 'ALIGN_YAW') THEN 1 ELSE 0 END AS motion_both_n,
        CASE WHEN ok AND gt_tool IN ('APPROACH', 'ALIGN_YAW') AND pred_tool IN ('APPROACH', 'ALIGN_YAW') AND gt_obj = pred_obj THEN 1 ELSE 0 END AS motion_obj_correct,
        CASE WHEN ok AND gt_tool IN ('APPROACH', 'ALIGN_YAW') AND gt_tool = pred_tool THEN 1 ELSE 0 END AS motion_tool_correct,
        CASE WHEN ok AND gt_tool = 'INTERACT' THEN 1 ELSE 0 END AS interact_n,
        CASE WHEN ok AND gt_tool = 'INTERACT' AND r IN (3, 6) THEN 1 ELSE 0 END AS interact_kind_correct,
        CASE WHEN ok AND gt_tool = 'INTERACT' AND pred_choices <= 5 THEN 1 ELSE 0 END AS interact_choices_valid,
        CASE WHEN ok AND gt_tool = 'INTERACT' AND r = 6 THEN 1 WHEN ok AND gt_tool <> 'INTERACT' AND gt_tool = pred_tool AND gt_obj = pred_obj THEN 1 ELSE 0 END AS strict_exact
        FROM answered""",
    ),
    "ticks": (
        ("ev",),
        f"SELECT *, {_TOOL} AS tool, CASE WHEN event_type = 'signup' THEN 'q' || (k % 3) END AS prompt, 'o' || (k % 2) AS c1, 'o' || (k // 50) AS c2 FROM ev",
    ),
    "commands": (
        ("ev",),
        """SELECT event_id, user_id, ts, stamp, k,
        CASE WHEN event_type IN ('click', 'view') THEN 'cartesian_velocity' WHEN event_type = 'purchase' THEN 'gripper'
          WHEN event_type = 'error' THEN 'stop' ELSE 'mode_change' END AS type,
        CASE WHEN event_type = 'purchase' THEN 'gripper' WHEN event_type = 'view' OR (event_type = 'error' AND k % 2 = 1) THEN 'rotation' ELSE 'translation' END AS mode,
        CASE WHEN event_type = 'view' OR (event_type = 'error' AND k % 2 = 1) THEN 'z' ELSE 'x' END AS axis, k % 3 - 1 AS direction FROM ev""",
    ),
    "poses": (
        ("ev",),
        """SELECT event_id, user_id, ts, CASE WHEN k % 4 = 0 THEN 'A2' ELSE 'A1' END AS cell, CASE WHEN k % 2 = 0 THEN 'N' ELSE 'NE' END AS yaw,
        CASE WHEN k % 3 = 0 THEN 'LOW' ELSE 'HIGH' END AS z FROM ev""",
    ),
    "examples": (
        (),
        f"""SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
        {sql_slot(TOOL_BY_LINE, 'l_linenumber')} AS tool,
        CASE l_returnflag WHEN 'R' THEN 'reach_to_grasp_ycb' WHEN 'A' THEN 'cube_stacking' ELSE 'pouring' END AS env,
        CASE l_linestatus WHEN 'F' THEN 'valid' ELSE 'train' END AS split, 'src' || (l_suppkey % 10) AS source,
        CASE WHEN round(l_tax * 100) > 0 THEN 'tax_' || CAST(round(l_tax * 100) AS INT) END AS context,
        {sql_slot(('translation', 'rotation', 'gripper'), 'l_partkey')} AS mode FROM lineitem""",
    ),
    "scene_rows": (
        (),
        f"""SELECT l_orderkey AS order_key, slot, 'obj_' || slot AS id, {sql_slot(OBJECT_LABELS, 'l_suppkey')} AS label,
        l_partkey % 9 AS ci, l_partkey % 8 AS yi, l_returnflag = 'R' AND slot = 1 AS is_held FROM (SELECT *,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS slot FROM lineitem)""",
    ),
    "scene_heads": (
        ("scene_rows",),
        """SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, o_orderpriority AS priority,
        (o_custkey + 5 * (o_orderkey % 4)) % 9 AS cur, (o_custkey + 4 * (o_orderkey % 4)) % 9 AS prev, o_custkey % 9 AS start,
        o_orderstatus IN ('F', 'P') AS near FROM orders WHERE o_orderkey IN (SELECT order_key FROM scene_rows)""",
    ),
    "seen": (
        ("scene_rows", "scene_heads"),
        """SELECT h.*, s.slot, s.id AS oid, s.label, s.ci, s.yi, s.is_held,
        abs(s.ci // 3 - h.cur // 3) + abs(s.ci % 3 - h.cur % 3) AS d_cur,
        abs(s.ci // 3 - h.prev // 3) + abs(s.ci % 3 - h.prev % 3) AS d_prev,
        abs(s.ci // 3 - h.start // 3) + abs(s.ci % 3 - h.start % 3) AS d_start
        FROM scene_heads h JOIN scene_rows s ON s.order_key = h.id""",
    ),
    "cands": (("seen",), "SELECT * FROM seen WHERE d_cur <= 2 AND NOT is_held"),
    "menus": (
        ("cands",),
        """SELECT id, count(*) AS n, min_by(oid, slot) AS first_id, min_by(label, slot) AS first_label,
        list(label ORDER BY slot)[1:4] AS shown FROM cands GROUP BY id""",
    ),
    "layouts": (
        (),
        f"""SELECT l_orderkey AS trial, o_orderpriority AS subject, o_orderstatus AS difficulty, {sql_slot(OBJECT_LABELS, 'l_linenumber')} AS label,
        {sql_slot(CELLS, 'l_partkey')} AS cell, CAST(l_suppkey % 7 AS DOUBLE) AS yaw, l_returnflag = 'R' AS is_held, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    ),
    "deduped": (
        ("layouts",),
        """SELECT *, 'obj_' || row_number() OVER (PARTITION BY trial ORDER BY l_linenumber, l_partkey, l_suppkey) AS id FROM (
        SELECT *, row_number() OVER w AS rn, bool_or(is_held) OVER (PARTITION BY trial, label, cell) AS held FROM layouts
        WINDOW w AS (PARTITION BY trial, label, cell ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE rn = 1""",
    ),
    "start_poses": (
        (),
        f"""SELECT o_orderkey AS trial, o_orderpriority AS subject, o_orderstatus AS difficulty, {sql_slot(CELLS, 'o_custkey')} AS cell,
        {sql_slot(YAW_BINS, 'o_custkey')} AS yaw, {sql_slot(('HIGH', 'MID', 'LOW'), 'o_custkey')} AS z FROM orders""",
    ),
    "turns": (
        (),
        f"""SELECT conv_id, turn, role, text, {sql_slot(('confirm', 'help', 'candidate_choice'), 'turn')} AS context,
        CASE WHEN role = 'user' THEN CASE WHEN length(text) % 7 = 0 THEN {sql_slot(('YES', 'NO', 'None of them', 'ok', 'APPROACH'), 'length(text)')}
          WHEN length(text) % 2 = 0 THEN 'yes' ELSE ' no' END ELSE 'p' || (length(text) % 2) END AS content FROM conversations""",
    ),
    "said": (
        (),
        f"""SELECT conv_id, turn, role, text AS content, {sql_slot(('confirm', 'help', 'candidate_choice'), 'turn')} AS context FROM conversations""",
    ),
    "ratings": (
        (),
        "SELECT doc_id, quality AS a, toxic AS b, CAST(n_chars % 2 AS INT) AS c FROM labels JOIN documents USING (doc_id)",
    ),
    "rollouts": (
        (),
        f"""SELECT CASE l_linestatus WHEN 'O' THEN 'assisted' ELSE 'manual' END AS mode, l_returnflag AS condition,
        CASE WHEN l_linenumber % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty,
        CASE WHEN (l_linenumber + l_partkey) % 3 > 0 THEN 1 ELSE 0 END AS success, l_extendedprice / 1000 AS t, CAST(l_quantity AS INT) AS inputs,
        l_partkey % 6 AS interactions, l_partkey % 4 AS dropped, l_partkey % 5 AS reversals, l_partkey % 7 AS motions,
        CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS filtered, CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS maxed,
        'model' || (l_suppkey % 4) || '__' || {sql_slot(('random', 'info_gain'), 'l_suppkey')} AS cell FROM lineitem""",
    ),
    "summary": (
        ("rollouts",),
        """SELECT mode, condition, difficulty, count(*) AS n_rollouts, round(avg(CAST(success AS DOUBLE)), 4) AS success_rate,
        round(coalesce(avg(CASE WHEN success = 1 THEN t END), 0), 3) AS mean_completion_time_sec,
        round(coalesce(stddev_samp(CASE WHEN success = 1 THEN t END), 0), 3) AS std_completion_time_sec,
        round(coalesce(avg(CASE WHEN success = 1 THEN inputs END), 0), 2) AS mean_total_inputs,
        round(coalesce(stddev_samp(CASE WHEN success = 1 THEN inputs END), 0), 2) AS std_total_inputs,
        round(avg(interactions), 2) AS mean_interactions, round(avg(dropped), 2) AS mean_dropped_inputs,
        round(avg(reversals), 2) AS mean_direction_reversals, round(avg(motions), 2) AS mean_motion_tool_calls,
        round(avg(filtered), 4) AS target_filtered_out_rate, round(avg(maxed), 4) AS max_ticks_rate
        FROM rollouts GROUP BY mode, condition, difficulty""",
    ),
    "cells": (
        (),
        f"""SELECT {sql_slot(('oracle_lora', 'woz_lora', 'oracle_woz_lora'), 'l_suppkey')} AS m,
        CASE l_linestatus WHEN 'O' THEN 'oracle' ELSE 'ambiguous' END AS flavor,
        CASE l_returnflag WHEN 'R' THEN 'ycb' WHEN 'A' THEN 'stacking' ELSE 'pouring' END AS env, count(*) AS n,
        avg(CASE WHEN (l_linenumber + l_partkey) % 3 > 0 THEN 1.0 ELSE 0.0 END) AS acc, avg(l_quantity) AS eps FROM lineitem GROUP BY 1, 2, 3""",
    ),
}


def with_views(select: str, *names: str) -> str:
    """``select`` behind the named views and those they build on."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in wanted) + "\n" + select
