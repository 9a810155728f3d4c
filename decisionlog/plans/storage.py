"""Queries on what comes back from storage: tables written to the shared folder as logs, contracts, CSV or reports, read again."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from decisionlog.functions import geometry as G
from decisionlog.operators import contracts as C
from decisionlog.operators import policies as B
from decisionlog.operators import reports as S
from decisionlog.operators import trials as T
from decisionlog.operators.ordered import by_number
from decisionlog.plans import views as V
from decisionlog.plans.registry import checksum, query, sql_checksum
from decisionlog.plans.streams import shared_folder
from decisionlog.schemas import MAX_CHOICES, TRIAL_KEYS
from decisionlog.sources import jsonl, tables, trials


def _count():
    return F.count("*").alias("n")


@query("SELECT doc_id, source, md5(text) AS digest FROM documents")
def jsonl_scan(t):
    path = shared_folder(t.spark)
    jsonl.write_jsonl(t.documents.select("doc_id", "source", "text"), path)
    rows = jsonl.read_jsonl(t.spark, path, "doc_id BIGINT, source STRING, text STRING", numbered=False)
    return rows.select("doc_id", "source", F.md5("text").alias("digest"))


@query("SELECT COUNT(*) AS rows, COUNT(*) AS lines, COUNT(*) AS places FROM events")
def jsonl_lines(t):
    """Line numbers of each file run from 1 without gaps."""
    path = shared_folder(t.spark)
    t.events.select("props").write.text(path)
    files = jsonl.read_lines(t.spark, path).groupBy("file").agg(_count(), F.max("line").alias("last"), F.count_distinct("line").alias("places"))
    return files.agg(F.sum("n").alias("rows"), F.sum("last").alias("lines"), F.sum("places").alias("places"))


@query(
    f"""SELECT role, COUNT(*) FILTER (turn % 4 <> 3) AS kept, COUNT(*) FILTER (turn % 4 = 3) AS dropped,
    {sql_checksum("coalesce(CASE WHEN turn % 4 <> 3 THEN text END, '')")} FROM conversations GROUP BY role"""
)
def jsonl_lenient(t):
    """Every fourth turn is cut short; one directory per role."""
    path = shared_folder(t.spark)
    line = F.to_json(F.struct("turn", "text"))
    rows = t.conversations
    rows.select("role", F.when(F.col("turn") % 4 == 3, F.concat(F.lit(" "), F.substring(line, F.lit(1), F.length(line) - 1))).otherwise(line).alias("value")).write.partitionBy("role").text(path)
    kept, dropped = jsonl.read_jsonl_lenient(t.spark, path, "turn INT, text STRING")
    kept = kept.select(F.col("cell").alias("cell"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("kept"), F.lit(0).alias("dropped"))
    lost = dropped.select(F.regexp_extract("file", r"([^/]+)/[^/]*$", 1).alias("cell"), F.lit("").alias("text"), F.lit(0).alias("kept"), F.col("dropped").cast("int"))
    lost = lost.withColumn("text", F.explode(F.array_repeat("text", F.col("dropped")))).withColumn("dropped", F.lit(1))
    return kept.unionByName(lost).groupBy(F.regexp_replace("cell", "^role=", "").alias("role")).agg(F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"), checksum("text"))


@query(
    f"""SELECT rules, COUNT(*) AS n, {sql_checksum('doc_id')} FROM (SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 11 = 0 THEN 'instruction is not text' END,
    CASE WHEN text IS NULL THEN 'input is not text' END, CASE WHEN doc_id % 7 = 0 THEN 'output is not JSON' END) AS rules FROM documents) GROUP BY rules"""
)
def contract_source(t):
    """Documents as contract lines, some without an instruction or with a broken call."""
    path = shared_folder(t.spark)
    k = F.col("doc_id")
    rows = t.documents.select(
        k.cast("string").alias("id"), F.when(k % 11 != 0, F.lit("answer")).alias("instruction"), F.col("text").alias("input"),
        F.when(k % 7 == 0, '{"tool":').otherwise('{"tool":"APPROACH","args":{"obj":"o1"}}').alias("output"),
    )
    jsonl.write_jsonl(rows, path)
    ok, broken = jsonl.read_contract(t.spark, path, "quarantine")
    bad = broken.select(F.concat_ws("; ", "violations").alias("rules"), F.get_json_object("text", "$.id").alias("id"))
    return ok.select(F.lit("").alias("rules"), "id").unionByName(bad).groupBy("rules").agg(_count(), checksum("id"))


@query(
    """SELECT CAST(h.id AS VARCHAR) AS id, any_value(CASE WHEN h.id % 2 = 0 THEN 'obj_' || (h.id % 9) END) AS target, COUNT(s.id) AS objects,
    string_agg(s.id || ':' || s.label, ',' ORDER BY s.slot) AS digest FROM scene_heads h JOIN scene_rows s ON s.order_key = h.id GROUP BY h.id""",
    "scene_heads",
)
def scenario_round_trip(t):
    path = shared_folder(t.spark)
    jsonl.write_scenarios(V.scenarios(t), path)
    rows = jsonl.read_scenarios(t.spark, path)
    labels = F.array_join(F.transform("objects", lambda o: F.concat(o["id"], F.lit(":"), o["label"])), ",")
    return rows.select(F.col("scenario_id").alias("id"), F.col("target_obj_id").alias("target"), F.size("objects").cast("bigint").alias("objects"), labels.alias("digest"))


@query(f"SELECT env, split, COUNT(*) AS n, {sql_checksum('id')} FROM examples GROUP BY env, split", "examples")
def split_directories(t):
    path = shared_folder(t.spark)
    jsonl.write_splits(V.examples(t), path)
    return t.spark.read.parquet(path).groupBy("env", "split").agg(_count(), checksum("id"))


@query("SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price FROM orders")
def csv_source(t):
    path = shared_folder(t.spark)
    t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.option("header", "true").csv(path)
    rows = tables.read_csv(t.spark, path, "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE")
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@query(f"SELECT o_orderstatus AS status, COUNT(*) AS n, {sql_checksum('o_orderkey')} FROM orders GROUP BY o_orderstatus")
def append_twice(t):
    """Orders appended in two overlapping parts: every key is there once."""
    path = shared_folder(t.spark)
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    tables.append_new(rows.filter("status = 'F'"), path, ["o_orderkey"])
    tables.append_new(rows, path, ["o_orderkey"])
    return t.spark.read.parquet(path).groupBy("status").agg(_count(), checksum("o_orderkey"))


@query("SELECT env, split, tool, COUNT(*) AS n FROM examples GROUP BY env, split, tool ORDER BY env, split, tool", "examples")
def report_sink(t):
    """A sorted report as CSV, read back."""
    path = shared_folder(t.spark)
    tables.write_report(S.ordered(V.examples(t).groupBy("env", "split", "tool").agg(_count()), ["env", "split", "tool"]), path)
    return S.ordered(tables.read_csv(t.spark, path, "env STRING, split STRING, tool STRING, n BIGINT"), ["env", "split", "tool"])


@query("SELECT 'nation=' || c_nationkey AS trial_id, arg_min(c_custkey * 3 + 1, c_custkey) AS value FROM customer WHERE c_custkey % 5 > 0 GROUP BY c_nationkey")
def metric_scrape(t):
    """The first count in each nation's log file."""
    path = shared_folder(t.spark)
    k = F.col("c_custkey")
    line = F.when(k % 5 == 0, "no count here").otherwise(F.concat(F.lit("at x: n_interactions = "), (k * 3 + 1).cast("string")))
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), k.alias("_k"), line.alias("value")).repartition("nation").sortWithinPartitions("nation", "_k")
    rows.drop("_k").write.partitionBy("nation").text(path)
    return trials.scrape_metric(t.spark, path).select("trial_id", "value")


def _decisions(t):
    """Scenes with the call that the asking policy makes, as decision records."""
    s = B.ask_if_ambiguous(V.scenes(t))
    memory = F.col("obs.memory").withField("past_dialogs", F.array().cast("array<struct<role:string,content:string>>"))
    return s.select(
        F.col("id").alias("episode_id"), F.col("id").alias("seq"), "status", "priority", F.col("obs.objects").alias("objects"), F.col("obs.gripper_hist").alias("gripper_hist"),
        memory.alias("memory"), F.col("obs.user_state").alias("user_state"), F.col("pred").alias("target_tool_call"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("own_"), F.col("id").cast("string"))).alias("own"),
    )


@query(
    "SELECT CASE WHEN id % 3 = 0 THEN 'own_' || id ELSE 'woz_' || id || '_' || id END AS id, status, priority FROM scene_heads",
    "scene_heads",
)
def contract_ids(t):
    rows = C.to_contract(_decisions(t), id_prefix="woz", own_id="own", meta_cols=("status", "priority"))
    return rows.select("id", "meta.status", "meta.priority")


@query(
    """SELECT h.id || '_' || h.id AS id, 'translation' AS mode, (SELECT COUNT(*) FROM scene_rows s WHERE s.order_key = h.id) AS objects, CASE WHEN m.n = 1 THEN 1 ELSE 0 END AS acts
    FROM scene_heads h LEFT JOIN menus m USING (id)""",
    "scene_heads",
    "menus",
)
def contract_shapes(t):
    rows = C.observe(C.normalize_contract(C.to_contract(_decisions(t))))
    acts = (F.get_json_object("output", "$.tool") != "INTERACT").cast("int")
    return rows.select("id", "mode", F.size("obs.objects").cast("bigint").alias("objects"), acts.alias("acts"))


@query("SELECT status, COUNT(*) AS n FROM scene_heads LEFT JOIN menus m USING (id) WHERE m.n IS DISTINCT FROM 1 AND status IN ('F', 'P') GROUP BY status", "scene_heads", "menus")
def annotation_queue(t):
    """Questions of one environment and of none ('P' stands for none)."""
    rows = _decisions(t).withColumn("env", F.when(F.col("status") != "P", F.col("status")))
    return C.select_decision_points(rows, env="F").groupBy("status").agg(_count())


@query(
    f"""SELECT status, CAST(1 AS BIGINT) AS instructions, CASE WHEN MAX(CASE WHEN m.n = 1 THEN 1 ELSE 0 END) = 1 THEN CASE status WHEN 'O' THEN 'ALIGN_YAW,' ELSE 'APPROACH,' END ELSE '' END || 'INTERACT' AS tools,
    CAST(COUNT(*) FILTER (m.n IS DISTINCT FROM 1 AND id % 13 = 0) AS BIGINT) AS too_many, 'gripper_hist,memory,objects,user_state' AS input_keys
    FROM scene_heads LEFT JOIN menus m USING (id) GROUP BY status""",
    "scene_heads",
    "menus",
)
def contract_formats(t):
    """Format report per order status; every thirteenth question offers too many choices."""
    call = F.col("target_tool_call")
    many = F.array_repeat(F.lit("1) a"), MAX_CHOICES + 1)
    choices = F.when((call["tool"] == "INTERACT") & (F.col("seq") % 13 == 0), many).otherwise(call["args"]["choices"])
    rows = _decisions(t).withColumn("target_tool_call", call.withField("args", call["args"].withField("choices", choices)))
    report = C.format_checks(C.to_contract(rows, meta_cols=("status",)).select("*", "meta.status"), ("status",))
    return report.select(
        "status", F.col("instruction_count").alias("instructions"), F.array_join("output_tools", ",").alias("tools"),
        F.col("choice_limit_violations").alias("too_many"), F.array_join("input_keys", "|").alias("input_keys"),
    )


@query(
    """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, ['E', 'NE', 'N', 'NW', 'W', 'SW', 'S', 'SE'][1 + (l_partkey % 24) // 3 % 8] AS yaw,
    ['A1', 'A2', 'A3', 'B1', 'B2', 'B3', 'C1', 'C2', 'C3'][1 + l_suppkey % 10] AS cell FROM lineitem"""
)
def quantised_poses(t):
    """Headings of 24 steps of 15 degrees, a little off the bins' edges, and cell numbers of which 9 is none."""
    turn = (F.col("l_partkey") % 24 - 1) * F.lit(math.pi / 12)
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        G.yaw_bin(turn).alias("yaw"), G.cell_label(F.col("l_suppkey") % 10).alias("cell"),
    )


_TRIALS = """trials AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'manual' ELSE 'assistive' END AS mode, 's' || c_nationkey AS subject,
    CASE WHEN c_custkey % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty, 'trial_' || c_custkey AS trial_id, c_custkey AS c, c_custkey % 4 > 0 AS has_meta,
    CASE WHEN c_custkey % 4 = 0 THEN 'log_' || c_custkey WHEN c_custkey % 8 = 1 THEN 'trial_' || c_custkey ELSE 'meta_' || c_custkey END AS logged_id FROM customer WHERE c_custkey % 10 > 0),
calls AS (SELECT o_custkey AS c, o_orderkey AS k, coalesce(n, 0) AS n, coalesce(seen, '') AS seen, coalesce(held, 0) AS held FROM orders LEFT JOIN (SELECT order_key, COUNT(*) AS n, COUNT(*) FILTER (is_held) AS held,
    string_agg(id || ':' || label || ':' || ['A1', 'A2', 'A3', 'B1', 'B2', 'B3', 'C1', 'C2', 'C3'][1 + ci], ',' ORDER BY slot) AS seen FROM scene_rows GROUP BY order_key) ON order_key = o_orderkey WHERE o_orderkey % 6 > 0),
heads AS (SELECT c, CAST(COUNT(*) AS BIGINT) AS calls, CAST(SUM(n) AS BIGINT) AS objects, arg_min(seen, k) AS first_seen, CAST(arg_min(held, k) AS BIGINT) AS first_held FROM calls GROUP BY c),
cmds AS (SELECT o_custkey AS c, CAST(COUNT(*) AS BIGINT) AS commands, CAST(SUM(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS drift FROM orders WHERE o_orderkey % 5 > 0 GROUP BY o_custkey)"""


def _trial_records(t):
    """A trial per customer: a call and an event per order; every tenth writes no summary, every fourth no metadata.

    Every sixth call has no snapshot, every third event is wrapped, every fifth line is no object.
    """
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    people = t.customer.select(
        F.when(c % 2 == 0, "manual").otherwise("assistive").alias("mode"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("subject"),
        F.when(c % 3 == 0, "hard").otherwise("easy").alias("difficulty"), F.concat(F.lit("trial_"), c.cast("string")).alias("trial_id"), "c_custkey",
    )
    # what is false or empty is left out of the log
    item = F.struct("id", "label", F.col("cell").alias("grid_label"), F.when(F.col("is_held"), True).alias("is_held"))
    seen = V.scene_rows(t).groupBy(F.col("order_key").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("slot", item.alias("o")))).alias("_o"))
    own = lambda orders: orders.join(people, F.col("o_custkey") == c)
    snapshot = F.struct(F.lit(1.0).alias("stamp"), F.transform("_o", lambda x: x["o"]).alias("objects"), F.struct(F.lit("B2").alias("grid_label")).alias("gripper"))
    call = F.struct(F.lit("INTERACT").alias("tool_name"), F.when(k % 6 > 0, snapshot).alias("state_snapshot"))
    event = F.struct(F.lit("cartesian_velocity").alias("type"), F.lit("x").alias("axis"), F.when(k % 2 == 0, 1).otherwise(-1).alias("direction"), F.lit(True).alias("active"))
    said = F.when(k % 5 == 0, "5").when(k % 3 == 0, F.to_json(F.struct(event.alias("parsed")))).otherwise(F.to_json(event))
    name = lambda text: F.to_json(F.struct(F.concat(F.lit(text), c.cast("string")).alias("trial_id")))
    given = lambda rows, kind, seq, text: rows.select(*TRIAL_KEYS, F.lit(kind).alias("kind"), seq.cast("bigint").alias("seq"), text.alias("text"))
    meta = F.when(c % 8 == 1, F.lit('{"trial_id":"","mode":"typo"}')).otherwise(name("meta_"))
    return (
        given(own(t.orders.join(seen, "o_orderkey", "left")), "call", k, F.to_json(call))
        .unionByName(given(own(t.orders), "event", k, said))
        .unionByName(given(people.filter(c % 4 > 0), "meta", F.lit(1), meta))
        .unionByName(given(people.filter(c % 10 > 0), "summary", F.lit(1), name("log_")))
    )


@query(
    f"""SELECT * FROM (WITH {_TRIALS} SELECT mode, subject, difficulty, trial_id, logged_id, has_meta, calls IS NOT NULL AS has_calls, coalesce(calls, 0) AS calls, coalesce(objects, 0) AS objects,
    first_seen, first_held, coalesce(commands, 0) AS commands, coalesce(drift, 0) AS drift FROM trials LEFT JOIN heads USING (c) LEFT JOIN cmds USING (c))""",
    "scene_rows",
)
def trial_round_trip(t):
    """Trial folders written, found, read and put together (S4-S6), the folders of some trials at a time."""
    store = shared_folder(t.spark)
    for part in trials.in_parts(_trial_records(t), shared_folder(t.spark), t.customer.count()):
        root = shared_folder(t.spark)
        trials.write_trials(part, root)
        trials.trial_records(t.spark, root).write.mode("append").parquet(store)
        trials.drop_trials(t.spark, root)
    lines = t.spark.read.parquet(store)
    keys = list(TRIAL_KEYS)
    parsed = shared_folder(t.spark)
    trials.calls_of(lines).write.parquet(parsed)  # read three times
    calls, commands = t.spark.read.parquet(parsed), trials.commands_of(lines)
    whole = T.assemble_trials(trials.documents_of(lines, "summary"), trials.documents_of(lines, "meta"), calls)
    first = T.first_snapshots(calls, by_number("seq"))
    names = F.transform("snapshot.objects", lambda o: F.concat_ws(":", o["id"], o["label"], o["grid_label"]))
    first = first.select(*keys, F.array_join(names, ",").alias("first_seen"), F.size(F.filter("snapshot.objects", lambda o: o["is_held"])).cast("bigint").alias("first_held"))
    counts = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(F.size("state_snapshot.objects")).alias("objects"))
    moves = commands.groupBy(*keys).agg(F.count("*").alias("commands"), F.sum("direction").cast("bigint").alias("drift"))
    return whole.join(counts, keys, "left").join(first, keys, "left").join(moves, keys, "left").na.fill(0, ["calls", "objects", "commands", "drift"])


@query(
    """SELECT s AS supplier, s % 7 > 0 AND s % 11 > 0 AND s % 13 > 0 AS readable, CASE WHEN s % 7 > 0 AND s % 11 > 0 AND s % 13 > 0 THEN n END AS n,
    CASE WHEN s % 7 > 0 AND s % 11 > 0 AND s % 13 > 0 THEN flags END AS flags FROM (SELECT s, CAST(SUM(n) AS BIGINT) AS n, string_agg(rf || '/' || ls || ':' || n, ',' ORDER BY rf, ls) AS flags
    FROM (SELECT l_suppkey AS s, l_returnflag AS rf, l_linestatus AS ls, COUNT(*) AS n FROM lineitem GROUP BY ALL) GROUP BY s)"""
)
def cells_from_files(t):
    """A result cell per supplier in a file of its own, some cut short, no object, or with text behind it."""
    path, s = shared_folder(t.spark), F.col("l_suppkey")
    pairs = t.lineitem.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(_count())
    of_flag = pairs.groupBy("l_suppkey", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("m"), F.sum("n").alias("n"))
    cells = of_flag.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "m"))).alias("tool_confusion"), F.sum("n").alias("n"))
    name = F.struct(s.cast("string").alias("name")).alias("model")
    text = F.to_json(F.struct(name, "n", "tool_confusion"), {"pretty": "true"})
    broken = F.when(s % 7 == 0, F.left(text, F.length(text) - 1)).when(s % 11 == 0, "5").when(s % 13 == 0, F.concat(text, F.lit("\n}"))).otherwise(text)
    cells.select(s.alias("supplier"), broken.alias("value")).write.partitionBy("supplier").text(path)
    good, bad = tables.split_cells(t.spark, path, glob="part-*", recursive=True)
    flags = F.flatten(F.transform(F.map_entries("tool_confusion"), lambda e: F.transform(F.map_entries(e["value"]), lambda f: F.concat(e["key"], F.lit("/"), f["key"], F.lit(":"), f["value"].cast("string")))))
    good = good.select(F.col("model.name").cast("bigint").alias("supplier"), F.lit(True).alias("readable"), "n", F.array_join(F.array_sort(flags), ",").alias("flags"))
    none = F.lit(None)
    bad = bad.select(F.regexp_extract("file", "supplier=([0-9]+)/", 1).cast("bigint").alias("supplier"), F.lit(False).alias("readable"), none.cast("bigint").alias("n"), none.cast("string").alias("flags"))
    return good.unionByName(bad)
