import json

import pytest
from pyspark.sql import functions as F

from decisionlog import schemas as S
from decisionlog.operators.contracts import (
    contract_from_text,
    env_of,
    filter_trainable,
    format_checks,
    normalize_contract,
    observe,
    to_chat,
    to_contract,
    truncate_dialogs,
    unify_dialogs,
    validate_contract,
    validate_decisions,
    with_env,
)
from decisionlog.sources.jsonl import read_contract, read_jsonl, read_jsonl_lenient, read_lines, write_jsonl


def record(episode=3, turns=14, tool="APPROACH", **extra):
    return {
        "episode_id": episode,
        "objects": [{"id": "obj_1", "label": "mug", "cell": "A1", "yaw": "N", "is_held": False}],
        "gripper_hist": [{"cell": "A1", "yaw": "N", "z": "HIGH"}] * 6,
        "memory": {
            "n_interactions": 1,
            "past_dialogs": [{"role": "user", "content": str(i)} for i in range(turns)],
            "candidates": ["obj_1"],
            "last_prompt": {"kind": "CONFIRM", "context": {"type": " confirm "}},
        },
        "user_state": {"mode": "rotation"},
        "target_tool_call": {"tool": tool, "args": {"obj": "obj_1"}},
        **extra,
    }


@pytest.fixture
def logfile(tmp_path):
    path = tmp_path / "woz_kitchen" / "log.jsonl"
    path.parent.mkdir()
    path.write_text("\n\n".join(json.dumps(record(e)) for e in (3, 4)) + "\n")
    return str(path)


def test_line_numbers_span_blocks(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join("\n" if i % 5 == 0 else f"row {i}\n" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3200
    assert all(r.text == f"row {r.line}" for r in rows)


def test_contract_from_text(spark, logfile):
    rows = contract_from_text(read_lines(spark, logfile), prefix_by_directory=True).orderBy("id").collect()
    assert [r.id for r in rows] == ["kitchen_3_1", "kitchen_4_3"]
    blob = json.loads(rows[0].input)
    assert list(blob) == ["objects", "gripper_hist", "memory", "user_state"]
    assert [t["content"] for t in blob["memory"]["past_dialogs"]] == [str(i) for i in range(2, 14)]
    assert blob["memory"]["last_prompt"]["context"]["type"] == " confirm "
    assert json.loads(rows[0].output) == {"tool": "APPROACH", "args": {"obj": "obj_1"}}
    whole = contract_from_text(read_lines(spark, logfile), max_past_dialogs=0).first()
    assert len(json.loads(whole.input)["memory"]["past_dialogs"]) == 14


def test_missing_key_names_the_line(spark, tmp_path):
    bad = record()
    del bad["memory"]
    (tmp_path / "x.jsonl").write_text(json.dumps(record()) + "\n" + json.dumps(bad) + "\n")
    with pytest.raises(Exception, match=r"x\.jsonl:2: missing keys memory"):
        contract_from_text(read_lines(spark, str(tmp_path / "x.jsonl"))).collect()


def test_typed_contract_chat_and_validation(spark, logfile):
    records = read_jsonl(spark, logfile, S.DECISIONS)
    contract = to_contract(records, row_number="line")
    row = contract.orderBy("id").first()
    assert row.id == "3_1" and len(json.loads(row.input)["memory"]["past_dialogs"]) == 12
    ok, bad = validate_contract(contract)
    assert (ok.count(), bad.count()) == (2, 0)
    chat = to_chat(contract, "be brief").orderBy("id").first()
    assert [m.role for m in chat.messages] == ["system", "user", "assistant"]
    assert chat.messages[1].content == S.DEFAULT_INSTRUCTION + "\n\nInput:\n" + row.input
    assert [r.violations for r in validate_decisions(records).collect()] == [[], []]
    assert validate_decisions(records.withColumn("gripper_hist", F.slice("gripper_hist", 1, 5)), "pouring").first().violations == ["gripper_hist length"]


def test_meta_and_own_id(spark):
    df = spark.createDataFrame([json.dumps(record(id="mine", ambiguity_category="size"))], "string").select(F.from_json("value", S.AMBIGUOUS).alias("r")).select("r.*")
    row = to_contract(df.withColumn("seq", F.lit(1)), own_id="id", meta_cols=("ambiguity_category",)).first()
    assert row.id == "mine" and row.meta.ambiguity_category == "size"


def test_read_contract(spark, tmp_path):
    good = {"id": "a", "instruction": "i", "input": "", "output": "{}"}
    lines = [good, {**good, "id": 3}, {**good, "output": "{"}, {k: v for k, v in good.items() if k != "input"}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n[1]\n")
    ok, bad = read_contract(spark, str(tmp_path / "c.jsonl"), "quarantine")
    assert [tuple(r) for r in ok.collect()] == [("a", "i", "", "{}")]
    assert {r.line: r.violations for r in bad.collect()} == {
        2: ["id is not text"],
        3: ["output is not JSON"],
        4: ["missing input"],
        5: ["not one JSON object"],
    }
    with pytest.raises(Exception, match=r"c\.jsonl:2"):
        read_contract(spark, str(tmp_path / "c.jsonl")).collect()


def test_jsonl_modes(spark, tmp_path):
    cell = tmp_path / "model__mode"
    cell.mkdir()
    (cell / "d.jsonl").write_text('{"a":1}\n\n{"a":2} x\n[3]\n{"a":4}\n')
    rows, rejected = read_jsonl(spark, str(cell), "a INT", "quarantine")
    assert sorted((r.a, r.line) for r in rows.collect()) == [(1, 1), (4, 5)]
    assert sorted((r.line, r.reason) for r in rejected.collect()) == [(3, "invalid JSON"), (4, "expected a JSON object")]
    with pytest.raises(Exception, match=r"d\.jsonl:[34]: "):
        read_jsonl(spark, str(cell), "a INT").collect()
    rows, dropped = read_jsonl_lenient(spark, str(tmp_path), "a INT")
    assert sorted((r.cell, r.a) for r in rows.collect()) == [("model__mode", 1), ("model__mode", 4)]
    assert dropped.first().dropped == 2
    write_jsonl(spark.createDataFrame([(None, "é")], "a int, b string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert text == '{"a":null,"b":"é"}\n'


def test_normalize_contract(spark):
    inp = record(turns=0)
    inp["memory"] = {"past_dialogs": [{"prompt": "p", "reply": None}, {"role": "user", "content": 5}, {"prompt": "q", "reply": "r"}], "last_action": {"x": 1}}
    inp["objects"][0]["fill"] = "half"
    call = {"tool": "INTERACT", "args": {"kind": "CONFIRM", "text": "t", "junk": 1}}
    df = spark.createDataFrame([("i", "old", json.dumps(inp), json.dumps(call)), ("j", "old", json.dumps(inp), json.dumps({"tool": "POUR", "args": {"obj": "o"}}))], S.CONTRACT)
    a, b = normalize_contract(df).orderBy("id").collect()
    blob = json.loads(a.input)
    assert sorted(blob["objects"][0]) == sorted(["id", "label", "cell", "yaw", "is_held", "kind", "fill", "stacked_on", "top_of_stack"])
    assert blob["objects"][0]["fill"] == "half" and blob["objects"][0]["kind"] is None
    assert list(blob["memory"]) == ["n_interactions", "past_dialogs", "candidates", "last_tool_calls", "excluded_obj_ids", "last_action", "last_prompt"]
    assert blob["memory"]["past_dialogs"] == [
        {"role": "assistant", "content": "p"},
        {"role": "user", "content": "5"},
        {"role": "assistant", "content": "q"},
        {"role": "user", "content": "r"},
    ]
    assert blob["memory"]["last_action"] == {"x": 1} and blob["memory"]["last_prompt"] == {}
    assert blob["user_state"] == {"mode": "translation"}
    assert json.loads(a.output) == {"tool": "INTERACT", "args": {"kind": "CONFIRM", "text": "t", "choices": []}}
    assert json.loads(b.output) == {"tool": "POUR", "args": {"obj": "o", "amount": None}}
    report = format_checks(normalize_contract(df)).first()
    assert (report.instruction_count, report.output_tools, report.choice_limit_violations) == (1, ["INTERACT", "POUR"], 0)
    assert report.input_keys == ["gripper_hist,memory,objects,user_state"]


@pytest.mark.parametrize("n,want", [(2, [2, 3]), (0, [1, 2, 3]), (9, [1, 2, 3])])
def test_truncate(spark, n, want):
    assert spark.range(1).select(truncate_dialogs(F.array(F.lit(1), F.lit(2), F.lit(3)), n).alias("x")).first().x == want


def test_env(spark):
    df = spark.createDataFrame([("woz_pouring_1",), ("oracle_cube_stacking_2",), ("reach_to_grasp_ycb_3",)], "id string")
    assert {r.env for r in with_env(df).collect()} == {"pouring", "cube_stacking", "reach_to_grasp_ycb"}
    with pytest.raises(Exception, match="cannot infer"):
        with_env(spark.createDataFrame([("x",)], "id string")).collect()
    rows = spark.createDataFrame([("translation", "STACK"), ("rotation", "STACK"), ("translation", "RELEASE")], "mode string, tool string")
    assert filter_trainable(rows).count() == 1


def test_observe(spark):
    cases = {
        "": ("invalid_input_json", "unknown", 0),
        "[]": ("invalid_input_json", "unknown", 0),
        "{}": ("no_memory", "translation", 0),
        '{"memory":{"candidates":["a","b"]},"user_state":{"mode":"Gripper"}}': ("no_context", "gripper", 2),
        '{"memory":{"last_prompt":{}}}': ("no_context", "translation", 0),
        '{"memory":{"last_prompt":{"a":1}}}': ("no_context", "translation", 0),
        '{"memory":{"last_prompt":{"context":{"type":" "}}}}': ("unknown", "translation", 0),
        '{"memory":{"last_prompt":{"context":{"type":" help "}}},"user_state":[1]}': ("help", "unknown", 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "input string")
    assert {r.input: (r.context, r.mode, r.n_cands) for r in observe(df).collect()} == cases
    assert observe(df, online=True).filter("context = 'no_last_prompt'").count() == 1
