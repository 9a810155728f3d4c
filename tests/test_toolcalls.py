import json

import pytest
from pyspark.sql import functions as F

from decisionlog.operators.toolcalls import call_violations, read_call, same_call
from decisionlog.operators.triage import parse_questions, triage_generations

ASK = {"tool": "INTERACT", "args": {"kind": "QUESTION", "text": "which?", "choices": ["1) a", "2) b"]}}


def described(spark, calls, normalise=None, env=None):
    df = spark.createDataFrame([(i, c if isinstance(c, str) else json.dumps(c)) for i, c in enumerate(calls)], "i int, raw string")
    out = read_call(df, "raw", "call", normalise=normalise).withColumn("bad", call_violations(F.col("call"), env))
    return {r.i: r for r in out.collect()}


@pytest.mark.parametrize(
    "call,first",
    [
        (ASK, None),
        ({"tool": "APPROACH", "args": {"obj": "o1"}}, None),
        ({"tool": "RELEASE", "args": {}}, None),
        ({"tool": "POUR", "args": {"obj": "o1", "amount": "HALF"}}, None),
        ({"tool": "APPROACH", "args": {"obj": "o1"}, "x": 1}, "keys"),
        ({"tool": "DANCE", "args": {}}, "tool"),
        ({"tool": 3, "args": {}}, "tool"),
        ({"tool": "APPROACH", "args": []}, "args"),
        ({"tool": "APPROACH", "args": {"obj": 3}}, "obj_args"),
        ({"tool": "APPROACH", "args": {"obj": "a", "y": 1}}, "obj_args"),
        ({"tool": "RELEASE", "args": {"a": 1}}, "release_args"),
        ({"tool": "POUR", "args": {"obj": "o1", "amount": "ALL"}}, "pour_amount"),
        ({"tool": "POUR", "args": {"obj": "o1"}}, "pour_keys"),
        ({"tool": "INTERACT", "args": {"kind": "Q", "text": "", "choices": ["1) a"]}}, "interact_kind"),
        ({"tool": "INTERACT", "args": {"kind": "CONFIRM", "text": 3, "choices": ["1) a"]}}, "interact_text"),
        ({"tool": "INTERACT", "args": {"kind": "CONFIRM", "text": "", "choices": []}}, "interact_choices"),
        ({"tool": "INTERACT", "args": {"kind": "CONFIRM", "text": "", "choices": ["1) a", 2]}}, "interact_choices"),
        ({"tool": "INTERACT", "args": {"kind": "CONFIRM", "text": "", "choices": ["a"]}}, "interact_choice_prefix"),
        ({"tool": "INTERACT", "args": {"kind": "CONFIRM", "text": "", "choices": [f"{i}) a" for i in range(6)]}}, "interact_too_many_choices"),
        ([1], "not_an_object"),
    ],
)
def test_violations(spark, call, first):
    bad = described(spark, [call])[0].bad
    assert (bad[0] if bad else None) == first


def test_env_skills(spark):
    stack = {"tool": "STACK", "args": {"obj": "o"}}
    assert described(spark, [stack], env="cube_stacking")[0].bad == []
    assert described(spark, [stack], env="pouring")[0].bad == ["tool"]
    assert "unknown_env" in described(spark, [stack], env="nowhere")[0].bad


def test_normaliser(spark):
    calls = [
        {"tool": " interact ", "args": {"type": "confirm", "choices": [1, True], "extra": 1}},
        {"tool": "approach", "args": {"obj": "o1", "why": "near"}},
        {"tool": "stack", "args": {"obj": "o1"}, "x": 2},
        {"tool": "INTERACT", "args": {"kind": "?", "text": None, "choices": "no list"}},
    ]
    got = described(spark, calls, "offline")
    assert (got[0].call.tool, got[0].call.kind, got[0].call.choices, got[0].call.text) == ("INTERACT", "CONFIRM", ["1", "True"], "")
    assert got[0].bad == ["interact_choice_prefix"]
    assert (got[1].call.tool, got[1].call.obj, got[1].bad) == ("APPROACH", '"o1"', [])
    assert (got[2].call.tool, got[2].bad) == ("STACK", ["keys"])
    assert (got[3].call.kind, got[3].call.choices, got[3].bad) == ("QUESTION", [], ["interact_choices"])
    late = described(spark, calls, "eval")
    assert late[0].call.kind is None and "interact_keys" in late[0].bad  # only exact INTERACT is rebuilt there


def test_eval_variant_keeps_ten_choices(spark):
    call = {"tool": "INTERACT", "args": {"kind": "QUESTION", "text": "", "choices": [f"{i}) a" for i in range(12)]}}
    assert len(described(spark, [call], "eval")[0].call.choices) == 10
    assert len(described(spark, [call], "offline")[0].call.choices) == 12


def test_same_call(spark):
    other = json.loads(json.dumps(ASK))
    other["args"]["text"] = "what?"
    df = spark.createDataFrame([(json.dumps(ASK), json.dumps(other))], "a string, b string")
    df = read_call(read_call(df, "a", "x"), "b", "y")
    row = df.select(same_call(F.col("x"), F.col("y")).alias("loose"), same_call(F.col("x"), F.col("y"), ignore_text=False).alias("exact")).first()
    assert (row.loose, row.exact) == (True, False)


@pytest.mark.parametrize(
    "raw,state,obj",
    [
        ('{"a": 1}', "ok", {"a": 1}),
        ("[1]", "not_an_object", None),
        ('say {"a": "}{\\"x"} ok', "ok", {"a": '}{"x'}),
        ("{'a':1}", "json_error_after_extract", None),
        ('{"a":01}', "json_error_after_extract", None),
        ('{"a":1', "json_error", None),
        ("none", "json_error", None),
        ('{"a":1},"q":2', "ok", {"a": 1}),
        ('{"a":1} x', "ok", {"a": 1}),
    ],
)
def test_triage(spark, raw, state, obj):
    row = triage_generations(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert row.parsed_class == state
    assert (json.loads(row.parsed) if row.parsed else None) == obj


def test_questions(spark):
    raws = [
        'x {"tool":"interact","args":{"choices":["1","2","3","4","5","6"],"kind":"confirm"}}',
        '{"tool":"APPROACH","args":{}}',
        '{"args":{"text":5}}',
        "junk",
    ]
    got = [r.question for r in parse_questions(spark.createDataFrame([(r,) for r in raws], "raw string"), "raw").collect()]
    assert got[0].kind == "CONFIRM" and len(got[0].choices) == 5
    assert got[1] is None and got[3] is None
    assert (got[2].kind, got[2].text, got[2].choices) == ("QUESTION", "5", [])
