"""Free model text to JSON objects (P10) and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decisionlog.functions.bind import let, once
from decisionlog.functions.jsontext import as_text, items, member, members, strict_json
from decisionlog.functions.text import strip
from decisionlog.schemas import INTERACT_KINDS


#: A string literal (also one that never ends), a brace, or a run of anything else.
_TOKENS = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|[{}]|[^"{}]++'


def first_object(text: Column) -> Column:
    """The first ``{...}`` of each text whose braces balance outside string literals.

    From the first brace on the text is cut into tokens; the sum of the braces so far says where the object ends.
    """
    tail = F.substring(text, F.locate("{", text), F.length(text))
    step = lambda token: F.when(token == "{", 1).when(token == "}", -1).otherwise(0)

    def walk(state: Column, token: Column) -> Column:
        depth = state["depth"] + step(token)
        ends = (token == "}") & (depth == 0)
        length = state["length"] + F.length(token)
        return F.when(state["ended"], state).otherwise(F.struct(depth.alias("depth"), length.alias("length"), ends.alias("ended")))

    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("ended"))
    end = F.aggregate(F.regexp_extract_all(tail, F.lit(_TOKENS), F.lit(0)), begin, walk, lambda s: F.when(s["ended"], s["length"]))
    return F.when(F.contains(text, F.lit("{")), let(end, lambda n: F.substring(tail, F.lit(1), n)))


def triage_generations(df: DataFrame, raw: str, *, out: str = "parsed") -> DataFrame:
    """Add ``out`` (JSON text of the object, or null) and ``out_class``.

    Classes: ``ok``, ``not_an_object``, ``json_error``, ``json_error_after_extract``. Strict JSON is tested by Spark;
    text that fails is searched for its first balanced object.
    """
    rows = first_values(df, raw, "_value", "_cut")
    is_object = members(F.col("_value")).isNotNull()
    state = (
        F.when(F.col("_value").isNotNull(), F.when(is_object, "ok").otherwise("not_an_object"))
        .when(F.col("_cut").isNotNull(), "json_error_after_extract")
        .otherwise("json_error")
    )
    return rows.select(*df.columns, F.when(is_object, F.to_json("_value")).alias(out), state.alias(f"{out}_class"))


def first_values(df: DataFrame, raw: str, value: str, cut: str) -> DataFrame:
    """Add ``value``, the VARIANT of a text or of the first balanced object in it, and that object's text ``cut``.

    ``cut`` is null where the whole text is strict JSON; ``value`` is null where neither is.
    """
    rows = once(df, {"_strict": strict_json(F.col(raw))})
    failed = F.when(F.col("_strict").isNull() & F.contains(F.col(raw), F.lit("{")), F.col(raw))
    rows = rows.withColumn(cut, first_object(failed))
    return once(rows, {value: F.coalesce("_strict", strict_json(F.col(cut)))}).drop("_strict")


def parse_questions(df: DataFrame, raw: str, *, out: str = "question") -> DataFrame:
    """Add struct ``out`` <kind, text, choices> when the text holds an INTERACT object; null otherwise.

    At most five choices are kept and the kind defaults to QUESTION. An object without a text ``tool`` passes.
    """
    rows = triage_generations(df, raw, out="_json")
    rows = rows.withColumn("_top", members(F.try_parse_json("_json")))
    rows = rows.withColumn("_args", members(member(F.col("_top"), "args")))
    tool = member(F.col("_top"), "tool")
    other_tool = (F.schema_of_variant(tool) == "STRING") & (F.upper(strip(F.try_variant_get(tool, "$", "string"))) != "INTERACT")
    kind = F.upper(strip(F.try_variant_get(member(F.col("_args"), "kind"), "$", "string")))
    words = member(F.col("_args"), "text")
    text = F.when(words.isNull() | (F.schema_of_variant(words) == "VOID"), F.lit("")).otherwise(as_text(words))
    choices = F.slice(F.coalesce(F.transform(items(member(F.col("_args"), "choices")), as_text), F.array().cast("array<string>")), 1, 5)
    question = F.struct(
        F.when(kind.isin(*INTERACT_KINDS), kind).otherwise(F.lit("QUESTION")).alias("kind"),
        text.alias("text"),
        choices.alias("choices"),
    )
    keep = F.col("_top").isNotNull() & ~F.coalesce(other_tool, F.lit(False))
    return rows.select(*df.columns, F.when(keep, question).alias(out))
