"""JSONL readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlog.functions.jsontext import member, members, strict_json
from decisionlog.operators.contracts import contract_line_violations
from decisionlog.operators.ordered import by_value, position
from decisionlog.schemas import CONTRACT_KEYS, SCENARIOS


def read_lines(spark: SparkSession, path: str | list[str], *, numbered: bool = True, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Non-blank lines as ``file, line, text``; ``line`` counts physical lines of a file from 1.

    Large files are read in blocks by many tasks: lines are numbered inside a block and shifted by the lines before it.
    Without ``numbered`` no shuffle is needed and ``line`` is null.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("text"),
    )
    if numbered:
        lines = position(lines, ["file"], by_value("_block", "_at"), "line")
    else:
        lines = lines.withColumn("line", F.lit(None).cast("bigint"))
    return lines.filter(F.trim("text") != "").select("file", "line", "text")


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: str, mode: str = "failfast", *, numbered: bool = True, recursive: bool = False
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """JSON object per line, columns of ``schema`` plus ``file`` and ``line``.

    ``failfast``: a line that is not exactly one JSON object stops the job naming ``file:line``. ``quarantine``: returns
    (rows, rejected) with ``file, line, text, reason``.
    """
    lines = read_lines(spark, path, numbered=numbered, recursive=recursive)
    lines = lines.withColumn("_value", strict_json(F.col("text")))
    reason = F.when(F.col("_value").isNull(), "invalid JSON").when(members(F.col("_value")).isNull(), "expected a JSON object")
    if mode == "failfast":
        where = F.concat_ws(":", "file", F.col("line").cast("string"))
        stop = F.raise_error(F.concat(where, F.lit(": "), reason)).cast("string")
        return _parsed(lines.withColumn("text", F.when(reason.isNull(), F.col("text")).otherwise(stop)), schema)
    if mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    rejected = lines.filter(reason.isNotNull()).select("file", "line", "text", reason.alias("reason"))
    return _parsed(lines.filter(reason.isNull()), schema), rejected


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select("file", "line", F.from_json("text", schema).alias("_row")).select("_row.*", "file", "line")


def read_jsonl_lenient(spark: SparkSession, root: str, schema: str, *, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All JSONL files below ``root``; returns (rows, dropped).

    ``cell`` is the name of the directory a file lies in. ``dropped`` counts the bad lines per file.
    """
    lines = read_lines(spark, root, numbered=False, recursive=True, glob=glob)
    lines = lines.withColumn("cell", F.regexp_extract("file", r"([^/]+)/[^/]*$", 1)).withColumn("_ok", members(strict_json(F.col("text"))).isNotNull())
    rows = lines.filter("_ok").select("cell", "file", F.from_json("text", schema).alias("_row")).select("_row.*", "cell", "file")
    dropped = lines.filter(~F.col("_ok")).groupBy("file").agg(F.count("*").alias("dropped"))
    return rows, dropped


def read_contract(spark: SparkSession, path: str | list[str], mode: str = "failfast") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Contract rows of a JSONL file, checked line by line (S3)."""
    lines = read_lines(spark, path).withColumn("violations", contract_line_violations(F.col("text")))
    top = members(strict_json(F.col("text")))
    columns = [F.try_variant_get(member(top, k), "$", "string").alias(k) for k in CONTRACT_KEYS]
    broken = F.size("violations") > 0
    if mode == "quarantine":
        return lines.filter(~broken).select(*columns), lines.filter(broken)
    stop = F.raise_error(F.concat_ws(":", "file", F.col("line").cast("string"), F.concat_ws("; ", "violations"))).cast("string")
    return lines.withColumn("text", F.when(broken, stop).otherwise(F.col("text"))).select(*columns)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario rows written by :func:`write_scenarios`."""
    return spark.read.schema(SCENARIOS).json(path)


def write_scenarios(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_jsonl(df, path, mode)


def write_splits(df: DataFrame, root: str, *, by: tuple[str, ...] = ("env", "split"), fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One directory per environment and split."""
    df.write.mode(mode).partitionBy(*by).format(fmt).save(root)
