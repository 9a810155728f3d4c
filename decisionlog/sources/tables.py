"""Result cells, CSV tables, reports and incremental appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from decisionlog.functions.jsontext import members, strict_json
from decisionlog.functions.text import ratio
from decisionlog.operators.reports import pending
from decisionlog.schemas import CELLS


def read_cells(spark: SparkSession, path: str, *, glob: str = "*.json", recursive: bool = False) -> DataFrame:
    """Result cells, one JSON object per file; unreadable files are skipped."""
    return split_cells(spark, path, glob=glob, recursive=recursive)[0]


def split_cells(spark: SparkSession, path: str, *, glob: str = "*.json", recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Result cells and, as ``file, text``, the files that hold no JSON object.

    Files are read whole, many small ones per task: Spark fills a task up to ``spark.sql.files.maxPartitionBytes``. ``NaN`` and infinite numbers are
    read as such; text behind the object or an array make a file unreadable, an empty file gives no row at all.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    rows = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    plain = F.regexp_replace("text", r"([:\[,]\s*)-?(NaN|Infinity)\b", "$1null")
    parsed = F.from_json("text", f"{CELLS}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    ok = members(strict_json(plain)).isNotNull() & F.col("_c").isNotNull() & F.col("_c._corrupt").isNull()
    rows = rows.withColumn("_c", parsed).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return rows.filter("_ok").select("_c.*").drop("_corrupt"), rows.filter("NOT _ok").select("file", "text")


def read_csv(spark: SparkSession, path: str, schema: str, *, row: str | None = None, multiline: bool = True) -> DataFrame:
    """CSV files with a header under a fixed schema.

    ``row`` adds a place that rises in file order, also over several files or blocks of one. ``multiline`` allows line breaks
    inside quotes; without it, large files are read in blocks by many tasks.
    """
    reader = spark.read.option("header", "true").option("enforceSchema", "false").option("multiLine", str(multiline).lower())
    rows = reader.schema(schema).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return rows.withColumn(row, place) if row else rows


def context_table(breakdown: DataFrame, contexts: Sequence[str], model: str = "model") -> DataFrame:
    """Accuracy and size per context as columns, one row per model (S11); contexts without rows get 0."""
    rows = breakdown.filter(F.col("dim") == "context")
    value = lambda c, x: F.max(F.when(F.col("key") == x, F.col(c)))
    wide = rows.groupBy(model).agg(
        *[F.round(ratio(value("tool_correct", x), value("n", x)), 4).alias(f"{x}_acc") for x in contexts],
        *[F.coalesce(value("n", x), F.lit(0)).alias(f"{x}_n") for x in contexts],
    )
    return wide


def confusion_table(confusion: DataFrame, tools: Sequence[str], keys: Sequence[str] = ("model",)) -> DataFrame:
    """Confusion counts with predicted tools as columns, invalid ones last."""
    wide = confusion.groupBy(*keys, "gt_tool").pivot("pred_tool", [*tools, "INVALID_JSON", "INVALID_SCHEMA"]).agg(F.sum("n"))
    return wide.na.fill(0)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A small report as CSV with a header."""
    df.coalesce(1).write.mode(mode).option("header", "true").csv(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> None:
    """Append the rows whose keys the table at ``path`` does not hold yet.

    The stored table is read for its keys only. A missing table counts as empty.
    """
    spark = df.sparkSession
    try:
        done = spark.read.format(fmt).load(path).select(*keys)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new = df
    else:
        new = pending(df, done, keys)
    new.write.mode("append").format(fmt).save(path)
