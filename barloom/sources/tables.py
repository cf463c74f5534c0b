"""Readers and writers around the panel: CSV bars, side tables, dated writes, profiles."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from barloom.functions.scalar import finite, rnd, to_day
from barloom.operators.cross_section import positions
from barloom.session import attach_row, by_series

SYMBOL_IN_PATH = r"([0-9A-Za-z]+)(?:\.[A-Z]{2})?\.csv$"


def decoded(read_as: str, written_as: str):
    """A column function: text read in a single-byte charset, decoded again as what it was written in."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else v.encode(read_as, "replace").decode(written_as, "replace"))

    return F.pandas_udf(run, StringType())


def read_csv_bars(
    spark: SparkSession, folder: str, schema: StructType | str, day: str, first=None, last=None, encoding: str = "ISO-8859-1",
    symbol_pattern: str = SYMBOL_IN_PATH, names: Sequence[str] = (), names_encoding: str = "gb18030",
) -> DataFrame:
    """Bars from one CSV per symbol; the symbol is taken from the file path, days outside the range are dropped.

    Column names come from ``schema``, and a single-byte charset keeps every byte, so files in a multi-byte charset
    whose second bytes are never comma, quote or line end (GBK) are cut right. The text columns ``names`` are then
    decoded from those bytes; what isn't valid there becomes the replacement character. Sub-folders are read too: name
    the folder above them and not a pattern, which the driver would expand one folder at a time.
    """
    raw = spark.read.csv(folder, schema=schema, header=True, encoding=encoding, recursiveFileLookup=True)
    for name in names:
        raw = raw.withColumn(name, decoded(encoding, names_encoding)(F.col(name)))
    bars = raw.withColumn("sym", F.regexp_extract(F.input_file_name(), symbol_pattern, 1)).withColumn("d", to_day(day))
    if first is not None:
        bars = bars.where(F.col("d") >= F.lit(first).cast("date"))
    if last is not None:
        bars = bars.where(F.col("d") <= F.lit(last).cast("date"))
    return bars.where((F.col("sym") != "") & F.col("d").isNotNull())


def write_csv_by_symbol(bars: DataFrame, folder: str, key: str = "sym") -> None:
    """One folder ``key=value`` with one CSV file per symbol, into a new folder.

    The rows of a symbol meet in one task first, or every task would write a file for every symbol.
    """
    by_series(bars, (key,)).write.partitionBy(key).option("header", True).csv(folder)


def read_index(raw: DataFrame, day: str = "trade_date") -> DataFrame:
    """Index rows: text days to dates, rows without close dropped, first row per day kept, day number added."""
    first = Window.partitionBy("d").orderBy(*[F.col(c) for c in raw.columns])
    return (
        raw.withColumn("d", to_day(day))
        .where(finite("close").isNotNull() & F.col("d").isNotNull())
        .withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .drop("_rn")
        .withColumn("day_no", F.unix_date("d"))
    )


def in_range(df: DataFrame, first, last, day: str = "d") -> DataFrame:
    """Days first..last; on a table partitioned by day this prunes folders."""
    return df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def write_by_day(df: DataFrame, path: str, day: str = "d") -> None:
    """Overwrite only the days present in ``df``; rerunning the same days is idempotent."""
    (
        df.hint("rebalance", day)  # a day with very many rows is split over several tasks and files
        .write.partitionBy(day)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def rows_of_days(table: DataFrame, wanted: DataFrame, day: str = "d") -> DataFrame:
    """Rows of a table partitioned by day on the days of ``wanted``.

    Join on the partition column: Spark reads the wanted days first and lists only their folders (dynamic partition
    pruning), so what is read follows the events, not the table's history. ``wanted`` shrinks to one row per day.
    """
    return table.join(F.broadcast(wanted.select(day).distinct()), day, "left_semi")


def compact(df: DataFrame, digits: int = 4) -> DataFrame:
    """Double columns rounded and stored as float; the input is untouched."""
    return df.select(
        *[
            rnd(f.name, digits).cast("float").alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def config_digest(parameters: dict) -> Column:
    """Stable digest of a parameter set."""
    text = "|".join(f"{k}={parameters[k]!r}" for k in sorted(parameters))
    return F.sha2(F.lit(text), 256)


def stale_days(wanted: DataFrame, manifest: DataFrame, parameters: dict, day: str = "d") -> DataFrame:
    """Wanted days with no manifest row for this parameter digest: the days to compute again."""
    want = wanted.select(day).distinct().withColumn("digest", config_digest(parameters))
    return want.join(manifest.select(day, "digest"), [day, "digest"], "left_anti")


def append_summary(spark: SparkSession, row: dict, path: str) -> None:
    """Append one row per configuration to a summary table."""
    spark.createDataFrame([row]).write.mode("append").parquet(path)


def profile(df: DataFrame, key: str, day: str, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, known share, day range, distinct keys; one pass over the table."""
    common = [F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("first_d"), F.max(day).alias("last_d"),
              F.count_distinct(key).alias("n_keys")]
    wide = df.agg(*common, *[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("missing")) for c in columns]))
    return wide.select("n_rows", "first_d", "last_d", "n_keys", rows.alias("e")).select(
        "e.column", "e.missing", "n_rows", "first_d", "last_d", "n_keys"
    )


def missing_days(df: DataFrame, calendar: DataFrame, day: str = "d") -> DataFrame:
    """Calendar days without any row."""
    return calendar.select(day).join(df.select(day).distinct(), day, "left_anti")


def last_day_coverage(df: DataFrame, key: str = "sym", day: str = "d") -> DataFrame:
    """Per key the last day seen and whether it is the table's last day."""
    newest = df.agg(F.max(day).alias("_newest"))
    return (
        df.groupBy(key).agg(F.max(day).alias("last_d"))
        .transform(attach_row, newest)
        .select(key, "last_d", (F.col("last_d") == F.col("_newest")).alias("is_current"))
    )


def trigger_rates(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing share and rate of ones per flag column."""
    aggs = []
    for f in flags:
        aggs += [F.avg(F.col(f).isNull().cast("double")).alias(f"{f}_missing"), F.avg(F.col(f)).alias(f"{f}_rate")]
    return df.groupBy(*by).agg(*aggs)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Each value's count and its share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    whole = df.agg(F.count(F.lit(1)).alias("_all"))
    return attach_row(counts, whole).withColumn("share", F.col("rows") / F.col("_all")).drop("_all")


def label_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Integer code of a text column: missing becomes 'missing', codes follow the sorted distinct values."""
    filled = df.withColumn("_v", F.coalesce(F.col(column), F.lit("missing")))
    codes = positions(filled.select("_v").distinct(), [], ["_v"], "_p").select("_v", (F.col("_p") - 1).cast("long").alias(out))
    return filled.join(codes, "_v").drop("_v")


def with_date_offsets(df: DataFrame, day: str, offsets: Sequence[int]) -> DataFrame:
    return df.withColumns({f"{day}_minus_{k}": F.date_sub(day, k) for k in offsets})
