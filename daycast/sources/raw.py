"""Raw minute files: read, validate, convert epoch seconds to timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daycast.functions.values import ntz_from_epoch_micros
from daycast.sources.schemas import OHLCV_CSV

# The processed table keeps these columns, in this order.
PROCESSED_COLUMNS = ["Datetime", "Timestamp", "Open", "High", "Low", "Close", "Volume"]
# Fixed value: a maximum epoch above this is milliseconds, not seconds.
EPOCH_SECONDS_LIMIT = 1e12


CORRUPT = "_corrupt_record"


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the file's header; reads its first line only."""
    return spark.read.option("header", True).csv(path).columns


def scan_ohlcv_csv(spark: SparkSession, path: str, rejects: bool = False,
                   report: Observation | None = None):
    """Minute OHLCV CSV with header, columns taken by name in any order.

    The types are fixed, never inferred; columns beyond the known ones stay text; a
    missing one raises; every file's header is checked against the first one's. A
    malformed row fails the read, or with ``rejects`` the result is a pair of good
    rows and rejected rows (their text in ``_corrupt_record``). Both are ordinary
    frames: they can be counted, projected and written. ``report`` then gets, in the
    pass of the first action on either, ``rows`` read, ``rejected`` ones, good ones
    whose epoch is in ``milliseconds`` and ``headers`` (see ``check_report``).
    """
    names = csv_header(spark, path)
    known = {f.name: f.dataType for f in OHLCV_CSV.fields}
    missing = [c for c in known if c not in names]
    if missing:
        raise ValueError(f"the file has no columns {missing}")
    schema = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in names])
    if not rejects:
        return spark.read.option("header", True).option("enforceSchema", False) \
            .schema(schema).option("mode", "FAILFAST").csv(path)
    # lines are read as text and split by from_csv, so no later projection can
    # prune the columns that tell a malformed line
    lines = spark.read.text(path)
    header = lines.first()["value"]
    shape = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    split = F.from_csv(F.col("value"), shape.simpleString()[7:-1].replace(":", " "),
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    is_header = F.col("value") == F.lit(header)
    rows = lines.where(F.trim("value") != "").select(is_header.alias("_header"), split.alias("_row"))
    bad = F.col(f"_row.{CORRUPT}").isNotNull()
    if report is not None:
        one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        body = ~F.col("_header")
        rows = rows.observe(report, one(body).alias("rows"), one(body & bad).alias("rejected"),
                            one(body & ~bad & F.coalesce(F.col("_row.Timestamp") > EPOCH_SECONDS_LIMIT,
                                                         F.lit(False))).alias("milliseconds"),
                            one(F.col("_header")).alias("headers"))
    rows = rows.where(~F.col("_header"))
    return rows.where(~bad).select(*[F.col(f"_row.`{c}`").alias(c) for c in names]), \
        rows.where(bad).select("_row.*")


def check_report(report: Observation, files: int | None = None, most_rejected: float = 1.0) -> dict:
    """The counts of a scan that set rows aside; raises when epochs are in
    milliseconds, when a larger share than ``most_rejected`` was rejected, or when
    not each of ``files`` files had the first one's header."""
    got = report.get
    if got["milliseconds"]:
        raise ValueError(f"{got['milliseconds']} rows hold milliseconds, seconds are needed")
    if files is not None and got["headers"] != files:
        raise ValueError(f"{got['headers']} of {files} files have the header of the first")
    if got["rejected"] > most_rejected * got["rows"]:
        raise ValueError(f"{got['rejected']} of {got['rows']} rows are malformed")
    return got


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail on the driver, without a job, when columns are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df


def epoch_unit_check(df: DataFrame, col: str = "Timestamp") -> DataFrame:
    """One-row frame: the largest epoch value and whether it is in seconds."""
    mx = F.max(F.col(col).cast("double"))
    return df.agg(mx.alias("max_epoch"),
                  F.coalesce(mx <= F.lit(EPOCH_SECONDS_LIMIT), F.lit(True)).alias("is_seconds"))


def check_epoch_unit(df: DataFrame, col: str = "Timestamp") -> DataFrame:
    """Raise when the epoch column looks like milliseconds.

    One global aggregate (partial per task, a single final row), so the
    driver only ever sees one value.
    """
    row = epoch_unit_check(df, col).first()
    if row is not None and not row["is_seconds"]:
        raise ValueError(f"{col} holds milliseconds, seconds are needed")
    return df


def epoch_seconds(df: DataFrame, col: str = "Timestamp") -> DataFrame:
    """The same check inside the projection: a value in milliseconds fails the job
    that reads it, so no pass of its own is needed."""
    v = F.col(col).cast("double")
    return df.withColumn(col, F.when(v > EPOCH_SECONDS_LIMIT, F.raise_error(F.lit(
        f"{col} holds milliseconds, seconds are needed")).cast("double")).otherwise(v))


def epoch_to_ts(df: DataFrame, col: str = "Timestamp", out: str = "Datetime") -> DataFrame:
    """Epoch seconds (possibly fractional) to a zone-free timestamp."""
    micros = F.round(F.col(col).cast("double") * F.lit(1_000_000)).cast("long")
    return df.withColumn(out, ntz_from_epoch_micros(micros))


def select_required(df: DataFrame) -> DataFrame:
    require_columns(df, PROCESSED_COLUMNS)
    return df.select(*PROCESSED_COLUMNS)


def preprocess(df: DataFrame) -> DataFrame:
    """Raw minute frame → processed frame (checks, Datetime, fixed columns)."""
    require_columns(df, ["Timestamp"])
    return select_required(epoch_to_ts(epoch_seconds(df)))


def processed_to_ticks(df: DataFrame, symbol: str = "SERIES") -> DataFrame:
    """Processed single-series frame → tick frame with an explicit key."""
    return df.select(
        F.lit(symbol).alias("symbol"),
        F.col("Datetime").alias("ts"),
        F.col("Timestamp").cast("long").alias("seq"),
        "Open", "High", "Low", "Close", "Volume",
    )
