"""Scalar helpers: null/NaN handling, dates, error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date-time text formats tried in turn when parsing.
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def safe_float(c: Column) -> Column:
    """null or NaN → 0.0, anything else as double."""
    d = c.cast("double")
    return F.coalesce(F.nanvl(d, F.lit(None).cast("double")), F.lit(0.0))


def no_nan(c: Column) -> Column:
    """NaN → null (so max/min skip it, as they skip nulls)."""
    d = c.cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    numeric = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType,
               T.ByteType, T.BooleanType, T.DecimalType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, numeric) and f.name not in exclude]


def double_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.DoubleType) and f.name not in exclude]


def fill_missing(df: DataFrame, cols: list[str] | None = None, value: float = 0.0) -> DataFrame:
    """null and NaN → value in one projection; numeric columns become double."""
    cols = numeric_columns(df) if cols is None else cols
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"),
                                                 F.lit(None).cast("double")),
                                         F.lit(float(value))) for c in cols})


def cast_float(df: DataFrame, cols: list[str], strict: bool = True) -> DataFrame:
    """Cast to double; non-strict turns unparsable values into null."""
    cast = (lambda c: F.col(c).cast("double")) if strict else \
        (lambda c: F.col(c).try_cast("double"))
    return df.withColumns({c: cast(c) for c in cols})


def any_nan_row(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row frame: per column, does any NaN or null remain."""
    return df.agg(*[F.coalesce(F.bool_or(F.isnan(F.col(c)) | F.col(c).isNull()),
                               F.lit(False)).alias(c) for c in cols])


def assert_no_nan(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Raise naming every column that still holds NaN/null; one pass, one row back."""
    cols = double_columns(df) if cols is None else cols
    if not cols:
        return df
    row = any_nan_row(df, cols).first()
    bad = [c for c in cols if row is not None and row[c]]
    if bad:
        raise AssertionError(f"columns that still hold NaN or null: {bad}")
    return df


# --- zone-free timestamp arithmetic --------------------------------------------
# TIMESTAMP_NTZ values are wall-clock readings; converting them through a
# cast to TIMESTAMP would depend on the session time zone (and skip or
# repeat an hour at DST changes). These helpers never consult the zone.

def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def ntz_epoch_micros(c: Column) -> Column:
    """Micros since 1970-01-01 00:00 of a TIMESTAMP_NTZ, read as UTC."""
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), c)


def ntz_from_epoch_micros(m: Column) -> Column:
    """TIMESTAMP_NTZ whose UTC reading is the given epoch micros."""
    return F.timestamp_add("MICROSECOND", m.cast("long"), _epoch_ntz())


def epoch_micros(c: Column, dtype: T.DataType) -> Column:
    """Epoch micros of a timestamp column of either kind."""
    if isinstance(dtype, T.TimestampNTZType):
        return ntz_epoch_micros(c)
    return F.unix_micros(c.cast("timestamp"))


def utc_instant(c: Column, dtype: T.DataType) -> Column:
    """An event-time TIMESTAMP for watermarks and windows; NTZ is read as UTC."""
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_micros(ntz_epoch_micros(c))
    return c.cast("timestamp")


def utc_date(c: Column) -> Column:
    """UTC calendar day of a TIMESTAMP instant, independent of the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int"))


def parse_datetime(c: Column) -> Column:
    """Text in any of the accepted formats → timestamp; unparsable → null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATETIME_FORMATS])


def iso_weekday(d: Column) -> Column:
    """ISO weekday, Monday=1 .. Sunday=7."""
    return (F.weekday(d) + F.lit(1)).cast("int")


def greatest_nan_safe(cols: list[Column], floor: float) -> Column:
    """max over columns and a constant, ignoring NaN and null."""
    return F.greatest(*[no_nan(c) for c in cols], F.lit(float(floor)))


# --- error metrics (aggregate expressions) ---------------------------------

def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(y: Column, p: Column) -> Column:
    """Mean absolute percentage error ×100; null when any actual is 0."""
    return F.when(F.bool_and(y != 0), F.avg(F.abs(F.try_divide(y - p, y))) * F.lit(100.0))
