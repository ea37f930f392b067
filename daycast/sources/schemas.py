"""Fixed schemas of every table the engine reads or writes."""

from pyspark.sql import types as T

# Raw minute file: epoch seconds plus OHLCV, header row.
OHLCV_CSV = T.StructType([
    T.StructField("Timestamp", T.DoubleType()),
    T.StructField("Open", T.DoubleType()),
    T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()),
    T.StructField("Close", T.DoubleType()),
    T.StructField("Volume", T.DoubleType()),
])

# Tick frame every bar operator consumes (one row per trade / minute).
TICKS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
    T.StructField("Open", T.DoubleType()),
    T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()),
    T.StructField("Close", T.DoubleType()),
    T.StructField("Volume", T.DoubleType()),
])

# Run index of the forecast store.
RUNS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("run_date", T.DateType()),
    T.StructField("horizon", T.IntegerType()),
    T.StructField("rows_count", T.LongType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
])

# Current (merged) forecast of the store.
CURRENT = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("target_date", T.DateType()),
    T.StructField("prediction", T.DoubleType()),
    T.StructField("run_date", T.DateType()),
])

# One forecast row of an uploaded payload.
FORECAST_ROW = T.StructType([
    T.StructField("target_date", T.StringType()),
    T.StructField("prediction", T.DoubleType()),
])

# Uploaded payload: rows nested in one record, exploded on read.
FORECAST_PAYLOAD = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("run_date", T.StringType()),
    T.StructField("horizon", T.IntegerType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("force", T.BooleanType()),
    T.StructField("rows", T.ArrayType(FORECAST_ROW)),
])

CV_METRICS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("fold", T.IntegerType()),
    T.StructField("train_start", T.DateType()),
    T.StructField("train_end", T.DateType()),
    T.StructField("test_start", T.DateType()),
    T.StructField("test_end", T.DateType()),
    T.StructField("MAE", T.DoubleType()),
    T.StructField("RMSE", T.DoubleType()),
    T.StructField("MAPE", T.DoubleType()),
])
