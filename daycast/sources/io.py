"""Parquet scans and sinks of the pipeline tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daycast.sources.raw import PROCESSED_COLUMNS, preprocess, scan_ohlcv_csv


def scan_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


BUCKETS = 64          # folders of the feature table, whatever the number of symbols
BUCKET = "symbol_bucket"


def _bucket(symbol):
    return F.pmod(F.xxhash64(symbol), F.lit(BUCKETS)).cast("int")


def scan_features(spark: SparkSession, path: str, columns: list[str] | None = None,
                  symbols: list[str] | None = None) -> DataFrame:
    """Feature table; a column list prunes the scan, a symbol list prunes the
    folders of other symbols' buckets."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.where(F.col(BUCKET).isin([_bucket(F.lit(x)) for x in symbols])
                      & F.col("symbol").isin(symbols))
    return df.select(*columns) if columns else df.drop(BUCKET)


def sink_processed(df: DataFrame, path: str) -> None:
    df.select(*PROCESSED_COLUMNS).write.mode("overwrite").parquet(path)


def sink_features(df: DataFrame, path: str) -> None:
    """A fixed number of folders by the symbol's hash, one file each: a read of one
    series prunes the rest, and many symbols do not make many files. A symbol's
    bucket is replaced as a whole, so the frame holds all symbols of its buckets."""
    (df.withColumn(BUCKET, _bucket(F.col("symbol"))).repartition(BUCKET)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(BUCKET).parquet(path))


def sink_cv_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sink_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv_to_processed(spark: SparkSession, csv_path: str, out_path: str) -> DataFrame:
    """Raw minute CSV → checks → processed Parquet; returns the written frame."""
    df = preprocess(scan_ohlcv_csv(spark, csv_path))
    sink_processed(df, out_path)
    return spark.read.parquet(out_path)
