"""Sinks: atomic by the commit protocol, resumable by what is already written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Replaces a parquet table; readers see the old or the new one."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_pending(wanted: DataFrame, done: DataFrame, key: str, path: str, limit: int | None = None) -> DataFrame:
    """Appends the wanted rows whose key isn't done yet, at most `limit` of them by key (null or not positive: all), and returns them."""
    pending = wanted.join(done.select(key).distinct(), key, "left_anti")
    if limit and limit > 0:
        pending = pending.orderBy(key).limit(limit)
    pending.write.mode("append").parquet(path)
    return pending


def require_complete(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows, if every wanted key is among them; otherwise raises."""
    missing = wanted.select(key).distinct().join(rows.select(key), key, "left_anti").agg(F.count("*")).head()[0]
    if missing:
        raise ValueError(f"{missing} wanted rows are missing")
    return rows
