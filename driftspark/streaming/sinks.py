"""Sinks for micro-batches: keyed upsert, insert if absent, append, and several of them from one batch.

A keyed table is Parquet, parted by a hash of its keys. A batch reads and rewrites only the parts that its keys fall into (Spark's dynamic
partition overwrite), so its cost goes with the batch and not with the table. The outcome for a key depends on the rows
alone, so a batch that runs again, also after it was stopped between two parts or two sinks, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftspark.operators import ledger
from driftspark.params import DEFAULTS, Params
from driftspark.sources.scratch import saved

#: Parts of a keyed table.
PARTS = 64
PART = "key_part"


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """None also where a batch was stopped before it had written anything."""
    if not _exists(spark, path):
        return None
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    return spark.read.parquet(path) if any(n.startswith(f"{PART}=") for n in names) else None


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A keyed table, or None."""
    got = _read(spark, path)
    return None if got is None else got.drop(PART)


def _parted(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    return df.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))


def rewrite(df: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], batch_id: int | None = None, parts: int = PARTS) -> None:
    """merge(old rows or None, new rows) takes the place of the parts that the new rows' keys fall into. A batch that has been written whole
    leaves a mark and is not written again."""
    spark = df.sparkSession
    mark = f"{path}/_applied/{batch_id}"  # readers pass over names that begin with an underscore
    if batch_id is not None and _exists(spark, mark):
        return
    new = saved(_parted(df, keys, parts), "batch")  # it is read twice, and a batch may not be computed alike twice
    hit = [r[0] for r in new.select(PART).distinct().collect()]  # parts at most
    if not hit:
        return  # nothing to write, nothing to mark
    old = _read(spark, path)
    old = None if old is None else old.where(F.col(PART).isin(hit)).drop(PART)
    out = saved(_parted(merge(old, new.drop(PART)), keys, parts), "parts")  # the parts are read before they are overwritten
    out.repartition(len(hit), PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    if batch_id is not None:
        root = spark._jvm.org.apache.hadoop.fs.Path(mark)
        root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(root).close()


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key; of equal ones by order that of the least hash over all columns."""
    w = W.partitionBy(*keys).orderBy(*order, F.xxhash64(*df.columns))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(df: DataFrame, path: str, keys: list[str], order: str, batch_id: int | None = None, parts: int = PARTS) -> None:
    """The last row by ``order`` wins for each key; of several such rows that of the least hash over all columns."""
    rewrite(df, path, keys, lambda old, new: _first(new if old is None else old.unionByName(new, allowMissingColumns=True), keys, F.desc(order)), batch_id, parts)


def insert_ignore(df: DataFrame, path: str, keys: list[str], batch_id: int | None = None, parts: int = PARTS) -> None:
    """Rows whose key isn't there yet; of several in the batch that of the least hash over all columns."""

    def merge(old, new):
        new = _first(new, keys)
        return new if old is None else old.unionByName(new.join(old.select(*keys), keys, "left_anti"))

    rewrite(df, path, keys, merge, batch_id, parts)


def merge_landings(changed: DataFrame, path: str, batch_id: int | None = None, p: Params = DEFAULTS) -> None:
    """The landing record after these changes (see ``operators.ledger``); of other events nothing."""
    rewrite(ledger.changes(changed), path, ledger.KEY, lambda old, new: ledger.merged(old, new, p), batch_id)


def append_predictions(df: DataFrame, path: str, batch_id: int) -> None:
    """Predictions (serial, launch_t, predicted_t, path, …) by launch day, a folder per batch in it that is overwritten if the batch runs again, and
    each flight's latest path: ``predictions`` and ``paths`` under path. Stopped between the two, the batch runs again and both hold it once."""
    rows = saved(df.withColumn("launch_day", F.to_date(F.timestamp_seconds("launch_t"))).withColumn("batch", F.lit(batch_id)), "predictions")
    rows.drop("path").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("launch_day", "batch").parquet(f"{path}/predictions")
    upsert(rows.where("path is not null").select("serial", "launch_t", "predicted_t", "path"), f"{path}/paths", ["serial", "launch_t"], "predicted_t", batch_id)


def append(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch, overwritten if the batch runs again."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def into(write: Callable[..., None], *args) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch."""
    return lambda df, batch_id: write(df, *args, batch_id)


def freshness(frames: DataFrame, now_t: float, limit_s: float = 120.0) -> DataFrame:
    """One row: age of the newest frame, and whether that is fresh."""
    age = F.lit(now_t) - F.max("t")
    return frames.agg(age.alias("age_s"), F.coalesce(age <= limit_s, F.lit(False)).alias("fresh"))
