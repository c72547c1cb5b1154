"""What several operators share: words, scratch tables, connected components."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.sources.scratch import new_folder, shared_dir  # noqa: F401

#: A word of the contracts: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    """Number of words of a text column; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches, rows: int = 256):
    """Arrow batches cut into short ones. Spark bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by
    default); this bounds how many texts are Python objects at once, without a change to the session."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def tidy_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, in which the shuffle files of a write go as soon as it ends. Tables that are
    written in between hold what is needed, so none of these files is read again."""
    tidy = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if tidy.conf.isModifiable(key) and tidy.conf.get(key, None) != value:
            tidy.conf.set(key, value)
    for key in ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"):
        tidy.conf.set(key, "true")
    return tidy


class Saved:
    """A table written once to the shared folder; ``df`` reads it back, in ``reader`` if that is given, so a lost executor loses nothing. options: the writer's."""

    def __init__(self, df: DataFrame, name: str, reader: SparkSession | None = None, by: list[str] | None = None, options: dict[str, str] | None = None):
        self.spark = reader or df.sparkSession
        self.path, self.schema = new_folder(self.spark, name), df.schema
        (df.write.partitionBy(*by) if by else df.write).options(**options or {}).parquet(self.path)
        self.df = self.read(self.spark)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; only for tables that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, name: str) -> DataFrame:
    return Saved(df, name).df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) links to (node, component), component being the smallest node that can be reached.

    Minimum labels spread along the links, and each round also jumps to the label's label, so the number of rounds
    grows with the logarithm of a chain's length; links that need more than ``max_rounds`` raise an error, none is dropped. A hot node is only ever the key of a partial aggregation or the
    skewed side of a join. Null ends and loops are ignored; no links give no rows.
    """
    both = Saved(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.*").distinct(),
        "links",
    )
    links = both.df
    labels = Saved(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        old = labels.df
        least = links.join(old.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        spread = old.join(least, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        step = Saved(spread, "spread")
        jump = step.df.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = Saved(step.df.join(jump, "component").select("node", "was", F.col("next").alias("component")), "labels")
        changed = new.df.where("component <> was").limit(1).count()
        step.drop()
        labels.drop()
        labels = new
        if not changed:
            return labels.df.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
