"""How many parts a large shuffle is dealt into: by the size of what is read, so that a task's share stays the same when the tables grow."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of Parquet that one part comes from; some 200 000 frames, sorted in about 60 MB.
PART_BYTES = 4 << 20


def parts(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """At least one for each ``part_bytes`` of the files that df reads."""
    spark = df.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in set(df.inputFiles())]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return -(-sum(x.getFileSystem(conf).getFileStatus(x).getLen() for x in paths) // part_bytes)


def dealt(df: DataFrame, *keys: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """df dealt by the keys into that many parts, if Spark's own number of shuffle partitions is smaller; grouping and windows by these keys
    then need no other shuffle."""
    n = parts(df, part_bytes)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, *keys)
