"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame functions only.

The rows lie in logical blocks (by hash). How many rows each block sends to each shard is drawn exactly, as it would be
under a uniform permutation of all rows: the blocks are halved again and again, and each time the left half's count for
every shard comes from the hypergeometric law given what its parent has. Then each block permutes its own rows and
deals them by its counts, the shards receive them, and each permutes what it has received. No task holds a shard: within a shard
the order is by buckets of the second key, whose counts give each bucket's first slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftspark.llm.common import save

SHARDS = 24
SEED = 20240601
#: Rows of a block, about; blocks are at least 64 and a power of two.
BLOCK_ROWS = 500_000


def _uniform(*columns):
    """In (0, 1), from a hash: the same whenever a task is run again."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def hypergeometric(total, marked, drawn, u):
    """The value at u of the inverse distribution function of the number of marked items among ``drawn`` out of ``total``.

    The weights run over 12 standard deviations on both sides of the mode (all values, if fewer); what lies beyond has
    less than 1e-30 of the probability, under the resolution of u. A column of longs.
    """
    d = lambda c: c.cast("double")
    p = d(marked) / d(total)
    spread = F.sqrt(d(drawn) * p * (1 - p) * d(total - drawn) / F.greatest(d(total) - 1, F.lit(1.0)))
    width = F.ceil(12 * spread).cast("long") + 10
    mode = F.floor(d(drawn + 1) * d(marked + 1) / (d(total) + 2)).cast("long")
    low = F.greatest(drawn - (total - marked), F.lit(0).cast("long"), mode - width)
    high = F.least(drawn, marked, mode + width)

    def grow(state, k):  # the weight of k from that of k - 1, and their sum
        w = state["w"] * (d(marked) - k + 1) * (d(drawn) - k + 1) / (d(k) * (d(total) - marked - drawn + k))
        return F.struct(w.alias("w"), (state["t"] + w).alias("t"))

    first = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t"))
    steps = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<bigint>"))
    whole = F.aggregate(steps, first, grow)["t"]

    def seek(state, k):
        w = state["w"] * (d(marked) - k + 1) * (d(drawn) - k + 1) / (d(k) * (d(total) - marked - drawn + k))
        on = state["t"] <= state["goal"]
        return F.struct(w.alias("w"), (state["t"] + w).alias("t"), state["goal"].alias("goal"), F.when(on, k).otherwise(state["k"]).alias("k"))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t"), (u * whole).alias("goal"), low.alias("k"))
    inverse = F.aggregate(steps, start, seek)["k"]
    return F.when((total <= 0) | (drawn <= 0) | (marked <= 0), F.lit(0).cast("long")).when(high <= low, high).otherwise(inverse)


def _left_counts(lo, size, counts, caps, seed: int):
    """For a node with blocks of these counts: what its left half sends to each shard, shard after shard."""
    total = F.aggregate(caps, F.lit(0).cast("long"), lambda a, x: a + x)
    left = F.aggregate(F.slice(counts, 1, (F.size(counts) / 2).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    first = F.struct(total.alias("r"), left.alias("m"), F.array().cast("array<bigint>").alias("out"))

    def one(state, cap):
        u = _uniform(lo, size, F.size(state["out"]), F.lit(seed))
        # a one-element array binds the draw to a name, so that it is drawn once
        drawn = F.transform(F.array(hypergeometric(state["r"], cap, state["m"], u)), lambda x: F.struct((state["r"] - cap).alias("r"), (state["m"] - x).alias("m"), F.concat(state["out"], F.array(x)).alias("out")))
        return drawn[0]

    return F.aggregate(caps, first, one)["out"]


def communication_matrix(counts: DataFrame, blocks: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(block, n) to (block, sends array<long>): exact counts, rows adding up to n and columns to the shards' sizes, which
    differ by one at most. blocks is a power of two."""
    spine = counts.sparkSession.range(blocks).withColumnRenamed("id", "block").join(counts, "block", "left").select("block", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    node = spine.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "n"))), lambda x: x["n"]).alias("counts"))  # one number for each block
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    caps = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(total / shards) + F.when(s < total % shards, 1).otherwise(0))
    node = node.select(F.lit(0).cast("long").alias("lo"), "counts", F.transform(caps, lambda x: x.cast("long")).alias("caps"))
    size = blocks
    while size > 1:
        half = size // 2
        drawn = _left_counts(F.col("lo"), F.lit(size), F.col("counts"), F.col("caps"), seed)
        both = F.flatten(F.transform(F.array(drawn), lambda left: F.array(
            F.struct(F.col("lo").alias("lo"), F.slice("counts", 1, half).alias("counts"), left.alias("caps")),
            F.struct((F.col("lo") + half).alias("lo"), F.slice("counts", half + 1, half).alias("counts"), F.zip_with("caps", left, lambda a, b: a - b).alias("caps")),
        )))
        node = node.select(F.explode(both).alias("n")).select("n.*")
        size = half
        if blocks // size == 16:
            node = node.repartition("lo")
    return node.select(F.col("lo").alias("block"), F.col("caps").alias("sends"))


def _copies(rows: DataFrame) -> DataFrame:
    """rows (row, doc_id, text_crc32, size) with copy: equal rows numbered from 0. They are numbered within the part of the input that
    they stand in, and the parts' counts tell where each begins, so no task meets all copies of a row."""
    same = ["doc_id", "text_crc32", "size"]
    rows = rows.withColumn("part", F.shiftright("row", 33))  # the high bits of an increasing id
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy(*same, "part").orderBy("row")))
    ends = rows.groupBy(*same, "part").agg(F.max("at").alias("n"))
    before = ends.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(*same).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.where("before > 0").select(*(F.col(c).alias(f"_{c}") for c in (*same, "part")), "before")
    on = rows["part"] == before["_part"]
    for c in same:
        on = on & rows[c].eqNullSafe(before[f"_{c}"])
    return rows.join(before, on, "left").select("row", *same, (F.col("at") - 1 + F.coalesce("before", F.lit(0))).alias("copy"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs (doc_id, text, …) to one row per input row: doc (the row as a struct), doc_id, size (UTF-8 bytes of the text plus
    8), text_crc32, shard (0 to shards - 1), slot (from 0, without gaps).

    Shards differ by one row at most. Null text: size 8, null text_crc32. Null and repeated doc_ids are rows like others; equal
    rows are numbered and dealt independently of each other. Very long texts are rows like others. Fewer rows than shards leave some empty; an empty table gives no rows. Other columns stay in ``doc``.
    """
    raw = F.encode(F.col("text").cast("string"), "UTF-8")
    # written once with a number for each row: all that follows moves numbers, and the rows themselves move once, at the end
    base = docs.select(F.struct("*").alias("doc"), "doc_id", (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    base = save(base, "numbered-rows")
    slim = save(_copies(base.select("row", "doc_id", "text_crc32", "size")), "numbered-copies")
    n = slim.count()
    blocks = 64
    while blocks * block_rows < n:
        blocks *= 2

    def key(salt):
        first = F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed + salt))
        return F.when(F.col("copy") == 0, first).otherwise(F.xxhash64(first, "copy"))

    counts = slim.select(F.pmod(key(0), F.lit(blocks)).alias("block")).groupBy("block").agg(F.count("*").alias("n"))
    matrix = communication_matrix(counts, blocks, shards, seed)
    # the first permutation, in each block; then its rows go to the shards by its counts
    local = slim.withColumn("block", F.pmod(key(0), F.lit(blocks))).withColumn("k", F.row_number().over(W.partitionBy("block").orderBy(key(1), "doc_id", "copy")))
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice("sends", 1, s), F.lit(0).cast("long"), lambda a, x: a + x))
    dealt = local.join(matrix.select("block", upto.alias("upto")), "block")
    dealt = dealt.select("row", "doc_id", "copy", F.size(F.filter("upto", lambda x: x < F.col("k"))).alias("shard"), key(2).alias("r"))
    # the second permutation: by r within the shard, in buckets of r's range
    bits = max(4, min(40, (max(n, 1) // (shards * 20_000)).bit_length()))
    dealt = dealt.withColumn("bucket", F.shiftright("r", 64 - bits))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    starts = sizes.select("shard", "bucket", first.alias("first"))
    place = dealt.withColumn("at", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("r", "doc_id", "copy")))
    slots = place.join(starts, ["shard", "bucket"]).select("row", "shard", (F.col("first") + F.col("at") - 1).alias("slot"))
    return base.join(slots, "row").select("doc", "doc_id", "size", "text_crc32", "shard", "slot")
