import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from driftspark.llm import sharding

DOCS = "doc_id long, text string, shard string, block int"


def docs(spark, n):
    return spark.createDataFrame([(i % 97 if i % 5 else None, f"é text {i % 11}" if i % 3 else None, "s", i) for i in range(n)], DOCS)


def test_exact_sizes_and_slots(spark):
    got = sharding.shard(docs(spark, 1000)).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1000 and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s])) for s in sizes)
    for r in got:
        text = r.doc.text
        assert r.size == (len(text.encode()) if text else 0) + 8 and r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
        assert r.doc.shard == "s"


def test_few_rows_and_none(spark):
    assert sorted(r.slot for r in sharding.shard(docs(spark, 3)).collect()) == [0, 0, 0]
    assert sharding.shard(docs(spark, 0)).count() == 0


def test_same_again_and_another_seed(spark):
    key = lambda df: sorted((r.doc.block, r.shard, r.slot) for r in df.collect())
    d = docs(spark, 300).withColumn("doc_id", F.col("block").cast("long"))
    assert key(sharding.shard(d)) == key(sharding.shard(d.repartition(7)))
    assert key(sharding.shard(d)) != key(sharding.shard(d, seed=5))


def test_hypergeometric_law(spark):
    u = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    x = np.array([r[0] for r in u.select(sharding.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), F.col("u"))).collect()])
    from math import comb

    want = np.array([comb(20, k) * comb(30, 10 - k) / comb(50, 10) for k in range(11)])
    assert np.abs(np.bincount(x, minlength=11) / 20_000 - want).max() < 1e-3


def test_matrix_adds_up(spark):
    n = [5, 0, 17, 100, 3, 0, 40, 9]
    rows = sharding.communication_matrix(spark.createDataFrame(list(enumerate(n)), "block long, n long"), 8, 5).collect()
    m = {r.block: r.sends for r in rows}
    assert [sum(m[i]) for i in range(8)] == n
    assert sorted(sum(m[i][s] for i in range(8)) for s in range(5)) == [34, 35, 35, 35, 35] and min(map(min, m.values())) >= 0


def test_whole_result_against_brute_force(spark):
    d = docs(spark, 700)
    raw = F.encode("text", "UTF-8")
    size, crc = (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long"), F.crc32(raw)
    numbered, seen = [], Counter()
    for r in d.select("doc_id", size.alias("size"), crc.alias("crc")).collect():
        numbered.append((*r, seen[r]))
        seen[r] += 1
    assert max(seen.values()) > 1
    rows = spark.createDataFrame(numbered, "doc_id int, size long, crc long, copy long").withColumn("doc_id", F.col("doc_id").cast("long"))
    plain = [F.xxhash64("doc_id", "crc", "size", F.lit(sharding.SEED + k)) for k in range(3)]
    rows = rows.select("*", *(F.when(F.col("copy") == 0, k).otherwise(F.xxhash64(k, "copy")).alias(f"k{i}") for i, k in enumerate(plain))).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r.k0 % 64, []).append(r)
    n = spark.createDataFrame([(b, len(x)) for b, x in blocks.items()], "block long, n long")
    sends = {r.block: r.sends for r in sharding.communication_matrix(n, 64).collect()}
    shards = [[] for _ in range(24)]
    for b, x in blocks.items():  # the local permutation, dealt by the block's counts
        x.sort(key=lambda r: r.k1)
        for s, m in enumerate(sends[b]):
            shards[s] += x[:m]
            del x[:m]
        assert not x
    want = Counter()
    for s, x in enumerate(shards):  # the second permutation
        x.sort(key=lambda r: r.k2)
        want.update((r.doc_id, r.size, r.crc, s, k) for k, r in enumerate(x))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(d).collect()) == want


def test_equal_rows_part(spark):
    d = spark.range(2000).select((F.col("id") % 1000).alias("doc_id"), F.lit("text").alias("text")).unionByName(spark.range(20_000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("hot").alias("text")))
    by = {}
    for r in sharding.shard(d).collect():
        by.setdefault(r.doc_id, []).append((r.shard, r.slot))
    hot = Counter(s for s, _ in by.pop(-1))
    assert all(700 < hot[s] < 970 for s in range(24))
    together = [x for x in by.values() if x[0][0] == x[1][0]]
    assert 15 < len(together) < 80 and sum(abs(x[0][1] - x[1][1]) == 1 for x in together) < 4


def test_long_text_is_a_row_like_others(spark):
    got = sharding.shard(spark.createDataFrame([(1, "é" * 500_000, "s", 1), (2, "", "s", 2)], DOCS)).collect()
    assert sorted(r.size for r in got) == [8, 1_000_008]
