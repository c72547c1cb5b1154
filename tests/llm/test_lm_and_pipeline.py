import glob
import math
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from driftspark.llm import common, lm_score
from driftspark.llm.minhash import shingle_set

DOCS = "doc_id long, text string, s string"


def brute(rows, order=3, backoff=0.4, least=2):
    docs = [(i, (t or "").lower().split()) for i, t in rows]
    grams = Counter(tuple(w[k - n : k]) for _, w in docs for n in range(1, order + 1) for k in range(n, len(w) + 1))
    total = sum(len(w) for _, w in docs)

    def score(w, k):
        f = 1.0
        for n in range(min(order, k), 1, -1):
            g = tuple(w[k - n : k])
            if grams[g] >= least:
                return math.log(f * grams[g] / grams[g[:-1]])
            f *= backoff
        return math.log(f * grams[tuple(w[k - 1 : k])] / total)

    out = []
    for i, w in docs:
        # a text's start lacks the longer n-grams, and backs off through them
        out.append((i, len(w), round(sum(score(w, k) + math.log(backoff) * (order - min(order, k)) for k in range(1, len(w) + 1)), 4)))
    return sorted(out, key=str)


def test_scores_against_brute_force(spark):
    rows = [(1, "a b c a b c d"), (2, "A b\tc x"), (2, "A b\tc x"), (3, None), (None, "a b c"), (4, " "), (5, "only once seen words")]
    got = lm_score.lm_scores(spark.createDataFrame([(i, t, "z") for i, t in rows], DOCS)).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 4)) for r in got), key=str) == brute(rows)
    assert lm_score.lm_scores(spark.createDataFrame([], DOCS)).count() == 0


def test_other_orders(spark):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(20))) for i in range(10)]
    for n in (1, 2, 4):
        got = lm_score.lm_scores(spark.createDataFrame([(i, t, "") for i, t in rows], DOCS), order=n).collect()
        want = {i: s for i, _, s in brute(rows, n)}
        assert all(abs(r.log_score - want[r.doc_id]) < 2e-4 for r in got)


def test_shared_dir_is_the_session_s(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = common.save(stage(spark, before, small), name)
        sizes.append((name, before.count(), after.count()))
        if name == "minhash_near_dedup":
            sets = {r.doc_id: shingle_set(r.text) for r in after.collect()}
            ids = sorted(sets)
            assert not any((n := len(sets[a] & sets[b])) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) for k, a in enumerate(ids) for b in ids[:k])
        if name != "sharding":
            assert after.columns == docs.columns
        before = after
    assert before.columns == [*docs.columns, "shard", "slot"] and all(a >= 1 for _, _, a in sizes)
    labels = duckdb.sql(f"select doc_id from '{small}/labels.parquet' where toxic = 1").fetchall()
    assert sizes[0][2] <= sizes[0][1] and len(labels) > 0 and sizes[1][2] < sizes[1][1] and sizes[4][1] == sizes[4][2]


def test_no_operator_changes_the_session(spark):
    from driftspark.llm import embed_dedup

    before = dict(spark.conf.getAll)
    docs = spark.createDataFrame([(1, "a b c a b c", ""), (2, "a b c", "")], DOCS)
    scores = lm_score.lm_scores(docs)
    embed_dedup.near_vectors(spark.createDataFrame([(1, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.doc_id, r.n_words) for r in scores.collect()) == [(1, 6), (2, 3)]
    assert dict(spark.conf.getAll) == before


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 900}" for i in range(300_000))
    rows = [(1, text), (2, "w1 w2 w3")]
    got = lm_score.lm_scores(spark.createDataFrame([(i, t, "") for i, t in rows], DOCS), batch_chars=1000).collect()
    assert sorted((r.doc_id, r.n_words) for r in got) == [(1, 300_000), (2, 3)] and next(r.order_3 for r in got if r.doc_id == 1) > 0.999


ODD = "doc_id long, text string, lang string, source string, n_chars long, h string, shard string, component_id long, offsets string"


def pipeline_on(spark, folder, rows):
    import corpus_pipeline

    rest = ("en", "s", 0, "h", "x", 7, "o")
    spark.createDataFrame([(i, t, rest[0], *((None, *rest[2:]) if i == 7 else rest[1:])) for i, t in rows], ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the old river bank today"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    before, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = common.save(stage(spark, before, folder), name)
        kept.append(before)
    final = corpus_pipeline.run(spark, folder)
    assert final.columns == [c for c in ODD.replace(",", "").split()[::2] if c != "shard"] + ["shard", "slot"]
    assert sorted(map(str, final.select("doc_id", "text").collect())) == sorted(map(str, kept[-1].select("doc_id", "text").collect()))
    return kept


def test_pipeline_on_odd_rows(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(100_000))
    leak = "so the quick brown fox jumps over the lazy dog near the old river bank today then"
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven twelve"), (2, "ONE two three four five six"), (3, None), (3, None), (4, ""), (5, long), (6, leak), (7, "some other words that stand alone here"), (None, "no id but text"), (None, None)]
    kept = pipeline_on(spark, str(tmp_path), rows)
    texts = lambda df: sorted(((r.doc_id, (r.text or "")[:9].lower()) for r in df.collect()), key=str)
    assert texts(kept[0]) == sorted(((i, (t or "")[:9].lower()) for i, t in rows), key=str)
    once = texts(kept[1])
    assert sum(t == "one two t" for _, t in once) == 1 and (1, "seven eig") in once and (3, "") in once and len(once) == len(rows) - 2
    assert texts(kept[2]) == [x for x in once if x[0] != 6]
    assert kept[3].count() > 0 and kept[3].columns == kept[2].columns


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert [df.count() for df in pipeline_on(spark, str(tmp_path), [])] == [0] * 5


def test_counts_beyond_an_int_are_exact():
    pdf = pd.DataFrame({"batch": [1, 2], "bucket": [0, 0], "words": [3, 2], "grams": [np.array([5, 6, 9]), np.array([5, 9])], "times": [np.array([2_000_000_000, 1, 7], np.int32), np.array([2_000_000_000, 2], np.int32)]})
    got = lm_score.counted(pdf)
    rows = pa.array(got[["counts", "large"]].to_dict("records"), pa.struct([("counts", pa.list_(pa.int32())), ("large", pa.list_(pa.int64()))]))
    assert lm_score.counts_of(rows).tolist() == [4_000_000_000, 1, 9, 4_000_000_000, 9]

def test_memory_does_not_follow_the_number_of_batches(spark):
    """Before, Parquet put up to 100 batches of 6 million characters in a row group, which its writer and reader hold whole, and a task gathered the counts of
    as many batches as the session's number of shuffle partitions left to it."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 20)).alias("text")).coalesce(1)
    packed = common.Saved(lm_score._pack(docs, 1000), "packed", options=lm_score.ROW_GROUPS)
    groups = [pq.read_metadata(f) for f in glob.glob(f"{packed.path.removeprefix('file:')}/*.parquet")]
    rows = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert len(rows) > 40 and set(rows) == {1}
    counts = packed.df.selectExpr("batch", "1 as n", "0 as bucket", "array(1) as counts", "array(2L) as large")
    held = [len(x) for x in lm_score.gathered(packed.df, counts, len(rows)).rdd.glom().collect()]
    assert sum(held) == len(rows) and len(held) >= len(rows) // lm_score.GATHERED and max(held) < 4 * lm_score.GATHERED
