"""Stupid-backoff language-model scores by joins of n-grams with count tables that are partitioned by hash.

1. The documents are packed into batches, rows of some hundred documents or more with a number, in the shared folder.
2. One job for each order n: each batch explodes into its distinct n-grams with how often they occur (the map-side combine),
   which are shuffled to hash buckets; a bucket adds them up to its part of the count table and joins that back to the n-grams.
   The shuffle files of a job go when it ends, so the disk holds one order at a time.
3. Each batch receives the counts of its n-grams, joins them to its positions and sums the scores of each document.

An n-gram counts as seen if it occurs ``min_count`` times in all documents together; else the next order is asked at ``backoff``
of the score, down to single words. A frequent n-gram is one entry per batch, so no bucket grows with its occurrences.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import Saved, pieces, release_memory, tidy_session

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
#: Characters of text in a batch, about; n-grams in a bucket of a count table, about. Beyond so many buckets a task takes several,
#: one after another.
BATCH_CHARS, BUCKET_GRAMS, MOST_TASKS = 6_000_000, 1_500_000, 20_000
#: Batches whose counts a task gathers, about; it holds them all at once.
GATHERED = 4
#: Each row of packed batches is a row group: Parquet's writer looks at its size only every 100 rows, and both it and the reader hold a whole group.
ROW_GROUPS = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}
#: Bytes of rows that go to a Python worker at once, about; a batch's row alone may be more.
ARROW_BYTES = 4_000_000
#: Counts from here on travel as longs beside the ints of the rest.
LARGE = 2**31 - 1

_SEED = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


class Grams:
    """The words of a batch's texts in a row, and the 64-bit hashes of the n-grams that end at each."""

    def __init__(self, texts: list[str | None]):
        words = [words_of(t or "") for t in texts]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.words = np.fromiter((xxhash.xxh3_64_intdigest(x) for w in words for x in w), np.uint64, int(self.lengths.sum()))
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def ending(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the n-grams, and at which words one ends that lies in its text."""
        g = self.words
        for _ in range(n - 1):
            g = np.concatenate([g[:1], g[:-1]])  # the n-gram of the word before
            g = (g ^ (g >> np.uint64(31))) * _SEED + self.words
            g ^= g >> np.uint64(29)
        return g, self.place >= n - 1


def _pack(docs: DataFrame, batch_chars: int) -> DataFrame:
    """(batch, doc_ids, texts): batches in the order of the scan; a text is never split."""

    def run(batches):
        part, k, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.record_batch([pa.array([part << 32 | k]), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))], names=["batch", "doc_ids", "texts"])

        for b in pieces(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= batch_chars:
                    yield row()
                    k, ids, texts, size = k + 1, [], [], 0
        if ids:
            yield row()
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "batch long, doc_ids array<long>, texts array<string>")


def exploded(packed: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, batch, words, grams array<long>, times array<int>): the distinct n-grams of each batch, in order of their hash, one
    row for each bucket of the hash's range that they fall into; words: how many n-grams these are with their repeats."""

    def run(batches):
        for b in pieces(batches, 1):
            g, whole = Grams(b.column(1).flatten().to_pylist()).ending(n)
            keys, times = np.unique(g[whole], return_counts=True)
            of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # equal ranges of the hash; buckets lie one after another
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])
            some, every = of[begin], np.concatenate([begin, [len(keys)]]).astype(np.int32)
            sums = np.add.reduceat(times, begin) if len(some) else np.empty(0, np.int64)
            yield pa.record_batch(
                [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), b.column(0)[0].as_py(), np.int64)), pa.array(sums.astype(np.int64)), pa.ListArray.from_arrays(pa.array(every), pa.array(keys.view(np.int64))), pa.ListArray.from_arrays(pa.array(every), pa.array(times.astype(np.int32)))],
                names=["bucket", "batch", "words", "grams", "times"],
            )
            del g, whole, keys, times
            release_memory()

    return packed.select("batch", "texts").mapInArrow(run, "bucket int, batch long, words long, grams array<long>, times array<int>")


def counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's n-grams of all batches: the bucket's count table is made and joined back to each batch's n-grams."""
    table, place = np.unique(np.concatenate(pdf["grams"].to_list()), return_inverse=True)
    total = np.bincount(place, np.concatenate(pdf["times"].to_list()), len(table)).astype(np.int64)[place]  # doubles hold such sums exactly
    ends = np.cumsum([len(g) for g in pdf["grams"]])[:-1]
    small, large = np.split(np.minimum(total, LARGE).astype(np.int32), ends), [x[x >= LARGE] for x in np.split(total, ends)]
    return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "words": pdf["words"], "counts": small, "large": large})


def counts_of(got) -> np.ndarray:
    """The counts of a batch's n-grams of one order, from their arrays of ints and of longs."""
    out = got.field("counts").flatten().to_numpy().astype(np.int64)
    out[out == LARGE] = got.field("large").flatten().to_numpy()
    return out


def _scored(order: int, backoff: float, min_count: int, total: int):
    """A batch's texts and the counts of its n-grams, by order and bucket, to a row for each document."""

    def run(batches):
        for b in pieces(batches, 1):
            ids, texts = (b.column(i).flatten() for i in (0, 1))
            got = b.column(2).flatten()  # by order and bucket; none where no text has words
            grams, counts = Grams(texts.to_pylist()), []
            for n in range(1, order + 1):
                g, whole = grams.ending(n)
                keys, place = np.unique(g[whole], return_inverse=True)
                c = np.zeros(len(g), np.int64)
                c[whole] = counts_of(got.filter(pc.equal(got.field("n"), n)))[place]
                counts.append(c)
                del g, whole, keys, place
            score, used = np.full(len(grams.words), np.nan), np.zeros(len(grams.words), np.int8)
            for n in range(order, 0, -1):
                c = counts[n - 1]
                before = np.concatenate([[0], counts[n - 2][:-1]]) if n > 1 else None
                ok = (used == 0) & ((c >= min_count) if n > 1 else (c > 0))
                score[ok] = np.log(c[ok] / before[ok] if n > 1 else c[ok] / total) + (order - n) * math.log(backoff)
                used[ok] = n
            lengths = grams.lengths
            doc = np.repeat(np.arange(len(lengths)), lengths)
            share = [np.bincount(doc[used == n], minlength=len(lengths)) for n in range(1, order + 1)]
            some = lengths > 0
            cols = [ids, pa.array(lengths), pa.array(np.bincount(doc, score, len(lengths)).astype(float))]
            cols += [pa.array(np.divide(x, lengths, out=np.zeros(len(x)), where=some), mask=~some) for x in share]
            yield pa.record_batch(cols, names=["doc_id", "n_words", "s", *(f"order_{n}" for n in range(1, order + 1))])
            del grams, counts, score, used, doc, share
            release_memory()

    return run


def gathered(packed: DataFrame, got: DataFrame, batches: int) -> DataFrame:
    """(doc_ids, texts, got): each batch with the counts of its n-grams, by order and bucket; in parts by the number of batches, as a task's rows are large."""
    parts = min(max(12, math.ceil(batches / GATHERED)), MOST_TASKS)
    got = got.repartition(parts, "batch").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("n", "bucket", "counts", "large"))).alias("got"))  # as many as the batch has n-grams
    return packed.repartition(parts, "batch").join(got, "batch", "left").select("doc_ids", "texts", "got")


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT, batch_chars: int = BATCH_CHARS, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """docs (doc_id, text, …) to one row per input row: doc_id, n_words, log_score (natural logarithm, 0 for no words),
    perplexity (null for no words), each order's share of the words (order_1 … order_n).

    Words are lower-cased and split at ASCII white space. Null and blank texts have no words. Repeated rows count as often as
    they occur and each comes back with its own score. At a text's start the orders that it is too short for are passed over
    like n-grams not seen. N-grams are told apart by 64-bit hashes: among 10^13 different ones, one in two million shares its own.
    Very long texts are read whole, one batch each. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tidy = tidy_session(spark)
    tidy.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    packed = Saved(_pack(docs, batch_chars), "lm-batches", tidy, options=ROW_GROUPS).df
    chars, batches = packed.agg(F.coalesce(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.length(t), F.lit(0)))), F.lit(0)), F.count("*")).first()
    buckets = max(12, math.ceil(chars / 6 / bucket_grams))  # a word has six characters, about
    tables = []
    for n in range(1, order + 1):
        grams = exploded(packed, n, buckets).repartition(min(buckets, MOST_TASKS), "bucket")
        back = grams.groupBy("bucket").applyInPandas(counted, "batch long, bucket int, words long, counts array<int>, large array<long>")
        tables.append(Saved(back.withColumn("n", F.lit(n)), f"lm-counts-{n}").df)
    total = tables[0].agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    got = tables[0]
    for t in tables[1:]:
        got = got.unionByName(t)
    shares = ", ".join(f"order_{n} double" for n in range(1, order + 1))
    joined = gathered(packed, got, batches)
    out = Saved(joined.mapInArrow(_scored(order, backoff, min_count, total), f"doc_id long, n_words long, s double, {shares}"), "lm-scores").read(spark)
    perplexity = F.when(F.col("n_words") > 0, F.round(F.exp(-F.col("s") / F.col("n_words")), 4))
    return out.select("doc_id", "n_words", F.round("s", 6).alias("log_score"), perplexity.alias("perplexity"), *(F.round(f"order_{n}", 6).alias(f"order_{n}") for n in range(1, order + 1)))


#: The same scores in DuckDB, for order 3.
SQL = r"""
with w as (
  select row_number() over () as r, doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
p as (
  select r, doc_id, w[i] as g1, case when i >= 2 then array_to_string(w[i-1:i], ' ') end as g2, case when i >= 3 then array_to_string(w[i-2:i], ' ') end as g3,
         case when i >= 2 then w[i-1] end as c2, case when i >= 3 then array_to_string(w[i-2:i-1], ' ') end as c3
  from w, unnest(range(1, len(w) + 1)) as t(i)),
k1 as (select g1, count(*) as k from p group by g1),
k2 as (select g2, count(*) as k from p where g2 is not null group by g2),
k3 as (select g3, count(*) as k from p where g3 is not null group by g3),
s as (
  select p.r,
         case when k3.k >= 2 then 3 when k2.k >= 2 then 2 else 1 end as n,
         case when k3.k >= 2 then ln(k3.k / kc3.k) when k2.k >= 2 then ln(k2.k / kc2.k) + ln(0.4::double)
              else ln(k1.k / (select count(*) from p)) + 2 * ln(0.4::double) end as s
  from p join k1 on p.g1 = k1.g1 left join k2 on p.g2 = k2.g2 left join k3 on p.g3 = k3.g3
       left join k1 as kc2 on p.c2 = kc2.g1 left join k2 as kc3 on p.c3 = kc3.g2),
d as (select r, count(*) as m, sum(s) as s, count(*) filter (n = 1) as m1, count(*) filter (n = 2) as m2, count(*) filter (n = 3) as m3 from s group by r)
select w.doc_id, coalesce(m, 0)::bigint as n_words, round(coalesce(s, 0.0::double), 6) as log_score, round(exp(-s / m), 4) as perplexity,
       round(m1 / m, 6) as order_1, round(m2 / m, 6) as order_2, round(m3 / m, 6) as order_3
from w left join d on w.r = d.r
"""
