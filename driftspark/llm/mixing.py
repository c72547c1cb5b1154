"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source is expected ``rate = target / source size`` times. The expected copies are summed up along the
source's documents, one random offset is added, and a document is taken once for each integer that its step crosses, so
between floor(rate) and ceil(rate) times. The documents lie in classes of nearly equal size, so the words taken, not only
the documents, come near the target.

The running sum is never taken over one source in one task: counts of (source, size class, hash bucket) give each
bucket's start, and only the rank within a bucket needs its rows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftspark.llm.common import n_words

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
SEED = "mix-1"
#: Hash buckets of a size class, of which a source has some hundred; a larger table may be given more.
BUCKETS = 64


def _hash(column, digits: int):
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), F.coalesce(column, F.lit("")))), 1, digits), 16, 10).cast("long")


def size_class(size):
    """Number of digits and the first two of them: classes of at most a tenth in width."""
    digits = F.length(size.cast("string"))
    return F.when(digits <= 2, size).otherwise(digits * 100 + F.floor(size / F.pow(F.lit(10), digits - 2))).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): budget times all words shared by weight (sources in order
    of code points, null last, weights repeating); no target passes ``most`` times its source's size, and the excess goes
    to the others by weight until none does. That is the level where sum(min(cap, level * weight)) is the budget."""
    s = sources.withColumn("i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("i") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order, every = W.orderBy("ratio", "i"), W.orderBy("ratio", "i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(every)
    before = F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("open", (budget * total - before) / rest)
    level = F.first(F.when(F.col("open") <= F.col("ratio"), F.col("open")), ignorenulls=True).over(every)
    s = s.withColumn("level", level)
    return s.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")), F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text, source, …) to one row per input row: doc (the row as a struct), doc_id, size (words), source_size,
    target, copies, taken (copies * size).

    Null or blank text: size 0, still drawn at its source's rate. A null source is a source of its own. Sources without
    words take nothing. Repeated rows are separate documents; which of two equal rows gets a copy is not defined, and the
    rows returned are the same. Very long texts are
    documents like others, of their number of words. An empty table gives none. Other columns stay inside ``doc``, so no name clashes.
    """
    sized = docs.select(F.struct("*").alias("doc"), "doc_id", F.col("source").cast("string"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("x"))
    sized = sized.withColumn("h", _hash(F.col("doc_id").cast("string"), 8)).withColumn("class", size_class(F.col("size"))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    key = ["source", "class", "bucket"]
    slim = docs.select("doc_id", F.col("source").cast("string"), n_words(F.col("text")).alias("size"))
    slim = slim.withColumn("class", size_class(F.col("size"))).withColumn("bucket", F.pmod(_hash(F.col("doc_id").cast("string"), 8), F.lit(buckets)))
    counts = slim.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    start = F.sum("n").over(W.partitionBy("source").orderBy("class", "bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    starts = counts.withColumn("start", start)
    null_safe = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    starts = starts.join(goal, null_safe(starts, goal, ["source"])).drop(goal["source"]).drop("n", "words")
    ranked = sized.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy("size", "h", "doc_id", "x")))
    out = ranked.join(starts, null_safe(ranked, starts, key)).drop(*(starts[c] for c in key))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash(out["source"], 4) / F.lit(65536.0)  # 16 bits, so that rank * rate + offset rounds alike everywhere
    out = out.withColumn("rate", rate).withColumn("offset", offset).withColumn("rank", F.col("start") + F.col("k"))
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return out.withColumn("copies", crossed.cast("long")).select("doc", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken."""
    rows = mix(docs, **how).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("doc.*")


#: The same rows in DuckDB.
SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from documents),
classed as (
  select *, h % 64 as bucket,
         case when length(size::varchar) <= 2 then size
              else (length(size::varchar) * 100 + size // (10 ** (length(size::varchar) - 2))::bigint)::bigint end as class
  from sized),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as i from classed group by source),
s1 as (select *, [3, 1, 2][((i - 1) % 3 + 1)::int] as w, 2 * source_size as cap from s0),
s2 as (select *, cap / w as ratio from s1),
s3 as (select *, (1.5::double * sum(source_size) over ()
          - (sum(cap) over (order by ratio, i rows unbounded preceding) - cap))
          / sum(w) over (order by ratio, i rows between current row and unbounded following) as open from s2),
s4 as (select *, (select open from s3 where open <= ratio order by ratio, i limit 1) as level from s3),
goal as (select source, source_size, coalesce(least(cap::double, level * w), cap::double) as target from s4),
ranked as (select *, row_number() over (partition by source order by class, bucket, size, h, doc_id) as rank from classed),
rated as (
  select r.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0.0::double end as rate,
         ('0x' || substr(md5('mix-1|' || coalesce(r.source, '')), 1, 4))::bigint / 65536.0::double as offs
  from ranked r join goal g on r.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (floor(rank * rate + offs) - floor((rank - 1) * rate + offs))::bigint * size as taken
from rated
"""
