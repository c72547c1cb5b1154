"""Lines that many documents share, dropped everywhere but in the document of the largest id.

1. One scan hashes each document's lines; the hashes are written by batch, batches being ranges of doc_id, largest ids first.
2. ``Runs`` holds the hashes seen so far as levelled sorted runs: tables bucketed and sorted by hash, so a join with them moves
   and sorts nothing of theirs. Each batch is counted by hash, merge-anti-joined with every run, and what is new is added as a run
   of its own, with its largest doc_id. ``fan_out`` runs of a level are merged into one of the next. A hash lies in one run only;
   as ids fall from batch to batch, the doc_id there is the largest of all.
3. Hashes that enough documents have, with their holder, meet the hashes of all documents; what a document loses goes to its text.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import Saved, pieces, release_memory, save
from driftspark.sources.scratch import new_folder

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches the ids are cut into, runs of a level that are merged into one, and about how many hashes a bucket of a run holds.
BATCHES, FAN_OUT, BUCKET = 6, 3, 2_000_000
SPACE = " \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]


def key_of(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line without white space at its ends, A-Z lower-cased, as UTF-8; none if it has fewer code points."""
    line = line.strip(SPACE)
    return line.encode("utf-8", "surrogatepass").lower() if len(line) >= min_chars else None


def _hashed(key: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k1, k2): a 128-bit hash for each distinct key of a row of docs (doc_id long, text string)."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches):
        for b in pieces(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                keys = {k for line in (t.as_py() or "").split("\n") if (k := key_of(line, min_chars)) is not None}
                rows += [(i, *_hashed(k)) for k in keys]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3, schema=schema)
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, k1 long, k2 long")


class Sorted:
    """A table bucketed and sorted by hash, in the shared folder."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.name = df.sparkSession, f"line_run_{uuid.uuid4().hex}"
        self.path = new_folder(self.spark, self.name)
        df.write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", self.path).format("parquet").saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Runs:
    """Levelled sorted runs of (k1, k2, holder); no hash lies in two of them."""

    def __init__(self, buckets: int, fan_out: int = FAN_OUT):
        self.buckets, self.fan_out, self.levels = buckets, fan_out, []

    def all(self) -> list[Sorted]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """batch (k1, k2, holder), each hash once: what no run has becomes a run of its own."""
        new = reduce(lambda rows, run: rows.join(run.df, KEY, "left_anti"), self.all(), batch)
        self._put(0, Sorted(new.select(*KEY, "holder"), self.buckets))

    def _put(self, level: int, run: Sorted) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            old, self.levels[level] = self.levels[level], []
            both = lambda a, b: a.join(b.withColumnRenamed("holder", "other"), KEY, "full").select(*KEY, F.coalesce("holder", "other").alias("holder"))
            merged = Sorted(reduce(both, [r.df for r in old]), self.buckets)
            for r in old:
                r.drop()
            self._put(level + 1, merged)

    def drop(self) -> None:
        for run in self.all():
            run.drop()


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_out: int = FAN_OUT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, keys array of (k1, k2)): what each document loses; documents that lose nothing are left out."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    number = sum((F.when(F.col("doc_id") <= c, 1).otherwise(0) for c in cuts), F.lit(0))  # batch 0 has the largest ids
    hashes = Saved(line_keys(ids, min_chars).withColumn("batch", number), "line-hashes", by=["batch"])
    lines = hashes.df.groupBy("batch").count().collect()  # a row a batch
    buckets = max(1, -(-max((r["count"] for r in lines), default=0) // bucket))
    runs, counted = Runs(buckets, fan_out), []
    for k in sorted(r["batch"] for r in lines):
        one = hashes.df.where(F.col("batch") == k).groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        counted.append(Sorted(one.repartition(buckets, *KEY), buckets))
        runs.add(counted[-1].df)
    if not counted:
        return hashes.df.select("doc_id", F.array(F.struct(*KEY)).alias("keys"))
    often = reduce(DataFrame.union, [c.df.select(*KEY, "n") for c in counted]).groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    held = reduce(DataFrame.union, [r.df.select(*KEY, "holder") for r in runs.all()])
    held = save(often.join(held, KEY).select(*KEY, "holder"), "shared-lines")
    runs.drop()
    for c in counted:
        c.drop()
    lost = hashes.df.join(held, KEY).where("doc_id <> holder").groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("keys"))
    lost = save(lost, "lost-lines")
    hashes.drop()
    return lost


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_out: int = FAN_OUT, bucket: int = BUCKET) -> DataFrame:
    """docs (doc_id long, text string, …) to one row per input row: doc (all its columns), n_lines before dropping, n_dropped, kept_text.

    Lines end at each newline. A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines except in the largest doc_id with it.
    Null and empty texts have one empty line; texts of any length and any number of lines are read whole, one text at a time. Every
    row counts as a document, also rows that are equal or share a doc_id; each row of the largest doc_id keeps its lines. Rows
    with a null doc_id don't count and lose nothing. Other columns are carried in ``doc`` whatever their names; no rows in, no
    rows out.
    """
    lost = shared_lines(docs, min_chars, min_docs, batches, fan_out, bucket)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    known, without = rows.where("doc_id is not null"), rows.where("doc_id is null")
    rows = known.join(lost.hint("merge"), "doc_id", "left").select("doc", "text", "keys").union(without.select("doc", "text", F.lit(None).cast(lost.schema["keys"].dataType)))

    def run(parts):
        for b in pieces(parts):
            n, dropped, kept = [], [], []
            for t, keys in zip(b.column(1), b.column(2)):
                lines = (t.as_py() or "").split("\n")
                n.append(len(lines))
                if keys.is_valid:
                    gone = {(k["k1"], k["k2"]) for k in keys.as_py()}
                    lines = [x for x in lines if (k := key_of(x, min_chars)) is None or _hashed(k) not in gone]
                dropped.append(n[-1] - len(lines))
                kept.append("\n".join(lines))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_lines", "n_dropped", "kept_text"])
        release_memory()

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, n_lines long, n_dropped long, kept_text string")


_KEY = "translate(trim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line from d),
k as (select distinct doc_id, {_KEY.format(x="line")} as key from l where length({_KEY.format(x="line")}) >= 40),
h as (select key, max(doc_id) as holder from k group by key having count(*) >= 5),
p as (select doc_id, list(key) as keys from k join h using (key) where doc_id <> holder group by doc_id),
r as (select d.doc_id, len(lines) as n_lines, list_filter(lines, lambda x: not list_contains(coalesce(keys, []), {_KEY.format(x="x")})) as kept from d left join p using (doc_id))
select doc_id, n_lines, n_lines - len(kept) as n_dropped, sha256(array_to_string(kept, chr(10))) as kept_sha256 from r
"""
