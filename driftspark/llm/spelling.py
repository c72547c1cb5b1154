"""Spelling variants: words one edit apart, found by pivotal bigrams, and the frequent form each variant stands for.

1. Words are counted over all texts. A word's bigrams are ordered from rare to common, by the number of words that have them (at
   most 8,100 different bigrams). Its prefix are the three rarest, with all places of the third; one edit destroys at
   most two bigrams, so a near word keeps one of them.
2. Its two pivots are the pair of prefix bigrams that don't overlap and together are rarest, chosen by dynamic programming. One edit
   destroys one pivot at most. So if a word's prefix ends no later in the order than the other's, one of its pivots is in the
   other's prefix.
3. Pivots are the index, prefixes ask it. The edit lies wholly to the right or wholly to the left of the pivot that it spares:
   either the pivot stands at the same place with the same letters before it, or at the same place from the end with the same
   letters after it. These position limits are part of the join's key.
4. Candidates are verified by their edit distance. Forms are looked up, and followed to the root by jumping.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import Saved, pieces, release_memory, save

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Code points of a word and its occurrences, at least; a form is so many times as frequent, at least.
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: Words of more code points are found by their halves; those of one more have both kinds of keys, so no pair is lost between.
LONG = 64
#: Of the runs' hashes one in so many marks a run whose code point is deleted; None deletes none.
EVERY = 97
#: Different words that a task counts before it hands them on.
FLUSH = 100_000


def words_in(doc_id: int | None, text: str | None, every: int | None = EVERY) -> Counter:
    """The words of a text with their number, code points deleted."""
    runs = Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    if every is None or doc_id is None:
        return runs
    out: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    for w, n in runs.items():
        h = zlib.crc32(w.encode(), start)
        if h % every == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        out[w] += n
    return out


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, every: int | None = EVERY) -> DataFrame:
    """docs (doc_id long, text string) to (word, n)."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return out

        for b in pieces(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                for w, n in words_in(i, t.as_py(), every).items():
                    if len(w) >= min_chars:
                        counts[w] += n
                if len(counts) >= FLUSH:
                    yield flush()
        yield flush()
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def gram_order(words: DataFrame) -> dict[str, int]:
    """Bigrams to their place in the order, rare ones first. The alphabet has 90 letters, so there are at most 8,100."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                counts.update(set(bigrams(w)))
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

    grams = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()
    return {r["gram"]: k for k, r in enumerate(grams)}


def prefix_of(word: str, order: dict[str, int]) -> tuple[list[int], int]:
    """Places of the prefix bigrams, and the place in the order of its last one."""
    ranks = [order[g] for g in bigrams(word)]
    last = sorted(ranks)[min(2, len(ranks) - 1)]
    return [i for i, r in enumerate(ranks) if r <= last], last


def pivots_of(word: str, places: list[int], order: dict[str, int]) -> list[int]:
    """Two places at least two apart whose bigrams' places in the order add up to the least: going from left to right, the best
    pair ending here needs the best single bigram that ended two before."""
    best: tuple[int, list[int]] | None = None
    single: list[tuple[int, int]] = []  # (rank, place) of the best bigram among the first k prefix places
    for i in places:
        rank = order[word[i : i + 2]]
        before = [s for s, p in zip(single, places) if p <= i - 2]
        if before and (best is None or before[-1][0] + rank < best[0]):
            best = (before[-1][0] + rank, [before[-1][1], i])
        single.append(min(single[-1], (rank, i)) if single else (rank, i))
    return best[1] if best else places


def keys_of(word: str, order: dict[str, int]) -> list[tuple[str, int, int, bool]]:
    """(letters, 1 from the left or 2 from the right, last place of the prefix in the order, whether a pivot) for each prefix bigram. One edit
    leaves one half of a long word as it is, so long words have their halves as pivots."""
    out = []
    if len(word) <= LONG + 1:
        places, last = prefix_of(word, order)
        pivots = pivots_of(word, places, order)
        for p in places:
            out += [(word[: p + 2], 1, last, p in pivots), (word[p:], 2, last, p in pivots)]
    if len(word) > LONG:
        for half in {len(word) // 2, (len(word) - 1) // 2}:
            out += [(word[:half], 1, -1, True), (word[-half:], 2, -1, True)]
    return out


def _letters(word: str) -> int:
    """A bit for each letter that occurs, modulo 63; one edit changes two at most."""
    bits = 0
    for c in set(word):
        bits |= 1 << ord(c) % 63
    return bits


def pivot_rows(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(key, word, n, size, last, letters, pivot): the hashed keys of each word."""
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("size", pa.int32()), ("last", pa.int32()), ("letters", pa.int64()), ("pivot", pa.bool_())])

    def run(batches):
        for b in pieces(batches, 4096):
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                letters = _letters(w)
                for part, seed, last, pivot in keys_of(w, order):
                    rows.append((xxhash.xxh3_64_intdigest(part, seed=seed) - (1 << 63), w, n, len(w), last, letters, pivot))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        release_memory()

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, size int, last int, letters long, pivot boolean")


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = len(os.path.commonprefix((a, b)))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _apart():
    @F.pandas_udf("boolean")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) for x, y in zip(a, b)], dtype=bool)

    return apart


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), each once and of at least four code points, to (word, n, other, other_n): all pairs one edit apart, both ways."""
    rows = save(pivot_rows(words, gram_order(words)), "pivots")
    mine = rows.where("pivot")
    asks = rows.select("key", *(F.col(c).alias(f"other_{c}") for c in ("word", "n", "size", "last", "letters")))
    close = (F.abs(F.col("size") - F.col("other_size")) <= 1) & (F.col("last") <= F.col("other_last")) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("other_letters"))) <= 2)
    checked = F.when(F.col("size") <= LONG, F.levenshtein("word", "other_word", 1) == 1).otherwise(True)  # its time grows with the square of the size
    pairs = mine.join(asks, (mine["key"] == asks["key"]) & close & (F.col("word") != F.col("other_word")) & checked)
    pairs = save(pairs.select("word", "n", "size", "other_word", "other_n"), "near-words")
    pairs = pairs.where(F.col("size") <= LONG).union(pairs.where(F.col("size") > LONG).where(_apart()("word", "other_word")))
    pairs = pairs.select(F.explode(F.array(F.struct("word", "n", F.col("other_word").alias("other"), "other_n"), F.struct(F.col("other_word").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p"))
    return pairs.select("p.*").distinct()


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """forms (word, form or null) to (word, root). Each round doubles how far a word has followed its forms; forms are at least
    ``RATIO`` times as frequent as their words, so a chain has some 60 links at most and six rounds do."""
    at = Saved(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(max_rounds):
        ahead = at.df.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = Saved(at.df.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at.drop()
        at = new
        if at.df.where("moved").isEmpty():
            return at.df.select("word", "root")
    raise RuntimeError(f"roots did not settle in {max_rounds} rounds")


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int | None = EVERY) -> DataFrame:
    """docs (doc_id long, text string, …) to one row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least ``min_chars`` (four or more) code points
    that occur at least ``min_count`` times in all texts. Where ``every`` divides the crc32 of ``<doc_id>:<run>``, that run first
    loses the code point at crc32 modulo its length. Two words are near if one inserted, deleted or replaced code point makes the
    difference. A word's form is its near word of the largest n (ties: the smallest in code-point order) if that is at least
    ``ratio`` times its own; root follows forms to the last. Null and empty texts have no words; texts of any length are read whole,
    one at a time, and runs of any length count. Repeated rows count each; rows with a null doc_id count and lose no code point.
    Other columns are ignored. No words, no rows.
    """
    if min_chars < 4 or ratio < 2:
        raise ValueError("words need four code points for their pivots, and forms must be twice as frequent for chains to end")
    words = save(word_counts(docs.select("doc_id", "text"), min_chars, min_count, every), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = words.join(near, "word", "left").withColumn("fits", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    formed = save(
        formed.select("word", F.when(F.col("fits"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n")),
        "forms",
    )
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
