import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from driftspark.llm import line_dedup

DOCS = "doc_id long, text string, n_lines int, keys string"


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)


def brute(rows):
    held = defaultdict(list)
    for i, t in rows:
        if i is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                if len(k) >= 40:
                    held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), [])) < 5 or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def fixture():
    long = ["Ünïted paragraph of more than forty code points, number %d" % i for i in range(12)]
    rows = [(i, "\n".join([f"Only here {i}, and long enough to be a key of its own", "  " + long[i % 12].upper().replace("Ü", "ü"), "short", "\t" + long[(i * 5) % 12] + "\r", long[0]])) for i in range(60)]
    rows += [(100 + i, long[3] + "\n" + long[3] + "\n") for i in range(4)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 39), (None, long[0]), (None, None)]
    rows += [(300, long[1]), (300, long[1]), (300, "another text\n" + long[2])]  # one id, equal and different rows
    rows += [(-7 + i, "exactly forty code points, no more, n.b." if i < 5 else "thirty-nine code points in this lineee.") for i in range(10)]
    rows += [(400 + i, "four documents only hold this line here, " + "so it stays") for i in range(4)]
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], DOCS).repartition(4)
    return sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df, **how).collect()), key=str)


def test_against_brute_force(spark):
    rows = fixture()
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, batches=9, fan_out=2, bucket=10) == brute(rows)  # two levels of runs, several buckets


def test_runs_hold_each_hash_once_and_merge(spark):
    runs = line_dedup.Runs(buckets=3, fan_out=2)
    for top in (900, 600, 300, 0):
        runs.add(spark.range(50, 150).select((F.col("id") + top % 7).alias("k1"), F.col("id").alias("k2"), (F.col("id") + top).alias("holder")))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    rows = [(r.k1, r.k2) for run in runs.all() for r in run.df.collect()]
    assert len(rows) == len(set(rows)) == len({(i + top % 7, i) for top in (900, 600, 300, 0) for i in range(50, 150)})
    run = runs.all()[0].df
    plan = run.join(run.select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    runs.drop()


def test_long_text_empty_table_and_other_columns(spark):
    line = "a line that is long enough to count as a key here"
    rows = [(1, "\n".join([line] * 50_000 + ["x" * 300_000]))] + [(i, line) for i in range(2, 7)]
    assert run(spark, rows) == brute(rows)
    empty = line_dedup.dedup_lines(spark.createDataFrame([], DOCS))
    assert empty.count() == 0
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, "a", 9, "k")], DOCS)).first()
    assert got.doc.asDict() == {"doc_id": 1, "text": "a", "n_lines": 9, "keys": "k"} and got.n_lines == 1


def test_sql_on_the_fixture():
    rows = [r for r in fixture() if r[0] is not None and r[0] != 300]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows))
    assert sorted(con.execute(line_dedup.SQL).fetchall()) == want
