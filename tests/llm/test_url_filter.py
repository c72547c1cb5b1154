import time
from itertools import combinations

from pyspark.sql import functions as F

from driftspark.llm import url_filter as uf

PAGES = "page_id long, url string, host string, verdict int"
LABELS = "doc_id long, quality int, toxic int"


def test_host_path_and_given_rules(spark):
    urls = ["HTTP://A.Example.NET/en/x?y#z", "http://net/", "http://net", "x", None, "https://example.com/de/1#a", "http://b.org/fr/", "http://b.orgs/fr/", "http://e.example.net/de/", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(pages, spark.createDataFrame([], LABELS)).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1] == ("net", "/", "net/", "block") and got[2] == ("net", "", None, "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("example.com/de/", "block") and got[6][2:] == ("org/fr/", "allow")
    assert got[7][2:] == (None, "allow") and got[8][2:] == ("net/", "block") and got[9][:2] == ("b:", "//c/d")


def test_mined_rules_against_brute_force(spark):
    rows, marks = [], []
    for i in range(200):
        bad = i % 4 == 0
        rows.append((i, f"http://{'spam' if bad and i % 8 else 'site'}{i % 3}.test/{'win' if bad else 'news'}/{i}?{'ref' if i % 2 else 'id'}={i}", "", 0))
        if i < 150:
            marks.append((i, 0 if bad else 1, 0))
    rows += [(900, "http://spam1.test/win/7?id=1", "", 0), (900, "http://spam1.test/win/7?id=1", "", 0), (901, None, "", 0)]
    pages = spark.createDataFrame(rows, PAGES)
    toks = {r.page_id: set(r.t) for r in pages.select("page_id", uf.tokens(F.col("url")).alias("t")).collect()}
    known = [(toks[i], q == 0) for i, q, _ in marks]
    base, rules = sum(b for _, b in known) / len(known), []
    for k in (1, 2, 3, 4, 5, 6, 7, 8):
        for x in {c for t, _ in known for c in combinations(sorted(t), k)}:
            met = [b for t, b in known if t.issuperset(x)]
            conf = sum(met) / len(met)
            if sum(met) / len(known) >= 0.05 and conf >= uf.MIN_CONFIDENCE and conf / base >= uf.MIN_LIFT:
                rules.append(set(x))
    want = {i for i, t in toks.items() if any(r <= t for r in rules)}
    got = uf.judge(pages, spark.createDataFrame([*marks, (5, None, None), (99999, 0, 1)], LABELS), given=(), min_support=0.05).collect()
    assert len(got) == len(rows) and {r.page_id for r in got if r.verdict == "block"} == want and 900 in want


def test_thirty_tokens_of_one_shape(spark):
    """Tokens that always occur together are one item: 2 ** 30 rules aren't listed; a url with any of them is met, as by the subsets."""
    tail = "/".join(f"p{chr(97 + k)}" for k in range(26))
    shape = f"http://a.b.spam.test/{tail}"
    rows = [(i, f"{shape}?k{i}=1" if i % 3 == 0 else f"http://ok.test/{i % 5}/x{i}", "", 0) for i in range(120)] + [(1000, "http://other.test/ph", "", 0), (1001, "http://other.test/none", "", 0), (1002, "http://x.test/" + "y" * 200_000, "", 0)]
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(90)]
    began = time.time()
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS), given=(), min_support=0.05).collect()}
    assert time.time() - began < 60
    assert all((got[i].verdict == "block") == (i % 3 == 0) and (got[i].confidence or 1) == 1 for i in range(120))
    assert [got[i].verdict for i in (1000, 1001, 1002)] == ["block", "allow", "allow"]


def test_rules_of_two_items_decide_most_verdicts(spark):
    rows, labels = [], []
    for i in range(400):
        host, path = ("win", "lot", "news")[i % 3], ("deal", "text")[i // 3 % 2]
        rows.append((i, f"http://{host}.test/{path}/{i}", "", 0))
        labels.append((i, int(not (host == "win" and path == "deal" or host == "lot" and path == "text")), 0))
    pages, marks = spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels[:300], LABELS)
    got = {r.page_id: r.verdict for r in uf.judge(pages, marks, given=()).collect()}
    assert all((got[i] == "block") == (q == 0) for i, q, _ in labels)


def test_empty(spark):
    assert uf.judge(spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)).count() == 0
