import math
import random

from driftspark.llm import license_scan as ls


def lis_length(v):
    best = []
    for i, x in enumerate(v):
        best.append(1 + max((best[j] for j in range(i) if v[j] < x), default=0))
    return max(best, default=0)


def test_longest_increasing():
    rnd = random.Random(1)
    for _ in range(100):
        v = [rnd.randrange(20) for _ in range(rnd.randrange(15))]
        got = [v[i] for i in ls.longest_increasing(v)]
        assert len(got) == lis_length(v) and all(a < b for a, b in zip(got, got[1:]))


def test_patience_is_increasing_and_true():
    rnd = random.Random(2)
    for _ in range(100):
        a, b = ([rnd.choice("abcdefgh") for _ in range(rnd.randrange(25))] for _ in range(2))
        got = ls.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert len(ls.patience(list("abcxdef"), list("abcdef"))) == 6


def test_scan(spark):
    mit = ls.TEMPLATES["MIT"].replace("free of charge", "gratis")
    noise = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, f"{noise} {ls.TEMPLATES['MIT-notice']} {noise}", 0), (2, f"{noise}\n{mit}\n{noise}", 0), (3, noise + " the license of this software is free", 0), (4, None, 0), (5, "", 0),
        (6, f"Released under the MIT License. {noise} Released under the MIT License.", 0), (7, "This work is licensed under the GNU General Public License, version 3.", 0),
        (1, f"{noise} {ls.TEMPLATES['MIT-notice']} {noise}", 0),
    ]
    got = sorted((r.doc_id, r.license) for r in ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license int")).collect())
    assert got == [(1, "MIT-notice"), (1, "MIT-notice"), (2, "MIT"), (6, "MIT-notice"), (6, "MIT-notice"), (7, "GPL-3.0-notice")]


def test_every_template_is_found_whole():
    s = ls.Scanner(ls.TEMPLATES, ls.COVERAGE)
    for name, t in ls.TEMPLATES.items():
        found = {n: c for n, c, _, _ in s.scan("before " + t + " after")}
        assert found[name] == 1.0


def brute_copies(text, template, coverage):
    """By all windows up to five thirds of the template: the most finds that don't overlap, each a shortest window that reaches the coverage."""
    words, t = ls.words_of(text), ls.words_of(template)
    least, ends = math.ceil(coverage * len(t) - 1e-9), []
    for a in range(len(words)):
        for b in range(a + least, min(len(words), a + len(t) + 2 * (len(t) // 3)) + 1):
            if words[a] == t[0] or words[a] in t:
                pairs = ls.patience(words[a:b], t)
                if len(pairs) >= least:
                    ends.append((b, a))
                    break
    n, at = 0, 0
    for b, a in sorted(ends):
        if a >= at:
            n, at = n + 1, b
    return n


def test_copies_one_after_another():
    s = ls.Scanner(ls.TEMPLATES, ls.COVERAGE)
    for name, t in ls.TEMPLATES.items():
        for n in (1, 2, 3, 7):
            for gap in ("", " ", " and so ", " license software file redistribution "):
                found = [x for x in s.scan("The license says: " + gap.join([t + " "] * n) + " software.") if x[0] == name]
                assert len(found) == n, (name, n, gap, found)
                assert all(a[3] < b[2] for a, b in zip(found, found[1:]))


def test_coverage_just_over_and_under_against_brute_force():
    """As many finds as there are, neither more nor fewer; also between copies, each just under, that together make one."""
    rnd = random.Random(3)
    for name, t in ls.TEMPLATES.items():
        w = ls.words_of(t)
        for over in (True, False):
            for copies in (1, 2, 3):
                texts = []
                for _ in range(copies):
                    gone = len(w) - math.ceil(ls.COVERAGE * len(w) - 1e-9) + (not over)
                    bad = set(rnd.sample(range(1, len(w) - 1), gone))
                    texts.append(" ".join(f"x{k}y" if k in bad else x for k, x in enumerate(w)))
                text = "so be it " + " then ".join(texts) + " as it was"
                mine = ls.Scanner({name: t}, ls.COVERAGE).scan(text)
                # patience may align less than was left where few words are unique, so the truth is what it says of whole copies
                want = sum(len(ls.patience(ls.words_of(x), w)) >= ls.COVERAGE * len(w) for x in texts)
                assert not over or len(mine) == want, (name, copies, mine, want)
                if len(w) < 40 or copies < 3:
                    assert len(mine) == brute_copies(text, t, ls.COVERAGE), (name, over, copies, mine)


def test_a_copy_with_words_put_in():
    rnd = random.Random(4)
    for name, t in ls.TEMPLATES.items():
        w = ls.words_of(t)
        for copies in (1, 2, 3):
            text = ""
            for _ in range(copies):
                put = set(rnd.sample(range(1, len(w)), len(w) // 4))
                text += " ".join(f"x{k}y {x}" if k in put else x for k, x in enumerate(w)) + " "
            assert len(ls.Scanner({name: t}, ls.COVERAGE).scan(text)) == copies, (name, copies)


def test_overlaps_ties_and_a_long_text(spark):
    noise = " ".join(f"w{i}" for i in range(60_000))
    both = ls.TEMPLATES["Apache-2.0"]  # its first words are the notice of the same license
    rows = [(1, f"{noise} {both} {noise} {ls.TEMPLATES['ISC']} {ls.TEMPLATES['ISC']}"), (2, ls.TEMPLATES["GPL-3.0"])]
    got = sorted((r.doc_id, r.license, r.first_word) for r in ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(ls.words_of(ls.TEMPLATES["ISC"]))
    first = 120_000 + len(ls.words_of(both))
    assert got == [(1, "Apache-2.0", 60_000), (1, "Apache-2.0-notice", 60_000), (1, "ISC", first), (1, "ISC", first + n), (2, "GPL-3.0", 0)]


def test_empty(spark):
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
