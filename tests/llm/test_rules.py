"""Quality rules against brute force: counts, exact tails, proven cutoffs and verdicts."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kmerloom.llm import rules

SCHEMA = "doc_id long, text string, lang string, counts int, row string, `a.b` int, kept string"
WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()


def plain_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {p for i, g in enumerate(grams) if g in often for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_capitals": sum("A" <= c <= "Z" for c in t),
    }


def failed(c):
    return c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]


def plain_verdicts(rows, labels, risk, error):
    """(kept by row) by trying every configuration in every stratum."""
    counts = [plain_counts(r[1]) for r in rows]
    good = {}
    for i, y in labels:
        if y in (0, 1) and i is not None:
            good[i] = max(good.get(i, 0), y)
    held = defaultdict(dict)
    for r, c in zip(rows, counts):
        if not failed(c) and r[0] in good:
            key = r[1]
            held[r[2]][key] = (max(good[r[0]], held[r[2]].get(key, (0,))[0]), c)
    hits = lambda c, config: any(d and c[r.count] > 0 and 100 * c[r.count] >= r.cutoffs[d - 1] * c[r.of] for d, r in zip(config, rules.RULES))
    every = [tuple(reversed(x)) for x in itertools.product(*[range(len(r.cutoffs) + 1) for r in reversed(rules.RULES)])]
    picked = {}
    for s, texts in held.items():
        best = None
        for number, config in enumerate(every):
            n = sum(y == 1 for y, _ in texts.values())
            x = sum(y == 1 and hits(c, config) for y, c in texts.values())
            caught = sum(y == 0 and hits(c, config) for y, c in texts.values())
            tail = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(x + 1))
            if tail <= error / (len(held) * len(every)) and (best is None or (caught, -x, -number) > best[0]):
                best = ((caught, -x, -number), config)
        if best:
            picked[s] = best[1]
    return picked, [not failed(c) and not (r[2] in picked and hits(c, picked[r[2]])) for r, c in zip(rows, counts)]


def some_text(r, kind):
    w = [r.choice(WORDS) for _ in range(r.randrange(25, 90))]
    if kind == "symbols":
        w = [x + "&&&" for x in w]
    if kind == "capitals":
        w = [x.upper() for x in w]
    if kind == "lines":
        return "\n".join(["buy this now"] * 6 + [" ".join(w)])
    return " ".join(w)


ODD = [None, "", " \n\t", "x", "Été über ñandú 日本語 🙂 " * 9, "a b c d e f g h " * 3, "same\nsame\n same\n\nsame", " ".join(["w"] * 400), " ".join(str(i) for i in range(6000)) + " " + " ".join(str(i) for i in range(50, 70))]


def test_counts(spark):
    rows = [(i, t, None, 1, "x", 2, "y") for i, t in enumerate(ODD + [some_text(random.Random(i), k) for i, k in enumerate(["", "symbols", "capitals", "lines"] * 5)])]
    got = {x.doc_id: x.counts.asDict() for x in rules.measure(spark.createDataFrame(rows, SCHEMA), ("doc_id",)).select("row.doc_id", "counts").collect()}
    assert got == {r[0]: plain_counts(r[1]) for r in rows}


def test_tail(spark):
    cases = [(x, n) for n in (0, 1, 5, 30, 400, 2000) for x in {0, 1, n // 40, n // 21, n} if x <= n]
    found = spark.createDataFrame(cases, "x long, n long").select("x", "n", rules.binomial_tail(F.col("x"), F.col("n"), 0.05).alias("p")).collect()
    for r in found:
        exact = float(sum(Fraction(math.comb(r.n, i)) * Fraction(1, 20) ** i * Fraction(19, 20) ** (r.n - i) for i in range(r.x + 1)))
        assert r.p == pytest.approx(exact, rel=1e-9) if r.x <= r.n * 0.05 else r.p == 1.0 and exact > 0.3
    # a tail too deep for a sum from 0 on is still exact
    deep = spark.range(1).select(rules.binomial_tail(F.lit(40000).cast("long"), F.lit(1_000_000).cast("long"), 0.05).alias("p")).first().p
    assert 0 <= deep < 1e-300


def test_verdicts(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(1800):
        bad = r.random() < 0.3
        kind = r.choice(["symbols", "capitals", "lines"]) if bad else "lines" if r.random() < 0.01 else ""
        # one stratum is too small to prove anything, one is null
        rows.append((i, some_text(r, kind), r.choice(["en"] * 9 + [None] * 9 + ["xx"]), 1, "x", 2, "y"))
        labels.append((i, None if i % 50 == 0 else 7 if i % 51 == 0 else int(not bad)))
    rows += [(5, rows[5][1], "en", 1, "x", 2, "y")] * 300 + [(None, rows[6][1], "en", 1, "x", 2, "y"), (10**6, None, "en", 1, "x", 2, "y")]
    labels += [(5, 0), (5, 1), (None, 1), (10**9, 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    picked, want = plain_verdicts(rows, labels, rules.RISK, rules.ERROR)
    assert set(picked) == {"en", None} and all(any(c) for c in picked.values())
    found = rules.judge(docs, marks)
    got = Counter((x.doc_id, x.text, x.lang, x.kept) for x in found.select("row.doc_id", "row.text", "row.lang", "kept").collect())
    assert got == Counter((a[0], a[1], a[2], k) for a, k in zip(rows, want))
    assert rules.keep(docs, marks).columns == docs.columns
    assert rules.keep(docs, marks).count() == sum(want)


def test_guarantee(spark):
    """Good documents of which a third break every rule: nothing that rejects them is proven."""
    r = random.Random(4)
    rows = [(i, some_text(r, "symbols" if i % 3 == 0 else ""), "en", 1, "x", 2, "y") for i in range(900)]
    labels = spark.createDataFrame([(i, 1) for i in range(900)], "doc_id long, quality int")
    found = rules.judge(spark.createDataFrame(rows, SCHEMA), labels)
    assert found.where("kept").count() == sum(not failed(plain_counts(x[1])) for x in rows)


def test_empty(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert rules.judge(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "only " * 3, None, 1, "x", 2, "y")], SCHEMA)
    assert [(x.base_failed, x.kept) for x in rules.judge(one, labels).collect()] == [(True, False)]
