"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.llm import byte_bpe, common, decontaminate, lm, neighbours, quality, secrets, sharding, simhash, token_orc, warc

WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()
DOCS = "doc_id long, text string, fp string, ids string, __x int"


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "clash", "clash", 1) for i, t in enumerate(texts)], DOCS)


def tables(spark, folder, texts, items=(), labels=()):
    docs_of(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


ODD = [None, "", " \n\t", "x", "Été über ñandú 日本語 🙂", text(1, 4000), text(2, 50), text(2, 50), "a" * 3000, "it's \x1c odd\x85\xa0 space"]


# shared -----------------------------------------------------------------------------------------------------------------------


def test_components(spark):
    r = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(7, 7), (1, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if x != 7}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10 ---------------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(t):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [words[i : i + 4] for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("how", [{}, {"halves": False}, {"dense": 2}])
def test_simhash(spark, how):
    base = text(3, 120).split()
    near = [" ".join(base[:i] + ["zzz"] + base[i + 1 :]) for i in range(0, 120, 3)]
    texts = ODD + near + [near[0]] * 20 + [text(s, 60) for s in range(10, 40)]
    rows = simhash.near_duplicates(docs_of(spark, texts), **how).collect()
    fp = [plain_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(fp))]
        if new == label:
            break
        label = new
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in rows} == {i: (fp[i], label[i]) for i in range(len(texts))}
    kept = simhash.keep_one(docs_of(spark, texts), **how)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and kept.columns == docs_of(spark, texts).columns


def test_simhash_edges(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0 == simhash.keep_one(docs_of(spark, [])).count()
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "lonely words here now")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(rows).collect()) == ["3", "3", "3", "None"]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(rows).collect()) == ["3", "None"]
    assert len(simhash.masks(64, 2)) == 2081 and len(simhash.masks(32, 1)) == 33


def test_simhash_keeps_a_text_of_each_class(spark):
    """Rows that share an id, or have none, but not a class are all kept; of a class the smallest id, nulls last, then the smallest text."""
    one, two = text(3, 60), text(4, 60)
    lonely = [(None, text(i, 60)) for i in range(20, 26)] + [(7, text(i, 60)) for i in range(30, 34)]
    rows = spark.createDataFrame([*lonely, (None, one), (3, one), (3, one), (2, two.upper()), (2, two), (None, two)], "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in simhash.keep_one(rows).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [*lonely, (3, one), (2, two.upper())]))


# 2 ----------------------------------------------------------------------------------------------------------------------------


def test_simhash_keeps_one_of_a_large_class(spark):
    """A third of all rows in one class, with repeated and null ids: one row stays, and all others too."""
    rows = [(None if i % 3 else i % 7, f"hot words that many rows share {'x' if i % 2 else ''}") for i in range(600)] + [(1000 + i, text(i, 40)) for i in range(60)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len([r for r in got if (r.doc_id or 0) >= 1000]) == 60
    rest = [(r.doc_id, r.text) for r in got if (r.doc_id or 0) < 1000]
    prints = {plain_fingerprint(t) for _, t in rows[:600]}
    near = len(prints) == 1 or bin(np.bitwise_xor.reduce(np.array(list(prints), np.uint64))).count("1") <= 4
    assert len(rest) == (1 if near else 2) and all(i == 0 for i, _ in rest)
    empty = simhash.keep_one(spark.createDataFrame([], "doc_id long, text string, __class int, __row string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "__class", "__row"]


def test_automaton_is_brute_force():
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(6)]
    for _ in range(30):
        items = [(str(i), " ".join(r.choice(vocab) for _ in range(r.randrange(0, 14)))) for i in range(8)]
        auto = decontaminate.Automaton([(i, decontaminate.words(t.encode())) for i, t in items], 5)
        for _ in range(10):
            doc = " ".join(r.choice([*vocab, "other"]) for _ in range(r.randrange(0, 60)))
            spans, found = auto.scan(decontaminate.words(doc.encode()))
            n, hit, want = decontaminate.plain_hits(doc, items, 5)
            assert (sum(e - s for s, e in spans), sorted(found)) == (hit, want)


def test_decontamination(spark, tmp_path):
    items = [text(50, 25), text(51, 12), "Short One", "", None, text(50, 25), text(52, 40)]
    leak = items[0].split()
    texts = [*ODD, text(60, 30) + " QQ " + " ".join(leak[3:15]).upper() + " qq " + text(61, 30), " ".join(leak), "a short, one b", "so ---short--- one!", text(62, 5) + " " + items[6]]
    d = tables(spark, tmp_path, texts, items)
    plain = [(str(i), t or "") for i, t in enumerate(items)]
    rows = {r.doc_id: r for r in decontaminate.op2_benchmark_decontamination(spark, d).collect()}
    for i, t in enumerate(texts):
        n, hit, found = decontaminate.plain_hits(t, plain)
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), decontaminate.digest(found), hit > 0)
    own, bench = docs_of(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    many = decontaminate.match(own, bench, block_words=20)
    one = decontaminate.match(own, bench)
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert decontaminate.automatons(bench, block_words=20).count() > 2
    clash = own.withColumn("__spans", F.lit(1)).withColumn("automaton", F.lit(2)).withColumn("block", F.lit(3))
    assert {c for c in decontaminate.decontaminate(clash, bench).columns} == {*own.columns, "__spans", "automaton", "block"} - {"__spans"}
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(own, bench).collect()}
    assert clean[0] is None and clean[6] == texts[6] and len(ODD) + 1 not in clean and "QQ" in clean[len(ODD)] and " ".join(leak[3:15]).upper() not in clean[len(ODD)]
    assert decontaminate.match(own, bench.limit(0)).where("size(__items) > 0").count() == 0
    assert decontaminate.match(own.limit(0), bench).count() == 0


def test_short_item_leaves_a_long_document(spark):
    item = "seven words that no text else holds"
    before, after = text(70, 50), text(71, 43)
    own = docs_of(spark, [f"{before} <{item.upper()}> {after}", before, f"{before} {item[:-6]} {after}"])
    bench = spark.createDataFrame([(1, item), (2, text(72, 30))], "item_id long, text string")
    for blocks in ({}, {"block_words": 8}):
        clean = {r.doc_id: r.text for r in decontaminate.decontaminate(own, bench, **blocks).collect()}
        assert clean == {0: f"{before} <> {after}", 1: before, 2: f"{before} {item[:-6]} {after}"}


# 4 ----------------------------------------------------------------------------------------------------------------------------


def plain_secrets(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [x[2] for x in sorted(out)]


def test_secrets(spark, tmp_path):
    texts = [*ODD, "password=hunter22", "PASSWORD : 'abc", "secret=token:abcdefgh", "é🙂 token = 'abcdef' token=abcdef token == a=bcdef", "AKIA" + "A1" * 8 + " AKIA1234 xAKIAAKIA" + "B" * 16, "0123456789abcdef01234567 0123456789abcdef0123456", "api_key: \"" + "ab" * 20 + '"', "ſecret=abcdefg toKen=abcdefg", "-----BEGIN RSA PRIVATE KEY-----", "password=" + "a" * 30]
    r = random.Random(2)
    texts += ["".join(r.choice(["token", "=", " ", "secret", "ab", ":", "'", "-", "api_key", "0f"]) for _ in range(40)) for _ in range(60)]
    d = tables(spark, tmp_path, texts)
    rows = {x.doc_id: x for x in secrets.op4_secret_scans(spark, d).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = plain_secrets(t or "")
        x = rows[i]
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, x.spans)
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in secrets.BASE)
        assert set(want) <= set(x.spans.split(",")) if want else True
    own = docs_of(spark, texts)
    red = {x.doc_id: x.text for x in secrets.redact(own).collect()}
    assert red[10] == "[SECRET]" and red[0] is None and red[6] == texts[6] and red[18] == "[SECRET]"
    nulls = spark.createDataFrame([(None, "password=hunter22"), (4, "password=hunter22"), (4, "clean")], "doc_id long, text string")
    assert sorted(len(x["__spans"]) for x in secrets.find_secrets(nulls).collect()) == [0, 1, 1]
    assert secrets.find_secrets(nulls.limit(0)).count() == 0
    plan = secrets.find_secrets(own)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_rule_finds_what_a_full_scan_finds(spark, tmp_path):
    """The index path of each rule against a scan of everything."""
    keys = ["password", "passwd", "secret", "token", "apikey", "api_key", "ApiKey", "PASSWD"]
    texts = [f"{k}=abcdefgh1" for k in keys] + ["AKIA" + "A1" * 8, "0f" * 14, "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN A B PRIVATE KEY-----"]
    texts += ["eyJ" + "aB3" * 4 + ".eyJ" + "x_-" * 4 + "." + "Zz9" * 4] + [f"gh{c}_" + "aZ9" * 12 for c in "pousr"] + ["gh_", "eyJ", "nothing here"]
    texts = [f"{a} x {t} y" for t in texts for a in ("", "é")]
    rows = {x.doc_id: x.spans or "" for x in secrets.op4_secret_scans(spark, tables(spark, tmp_path, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        want = {f"{r.kind}:{m.start()}:{m.end()}" for r in secrets.RULES for m in re.finditer(r.regex, t) if len(m[r.group]) >= r.least}
        assert want == set(filter(None, rows[i].split(","))), t
        seen |= {w.split(":")[0] for w in want}
    assert seen == {r.kind for r in secrets.RULES}


def test_trigram_queries(spark):
    want = {
        "assign": (True, {"pas", "ass", "ssw", "swo", "wor", "ord", "swd", "sec", "ecr", "cre", "ret", "tok", "oke", "ken", "api", "pik", "ike", "key", "pi_", "i_k", "_ke"}),
        "access": (False, {"AKI", "KIA"}),
        "hex": (False, set()),
        "jwt": (False, {"eyJ", ".ey"}),
        "github": (False, {f"gh{c}" for c in "pousr"} | {f"h{c}_" for c in "pousr"}),
    }
    for r in secrets.RULES:
        fold, query = secrets.trigrams(r.regex)
        if r.kind in want:
            assert (fold, secrets.terms(query)) == want[r.kind], r.kind
    assert secrets.trigrams("AKIA[A-Z]+")[1] == ("all", ("AKI", "KIA"))
    assert secrets.trigrams("(?i)ABC|xyz")[1] == ("any", ("abc", "xyz"))
    assert secrets.trigrams("(?:abc)?x+y*z{2}")[1] == secrets.NOTHING and secrets.trigrams("x{2,}y")[1] == secrets.NOTHING
    assert secrets.trigrams("(?:ab){2,}")[1] == ("all", ("aba", "bab")) and secrets.trigrams("(?=abc)a.c")[1] == secrets.NOTHING
    index = secrets.build_index(spark.createDataFrame([(1, "a PaSsWoRd here"), (2, "pass word"), (3, None)], "doc_id long, text string"), segments=2)
    assert [r.id for r in secrets.candidates(index).collect()] == [1]


def test_no_match_is_outside_its_trigram_query():
    """Random regexes: every text with a match satisfies the query that was derived."""
    r = random.Random(11)

    def regex(depth):
        kind = r.randrange(7) if depth else 0
        if kind <= 1:
            return "".join(r.choice("abAB_") for _ in range(r.randrange(1, 4)))
        if kind == 2:
            return r.choice(["[ab]", "[a-c]", "[^a]", ".", "[A-Za-z_]", "\\w", "\\b"])
        if kind == 3:
            return f"(?:{regex(depth - 1)}|{regex(depth - 1)}|{regex(depth - 1)})"
        if kind == 4:
            return f"(?:{regex(depth - 1)}){r.choice(['?', '*', '+', '{2}', '{1,2}', '{2,}', '{0,3}', '+?'])}"
        return regex(depth - 1) + regex(depth - 1)

    tried = asked = 0
    while tried < 3000:
        own = r.choice(["", "(?i)"]) + regex(4)
        fold, query = secrets.trigrams(own)
        asked += query != secrets.NOTHING
        for _ in range(8):
            t = "".join(r.choice("abABc_") for _ in range(r.randrange(3, 14)))
            if re.search(own, t, re.A):
                tried += 1
                assert secrets.holds(query, t.lower() if fold else t), (own, t, query)
    assert asked > 100


def test_secrets_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "x password=hunter22 y", 1, 2, 3, 4, 5), (2, None, 1, 2, 3, 4, 5)], "doc_id long, text string, kinds int, id int, row int, `__full` int, `a.b` int")
    assert [len(x["__spans"]) for x in secrets.find_secrets(rows).orderBy("doc_id").collect()] == [1, 0]
    got = secrets.redact(rows).orderBy("doc_id").collect()
    assert secrets.redact(rows).columns == rows.columns and [tuple(x) for x in got] == [(1, "x [SECRET] y", 1, 2, 3, 4, 5), (2, None, 1, 2, 3, 4, 5)]


def test_secrets_in_a_text_of_very_many(spark):
    t = " ".join(f"é{i} " + "0123456789abcdef" * 2 for i in range(3000)) + " token=abcdefgh"
    d = docs_of(spark, [t])
    found = secrets.find_secrets(d).first()["__spans"]
    assert [(s.start, s.end) for s in found] == [m.span() for m in re.finditer("[0-9a-f]{24,}|token=[a-z]+", t)]
    assert secrets.redact(d).first().text == re.sub("[0-9a-f]{24,}|token=[a-z]+", "[SECRET]", t)


# 7 ----------------------------------------------------------------------------------------------------------------------------


def test_byte_bpe(spark):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ODD + ["".join(r.choice("ab c\n\té,.!'9 ") for _ in range(200)) for _ in range(40)] + ["<|endoftext|> it's", "ab" * 2000, " a  b\n\nc \n", "".join(r.choice("etaoin") for _ in range(3000))]
    rows = {x.doc_id: x for x in byte_bpe.digests(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), byte_bpe.sha(np.array(ids, "<u4").tobytes())), t
        assert rows[i].decoded_sha256 == byte_bpe.sha((t or "").encode())
    assert byte_bpe.digests(docs_of(spark, [])).count() == 0


# 6 ----------------------------------------------------------------------------------------------------------------------------


def test_quality(spark, tmp_path):
    good = [text(i, 80) for i in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in text(i, 80).split()) if i % 2 else "spam " * 60 for i in range(150)]
    texts = [*ODD, *good, *bad]
    labels = [(len(ODD) + i, int(i < 150), 0) for i in range(300)] + [(0, 1, 0), (None, 1, 0), (1, None, 0), (99999, 1, 0)]
    d = tables(spark, tmp_path, texts, (), labels)
    rows = {x.doc_id: x for x in quality.op6_quality_classifier(spark, d).collect()}
    assert len(rows) == len(texts) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows.values())
    held = [i for i in range(len(ODD), len(texts)) if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows) and len(held) > 20
    assert np.mean([rows[i].predicted == int(i < len(ODD) + 150) for i in held]) > 0.95
    again = {x.doc_id: x.score for x in quality.op6_quality_classifier(spark, d).collect()}
    assert all(again[i] == rows[i].score for i in rows)
    empty = quality.train([], [])
    assert quality.score(docs_of(spark, ["x", None]), empty).count() == 2 and quality.keep_good(docs_of(spark, []), empty).count() == 0


def plain_score(words, model):
    """The score of a text by the definition: features of each word one by one, in Python integers."""
    vectors, out = model
    m = (1 << 64) - 1

    def bucket(h, kind):
        h = (h + kind) * 0x9E3779B97F4A7C15 & m
        h ^= h >> 31
        return 2 + ((h * 0x9E3779B97F4A7C15 & m) >> 33) % (quality.BUCKETS - 2)

    def of(word):
        chars = [ord(c) for c in f"<{word}>"]
        power = [pow(0x100000001B3, i + 1, 1 << 64) for i in range(len(chars) + 1)]
        kind = lambda c: c + 4 if c < 0x2400 and not chr(c).isalnum() and not chr(c).isalpha() else 1 if c < 0x2400 and chr(c).isupper() else 2 if c >= 0x2400 or chr(c).isalpha() else 3 if chr(c).isdigit() else c + 4
        shape = [kind(c) for c in chars]
        shape = [c for i, c in enumerate(shape) if not i or c != shape[i - 1]]
        ids = [bucket(sum(c * p for c, p in zip(chars, power)) & m, 1), bucket(sum(c * p for c, p in zip(shape, power)) & m, 2)]
        for n in (2, 3, 4):
            for i in range(len(chars) - n + 1):
                h = 0
                for c in chars[i : i + n]:
                    h = (h * 0x100000001B3 + c) & m
                ids.append(bucket(h, n))
        return np.mean(vectors[ids].astype(np.float64), axis=0)

    hidden = np.zeros(quality.DIM)
    for i, w in enumerate(words):
        hidden += (of(w) + vectors[0 if i and words[i - 1] == w else 1]) / (2 * len(words))
    a, b = hidden @ out[: quality.DIM] + out[quality.DIM]
    return 1 / (1 + math.exp(a - b))


def test_quality_score_is_its_definition(spark):
    model = quality.train([text(i, 30) if i % 2 else "SPAM! spam 99 " * 8 for i in range(40)], [i % 2 for i in range(40)])
    texts = ["", "one", "one one Two 3x é日 don't", text(1, 60), "spam! spam! SPAM!", "\u2500\u2500 ½ ² _a-b"]
    got = {r.doc_id: r["__score"] for r in quality.score(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - plain_score(t.split(), model)) < 1e-6, t


def test_quality_labels(spark):
    """Bounds hold for rows, not ids; contradictory labels do not train; tables may be empty."""
    docs = docs_of(spark, [text(i, 20) for i in range(20)] + ["spam " * 9] * 20)
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)] + [(3, 0), (5, None), (6, 7)], "doc_id long, quality int")
    many = docs.unionByName(docs.where("doc_id = 4").crossJoin(spark.range(50)).drop("id"))
    a, b = quality.fit(docs, labels), quality.fit(many, labels)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    flipped = quality.fit(docs, labels.where("doc_id <> 3"))
    assert (a[1] == flipped[1]).all()
    none = quality.fit(docs, labels.limit(0))
    assert {r["__score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.fit(docs.limit(0), labels)[0].shape == (quality.BUCKETS, quality.DIM)
    few = quality.fit(docs, labels, max_bytes=100)
    assert not (few[1] == a[1]).all()


# 8 ----------------------------------------------------------------------------------------------------------------------------


def test_sharding(spark, tmp_path):
    texts = [*ODD, *[text(i, 20) for i in range(400)], *["same"] * 300]
    d = tables(spark, tmp_path, texts)
    rows = sharding.op8_sharding(spark, d).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    assert all(0 <= r.shard < 40 and (r.grown_shard == r.shard or r.grown_shard == 40) for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    again = {r.doc_id: r.shard for r in sharding.op8_sharding(spark, d).collect()}
    assert all(again[r.doc_id] == r.shard for r in rows)
    one = [r.doc_id for r in sorted((r for r in rows if r.shard == rows[0].shard), key=lambda r: r.slot)]
    assert one != sorted(one)
    written, _ = sharding.shard_rows(docs_of(spark, texts), 4, 500)
    assert written.count() == len(texts) and "fp" in written.columns
    assert sharding.with_slots(written).select("shard", "slot").distinct().count() == len(texts)
    assert sharding.shard_rows(docs_of(spark, []))[0].count() == 0


def test_slots_depend_on_rows_alone(spark):
    texts = [*ODD, *[text(i, 20) for i in range(500)], *["same"] * 200]
    own = docs_of(spark, texts).unionByName(docs_of(spark, ["again"] * 3, 5))
    slots = []
    for docs in (own.repartition(1), own.repartition(7, "text"), own.orderBy(F.col("doc_id").desc())):
        rows, _ = sharding.shard_rows(docs, 4, 2000)
        slots.append({(r.shard, r.slot): (r.doc_id, r.text) for r in sharding.with_slots(rows).collect()})
    assert slots[0] == slots[1] == slots[2] and len(slots[0]) == len(texts) + 3
    # a shuffle, not an order: neighbours in a shard are not neighbours by hash
    other = {(r.shard, r.slot): (r.doc_id, r.text) for r in sharding.with_slots(sharding.shard_rows(own, 4, 2000, seed=5)[0]).collect()}
    assert sum(other.get(k) == v for k, v in slots[0].items()) < 100


def test_sharding_edges(spark):
    clash = spark.createDataFrame([(1, "a", 7, "b", 1.5, {"k": 1}), (None, None, 8, "c", None, None), (None, "x", 8, "c", None, None)], "doc_id long, text string, shard int, bucket string, bucket_ double, place map<string,int>")
    rows, _ = sharding.shard_rows(clash, 4)
    assert set(rows.columns) == {"shard", "bucket", "place", "doc_id", "text", "shard_", "bucket__", "bucket_", "place_"}
    assert sorted((r.text or "", r.shard_, r["bucket__"], r["place_"]) for r in rows.collect()) == [("", 8, "c", None), ("a", 7, "b", {"k": 1}), ("x", 8, "c", None)]
    assert rows.where("doc_id IS NULL").select("shard").distinct().count() == 1
    hot = docs_of(spark, [text(i, 50) for i in range(200)]).unionByName(spark.createDataFrame([(3, "hot hot hot", "clash", "clash", 1)] * 3000, DOCS))
    rows, _ = sharding.shard_rows(hot, 2, 2000, repeats=200)
    held = rows.where("text = 'hot hot hot'").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in held) == 3000 and len(held) > 3 and max(r["count"] for r in held) < 1500
    assert rows.count() == 3200 and sharding.with_slots(rows).select("shard", "slot").distinct().count() == 3200


# 3 ----------------------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "é" * 3000 + "WARC/1.1" + "WARC/1.1\r\nfoo" + "y" * 5000
    pages = [(1, "http://a", big), (2, "http://WARC/1.1\r\n", big), (3, None, None), (4, "u", "x WARC/1.1"), (5, "u", "z" * 999), (6, "u", "z" * 999), (None, "n", "q"), (7, "u", "WARC/1.1" * 500), (8, "u", "k" * 1000), (9, "u", "k" * 1000), (9, "u", "k" * 1000)]
    pages += [(20 + i, "u", "\r\n\r\n" * i) for i in range(30)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    for chunk in (300, warc.CHUNK):
        at = common.fresh_path(spark, "warc-test")
        warc.write_archives(df, at, chunk=chunk)
        rows = warc.read_records(spark, at).collect()
        best = {p[2]: max(q[0] for q in pages if q[2] == p[2]) for p in pages if p[2] and len(p[2].encode()) >= 1000}
        want = []
        for i, _, h in pages:
            raw = (h or "").encode()
            to = best.get(h)
            revisit = to is not None and to != i
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
        sizes = [len(r.data) for r in warc.read_chunks(spark, at).where("data IS NOT NULL").collect()]
        assert all(s <= chunk for s in sizes) and (sizes or chunk > 300)
    at = common.fresh_path(spark, "warc-test")
    warc.write_archives(df.limit(0), at)
    assert warc.read_records(spark, at).count() == 0


def test_warc_oversized_payloads(spark):
    """A payload far beyond a chunk, and one of nothing but the line that starts records, which must not multiply its size."""
    large, marks = "0123456789abcdé" * 500_000, "WARC/1.1\r\n" * 20_000
    pages = spark.createDataFrame([(1, "u", large), (2, "u", marks), (3, "u", large), (1, "u", "other payload of the same page" * 50)], "page_id long, url string, html string")
    chunk = 8192
    rows = warc.chunked(pages.select("page_id", F.col("html").cast("binary").alias("html")), chunk).select("page_id", "chunk", "last", F.octet_length("data").alias("n"), "size").collect()
    assert max(r.n for r in rows) == chunk and sum(r.n for r in rows) == sum(len(t.encode()) for t in (large, large, marks)) + 1500 and sum(r.last for r in rows) == 4
    at = common.fresh_path(spark, "warc-test")
    warc.write_archives(pages, at, chunk=chunk)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(spark, at).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got == sorted([(1, 8_000_000, sha(large), "revisit", 3), (1, 1500, sha("other payload of the same page" * 50), "response", None), (2, 200_000, sha(marks), "response", None), (3, 8_000_000, sha(large), "response", None)], key=lambda x: x[:2])
    stored = spark.read.format("binaryFile").load(at).agg(F.sum("length")).first()[0]
    assert stored < 1.2 * (8_000_000 + 1.4 * 200_000)
    assert max(len(r.data) for r in warc.read_chunks(spark, at).where("data IS NOT NULL").collect()) <= chunk


# 9 ----------------------------------------------------------------------------------------------------------------------------


def test_token_orc(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_orc._file())
    texts = [*ODD, "<|endoftext|>x y<|startoftext|>", "it's 'll 12345", "x\x85y　z", *[text(i, 30) for i in range(60)]]
    at = common.fresh_path(spark, "orc-test")
    token_orc.write_tokens(docs_of(spark, texts).repartition(3), at)
    rows = {r.doc_id: r for r in token_orc.starts(spark, at).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    one = token_orc.read_tokens(spark, at).where("doc_id = 12")
    assert len(one.first().ids) == rows[12].n_tokens and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,12)]" in one._jdf.queryExecution().executedPlan().toString()
    at = common.fresh_path(spark, "orc-test")
    token_orc.write_tokens(spark.createDataFrame([(None, "a"), (1, "b"), (1, "a"), (1, "a")], "doc_id long, text string"), at)
    assert sorted(r.start for r in token_orc.starts(spark, at).collect()) == [0, 2, 4, 6]
    at = common.fresh_path(spark, "orc-test")
    token_orc.write_tokens(docs_of(spark, []), at)
    assert token_orc.starts(spark, at).count() == 0


# 5 ----------------------------------------------------------------------------------------------------------------------------


def nearest(v, ids, q, k):
    s = (v * v[q]).sum(1)
    at = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[i]), s[i]) for i in at]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    v[100:160] = v[7]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0])]
    df = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in enumerate(v)] + [(*b, "clash") for b in bad], "vec_id long, embedding array<double>, v string")
    found = neighbours.search(df, df.where("vec_id % 20 = 0"), 10).collect()
    ids = np.arange(1500)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20)) and all(len(x) == 10 for x in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in nearest(v, ids, q, 10)}) / 10 for q in got])
    assert recall >= 0.9
    for q, x in got.items():
        assert all(abs(s - v[q] @ v[i]) < 1e-12 for i, s in x) and x == sorted(x, key=lambda y: (-y[1], y[0]))
    assert [i for i, _ in got[100]][:3] == [i for i, _ in nearest(v, ids, 100, 3)]


def test_neighbours_visit_less_of_more(spark):
    """Recall holds at both sizes with measured probes, and the share of vectors that a query is compared with falls."""
    rng, visited = np.random.default_rng(3), []
    for n in (1000, 16000):
        v = rng.normal(size=(n, 24))
        v /= np.linalg.norm(v, axis=1)[:, None]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        asked = list(range(0, n, n // 50))
        got = {}
        for r in neighbours.search(df, df.where(F.col("vec_id").isin(asked)), 10).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(got[q] & {i for i, _ in nearest(v, np.arange(n), q, 10)}) / 10 for q in asked]) >= 0.9
        rows = df.select("vec_id", F.col("embedding").alias("v"))
        scale = float(np.sqrt((v * v).sum(1).max()))
        h, probes = neighbours.calibrate(rows, rows.where(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "query_id"), n, 24, scale, 10, neighbours.TABLES, neighbours.hashes_for(n), neighbours.WIDTH, neighbours.TARGET, neighbours.SEED)
        cells = h.codes(np.floor(h.project(v, False)).astype(np.int64), np.arange(h.tables))
        place = h.project(v[asked], True)
        hit = np.zeros((len(asked), n), bool)
        for t in range(h.tables):
            for i, own in enumerate(h.codes(h.probes(place[:, t], probes)[0], t)):
                hit[i] |= np.isin(cells[:, t], own)
        visited.append(hit.mean())
    assert visited[1] < 0.7 * visited[0]


def test_neighbours_bounded_groups(spark, monkeypatch):
    """A hot vector, and parts cut into many pieces and slices: the same neighbours as without cuts."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 8))
    v[200:400] = v[7]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, neighbours.search(df, df, 5).collect()))
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    monkeypatch.setattr(neighbours, "PART_QUERIES", 50)
    assert sorted(map(tuple, neighbours.search(df, df, 5).collect())) == want


def test_perturbations_come_in_order():
    h = neighbours.Hashes(3, 1.0, 4, 1)
    place = np.array([[0.3, 1.6, -0.2, 5.01]])
    cells, scores = h.probes(place, 30)
    every = sorted(sum((x - np.floor(x)) ** 2 if d < 0 else (1 - (x - np.floor(x))) ** 2 if d else 0 for x, d in zip(place[0], ds)) for ds in np.ndindex(3, 3, 3, 3) for ds in [np.array(ds) - 1])
    assert np.allclose(scores[0], every[:30]) and (cells[0, 0] == np.floor(place[0])).all()


def test_neighbours_small(spark):
    v = np.eye(4)[[0, 0, 1, 2, 3]]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    rows = neighbours.search(df, df, 20).collect()
    assert len(rows) == 20 and all(r.query_id != r.vec_id for r in rows)
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == 4] == [0, 1, 2, 3]
    assert neighbours.search(df.limit(0), df, 20).count() == 0


# 1 ----------------------------------------------------------------------------------------------------------------------------


def test_lm(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "LANES", 4)
    texts = [*ODD, *[text(i, 60) for i in range(120)], *["b a " * 40] * 40]
    d = tables(spark, tmp_path, texts)
    rows = {r.doc_id: r for r in lm.op1_lm_scoring(spark, d).collect()}
    toks = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        r = rows[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - base) < 1e-6 * (1 + abs(base)) and r.score <= 0 and math.isfinite(r.score)
    own = [i for i in rows if held[i] and i >= len(ODD)]
    assert sum(rows[i].score for i in own) > sum(rows[i].base_score for i in own)


def test_lm_rare_words(spark, monkeypatch):
    """Words beyond the broadcast ones are found by the join, with the same sums."""
    monkeypatch.setattr(lm, "HEAD", 10)
    texts = [text(i, 40) + f" rare{i % 7} rare{i}" for i in range(40)]
    rows = {r.doc_id: r for r in lm.score(docs_of(spark, texts), F.col("doc_id") < 30).collect()}
    toks = [t.encode().split() + [b""] for t in texts]
    c = Counter(w for t in toks[:30] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        assert rows[i].n_known == sum(c[w] > 0 for w in t)
        assert abs(rows[i].base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-9
    none = lm.score(docs_of(spark, texts[:2]), F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)
    assert lm.score(docs_of(spark, []), F.lit(True)).count() == 0


def test_lm_is_a_distribution():
    """Class times word probabilities add up to one over classes and the words of each class."""
    v = lm.Vocabulary([b"a", b"b", b"c"], [5, 3, 2], 10, 3, [(2, 1)] * lm.REST)
    net = lm.Runner(v, lm.Network.fresh(v))
    seqs = [np.array([i, j]) for i in range(3) for j in [0, 1, 2, *range(-lm.REST, 0)]]
    both = net.run(seqs, 4)
    ones = net.run([np.array([i]) for i in range(3)], 4)
    per = both.reshape(3, -1)
    assert np.allclose(np.exp(per).sum(1), np.exp(ones), rtol=1e-4)


def test_lm_vocabulary_grows(spark):
    """The words in the network make up the stated share of the tokens however many there are, and have rows of their own."""
    sizes = []
    for n in (3000, 40_000):
        counts = spark.range(n).select(F.concat(F.lit("w"), F.col("id")).cast("binary").alias("word"), F.floor(200_000 / (F.col("id") + 100)).alias("c"))
        v = lm.vocabulary(counts)
        assert v.count[: v.model].sum() >= 0.7 * v.total and v.model >= min(n, 2048) and v.classes >= 32
        assert abs(v.rest[:, 0].sum() + v.count[: v.model].sum() - v.total) < 1 and v.rest[:, 1].sum() + v.model == v.distinct
        ranks = np.arange(v.model)
        own, cls = v.inputs(ranks)
        assert (own == ranks).all() and cls.max() < v.classes and (v.inputs(np.arange(v.model, len(v.count)))[0] >= v.rows).all()
        net = lm.Runner(v, lm.Network.fresh(v))
        text = [np.array([v.model - 1, 5, v.model - 2])]
        assert net.run(text, 1)[0] < 0 and net.net.emb.shape[0] > v.model and net.net.ow.shape[0] >= v.model
        sizes.append(v.model)
    assert sizes[1] > 2 * sizes[0] and sizes[1] > 2048


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Fixed sub-corpora: however the input is cut and ordered, the scores are the same."""
    monkeypatch.setattr(lm, "LEARN_TOKENS", 400)
    monkeypatch.setattr(lm, "PER_PARAMETER", 0)
    docs = docs_of(spark, [text(i, 60) for i in range(80)])
    got = []
    for own in (docs.repartition(1), docs.repartition(6, "text"), docs.orderBy(F.col("doc_id").desc())):
        got.append({r.doc_id: r.score for r in lm.score(own, F.col("doc_id") < 60).collect()})
    assert all(abs(got[0][i] - other[i]) < 1e-6 * abs(got[0][i]) for other in got[1:] for i in got[0])


def test_lm_averaging_is_less_than_its_input():
    """What the learners of a round send is at most half of the ranks that they read, with as many words as a vocabulary may hold."""
    counts = [max(1, 10**9 // (i + 10)) for i in range(lm.HEAD)]
    total = 2 * sum(counts)  # so that all of them are modelled
    v = lm.Vocabulary([b"%d" % i for i in range(lm.HEAD)], counts, total, 10**7, [(1, 1)] * lm.REST)
    assert v.model == lm.HEAD
    sent = lm.learners_of(v) * 8 * lm.Network.size(v.rows, v.classes)
    assert lm.learners_of(v) > 10 and sent <= 0.55 * 4 * total / lm.ROUNDS


def test_lm_rounds_have_folders(spark, tmp_path):
    """Coded texts are written by round, all rows once; a round's scan reads its own folder."""
    texts = [None, "", *[text(i, 30) for i in range(60)]]
    docs = docs_of(spark, texts).select("doc_id", (F.col("doc_id") < 50).alias("learn"), F.coalesce("text", F.lit("")).alias("text"))
    v = lm.vocabulary(lm.counted(docs.where("learn")))
    rows = lm.coded(docs, v)
    assert sorted(r.doc_id for r in rows.collect()) == list(range(62))
    assert {r.turn for r in rows.where("doc_id >= 50").collect()} == {lm.NO_ROUND}
    assert {r.turn for r in rows.where("doc_id < 50").collect()} == set(range(lm.ROUNDS))
    plan = rows.where("turn = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(turn" in plan


def test_lm_is_its_definition(spark):
    """Packed lanes and windows against one text after the other, token by token in double precision."""
    v = lm.Vocabulary([bytes([65 + i]) for i in range(50)] + [b"ed%d" % i for i in range(2048)], list(range(2998, 900, -1)), 4_000_000, 2098, [(7, 3)] * lm.REST)
    flat = lm.Network.fresh(v)
    rng = np.random.default_rng(2)
    flat += rng.normal(0, 0.2, len(flat)).astype(np.float32)
    texts = [rng.integers(-lm.REST, 2098, n) for n in (1, 3, 70, 130, 33, 5)]
    got = lm.Runner(v, flat).run(texts, 3)
    net = lm.Network(flat.astype(np.float64), v.rows, v.classes)
    n, sig = lm.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    for text, logp in zip(texts, got, strict=True):
        ids, cls = v.inputs(text)
        h, before, total = np.zeros(n), v.rows + lm.REST, 0.0
        for i, k, word in zip(ids.tolist(), cls.tolist(), text.tolist(), strict=True):
            g, u = net.emb[before] @ net.wx + net.b, h @ net.wh
            z, r = sig(g[:n] + u[:n]), sig(g[n : 2 * n] + u[n : 2 * n])
            new = np.tanh(g[2 * n :] + r * u[2 * n :])
            h = new + z * (h - new)
            logits = h @ net.cw[:n] + net.cb
            total += logits[k] - np.log(np.exp(logits).sum())
            if k < v.classes:
                lo, hi = v.start[k], v.start[k + 1]
                own = net.ow[lo:hi, :n] @ h + net.ob[lo:hi]
                total += own[word - lo] - np.log(np.exp(own).sum())
            before = i
        assert abs(logp - total) < 1e-3 * (1 + abs(total))


def test_lm_gradients():
    """Backpropagation against finite differences."""
    v = lm.Vocabulary([bytes([65 + i]) for i in range(50)], list(range(90, 40, -1)), 4000, 50, [(1, 1)] * lm.REST)
    rng = np.random.default_rng(0)
    texts = [rng.integers(-3, 50, n) for n in (5, 9, 3, 7)]
    flat = lm.Network.fresh(v)
    start = flat.copy()
    for name in ("wh", "wx", "emb", "cw", "b", "ow"):
        state = np.concatenate([start, np.full(lm.Network.SIZE, 1e12, np.float32)])
        run = lm.Runner(v, state[: lm.Network.SIZE], state[lm.Network.SIZE :])
        grads = {}
        run._step = lambda n, g, rate, at=slice(None), grads=grads: grads.setdefault(n, []).append((np.array(g), at))
        run.run(texts, 2, 1.0)
        g, at = grads[name][0]
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        j = (np.atleast_1d(np.arange(1 << 16)[at])[i[0]], *i[1:])
        diff = []
        for step in (1e-2, -1e-2):
            moved = start.copy()
            getattr(lm.Network(moved), name)[j] += step
            diff.append(lm.Runner(v, moved).run(texts, 2).sum())
        assert abs((diff[0] - diff[1]) / 2e-2 + g[i]) < 0.02 * (1 + abs(g[i])), name


# pipeline ---------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    import tiktoken  # noqa: F401

    good = [text(1000 + i, 90) for i in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in text(i, 90).split()) for i in range(60)]
    items = [text(77, 30)]
    leak = text(500, 60) + "\n" + items[0] + "\n" + text(501, 60)
    secret = text(502, 60) + " password=hunter2222 " + text(503, 20)
    texts = [*good, *bad, good[3], good[3] + " more", leak, secret, None, ""]
    labels = [(i, int(i < 120), 0) for i in range(180)]
    d = tables(spark, tmp_path, texts, items, labels)
    docs = common.table(spark, d, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, d), name)
        seen.append((docs.columns, {r.doc_id: r for r in docs.collect()}))
    columns = common.table(spark, d, "documents").columns
    assert all(c == columns for c, _ in seen[:4])
    kept, single, clean, masked, coded = [x for _, x in seen]
    model = quality.model_of(spark, d)
    want = {r.doc_id for r in quality.score(common.table(spark, d, "documents"), model).where(F.col("__score") >= quality.THRESHOLD).collect()}
    assert set(kept) == want and set(range(120)) <= want and not want & set(range(120, 180))
    assert set(single) == {r.doc_id for r in simhash.near_duplicates(docs_of(spark, [t if i in want else "@" * 9 for i, t in enumerate(texts)]).where(F.col("doc_id").isin(*want))).collect() if r.doc_id == r.component_id}
    assert 180 not in single and 3 in single
    for i, r in clean.items():
        assert r.text == (texts[i] if not decontaminate.plain_hits(texts[i], [("0", items[0])])[1] else r.text) and not decontaminate.plain_hits(r.text, [("0", items[0])])[1]
    assert set(clean) == set(single) and "hunter2222" not in masked[183].text and "[SECRET]" in masked[183].text
    assert {i: r.text for i, r in masked.items() if i != 183} == {i: r.text for i, r in clean.items() if i != 183}
    assert {i: r.decoded_sha256 for i, r in coded.items()} == {i: byte_bpe.sha((r.text or "").encode()) for i, r in masked.items()}
    assert corpus_pipeline.run(spark, d).count() == len(coded)


def test_kept_texts_are_not_shuffled(spark):
    """Rows are picked by bits of their numbers: the same as a join, over blocks and partitions, and no text moves."""
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 65537, (1 << 33), (1 << 33) + 1, (1 << 33) + 32768, (5 << 33) + 3]
    rows = spark.createDataFrame([(n, f"t{n}") for n in numbers], "number long, text string")
    for some in (numbers[::2], numbers[1::2], [], numbers):
        wanted = spark.createDataFrame([(n,) for n in [*some, 99, 4 << 33]], "number long")
        assert sorted(r.number for r in simhash.among(rows, wanted).collect()) == some
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(docs_of(spark, ["a b c d e f", "a b c d e f", "other words of some length", None]))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
