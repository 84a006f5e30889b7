"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regex gives a Boolean trigram query: what trigrams every match must hold, derived from the parse tree of the regex by way of
its mandatory literal runs, alternations, small character classes and repeats. The index holds, for each trigram that some query
names and each segment of the documents, the list of documents with that trigram. A query intersects and unites the lists of
a segment; what is left is joined to the texts and verified by the regex. Rules without a mandatory trigram scan all texts.
"""

from __future__ import annotations

import re
import re._constants as ops
import re._parser as parser
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import table, written

#: Rows of a list of the index, about.
SEGMENT_ROWS = 4096
#: Strings that a part of a regex may stand for and still be spelt out, and the size up to which a character class is.
SPELT, CLASS = 64, 8
#: Matches of a text whose places are summed together.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """kind; regex (leftmost, non-overlapping matches; read by Java, and by Python for its trigrams); least length of ``group`` for a
    match to count."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    #: The same matches with the least length in the pattern, if there is such a form.
    tight: str = field(default="")


# The base kinds in the order in which ties are listed, then what this library adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")

#: A trigram query: a trigram, or ("all" | "any", parts). ("all", ()) asks for nothing.
Query = str | tuple[str, tuple]
NOTHING: Query = ("all", ())


def _all(parts: list[Query]) -> Query:
    flat = dict.fromkeys(p for q in parts for p in (q[1] if isinstance(q, tuple) and q[0] == "all" else (q,)))
    return next(iter(flat)) if len(flat) == 1 else ("all", tuple(flat))


def _any(parts: list[Query]) -> Query:
    if not parts or NOTHING in parts:
        return NOTHING
    flat = dict.fromkeys(parts)
    return next(iter(flat)) if len(flat) == 1 else ("any", tuple(flat))


def _spelt(strings: set[str]) -> Query:
    """What a text holds that has one of the strings. A string with more trigrams than another asks for nothing new beside it."""
    grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return _any([_all(sorted(g)) for g in sorted(grams, key=sorted) if not any(other < g for other in grams)])


def _members(items: list, fold: bool) -> set[str] | None:
    """The characters of a class if they are few, else None."""
    out: set[str] = set()
    for op, value in items:
        if op is ops.LITERAL:
            out.add(chr(value))
        elif op is ops.RANGE and value[1] - value[0] < CLASS:
            out.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    out = {_lower(c) if fold else c for c in out}
    return out if len(out) <= CLASS else None


def _lower(c: str) -> str:
    return chr(ord(c) + 32) if "A" <= c <= "Z" else c


def _sequence(items: list, fold: bool) -> tuple[set[str] | None, Query]:
    """(all strings it can match, if few; what a text with a match must hold) of nodes one after the other.

    Runs of parts that can be spelt out are multiplied, so that trigrams reach over them; a part that cannot ends the run.
    """
    run, asks, whole = {""}, [], True
    for node in items:
        strings, query = _node(node, fold)
        if strings is not None and len(run) * len(strings) <= SPELT:
            run = {a + b for a in run for b in strings}
            continue
        whole = False
        asks += [_spelt(run), query if strings is None else NOTHING]
        run = strings if strings is not None else {""}
    return (run if whole else None), _all([*asks, _spelt(run)])


def _node(node: tuple, fold: bool) -> tuple[set[str] | None, Query]:
    op, value = node
    if op is ops.LITERAL:
        c = chr(value)
        return {_lower(c) if fold else c}, NOTHING
    if op is ops.IN:
        return _members(value, fold), NOTHING
    if op is ops.SUBPATTERN:
        group, on, off, inner = value
        # flags inside a pattern are not followed: nothing is asked for then
        return (None, NOTHING) if on or off else _sequence(list(inner), fold)
    if op is ops.BRANCH:
        each = [_sequence(list(b), fold) for b in value[1]]
        if all(s is not None for s, _ in each) and len(found := set().union(*[s for s, _ in each])) <= SPELT:
            return found, _spelt(found)
        return None, _any([q if s is None else _spelt(s) for s, q in each])
    if op is ops.AT:
        return {""}, NOTHING
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        least, most, inner = value
        inner = list(inner)
        if most <= 3:
            each = [_sequence(inner * n, fold)[0] for n in range(least, most + 1)]
            if all(s is not None for s in each) and len(found := set().union(*each)) <= SPELT:
                return found, _spelt(found)
        # at least so many of it, side by side; three give every trigram that more would
        return None, _sequence(inner * min(least, 3), fold)[1] if least else NOTHING
    return None, NOTHING


@lru_cache(maxsize=None)
def trigrams(regex: str) -> tuple[bool, Query]:
    """(fold, query) of a regex: with fold, trigrams are those of the lower-cased text. NOTHING: no mandatory trigram.

    Sound for what Java and Python read alike. Nodes that this does not know (references, look-around, classes by name) ask for nothing.
    """
    tree = parser.parse(regex)
    fold = bool(tree.state.flags & re.IGNORECASE)
    strings, query = _sequence(list(tree), fold)
    return fold, _spelt(strings) if strings is not None else query


def terms(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(terms, query[1]))


def holds(query: Query, text: str) -> bool:
    """Whether a text satisfies a query, in plain Python."""
    if isinstance(query, str):
        return query in text
    return (all if query[0] == "all" else any)(holds(q, text) for q in query[1])


def _asks(rule: Rule) -> bool:
    return trigrams(rule.regex)[1] != NOTHING


def _terms(rules: tuple[Rule, ...]) -> list[tuple[bool, str]]:
    return sorted({(fold, t) for fold, query in (trigrams(r.regex) for r in rules) for t in terms(query)})


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, segment_rows: int = SEGMENT_ROWS, segments: int | None = None) -> DataFrame:
    """(segment, fold, trigram, postings) of ``docs(doc_id, text)``: the distinct doc_ids with the trigram, ascending.

    Trigrams under fold are those of the lower-cased text. Rows without text or doc_id are not in it; repeated ids share a place.
    """
    n = segments or max(1, -(-docs.count() // segment_rows))
    named = _terms(rules)
    names = F.array(*[F.struct(F.lit(fold).alias("fold"), F.lit(t).alias("trigram")) for fold, t in named]) if named else F.array().cast("array<struct<fold:boolean,trigram:string>>")
    own = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when((F.col("low") if fold else F.col("t")).contains(t), F.lit(i)) for i, (fold, t) in enumerate(named)])) if named else F.array().cast("array<int>")
    rows = own.select("id", F.pmod(F.xxhash64("id"), F.lit(n)).alias("segment"), F.explode(held).alias("term"))
    lists = rows.groupBy("segment", "term").agg(F.array_sort(F.collect_set("id")).alias("postings"))
    return lists.select("segment", F.element_at(names, F.col("term") + 1).alias("t"), "postings").select("segment", "t.fold", "t.trigram", "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, kinds) that the index leaves for the rules that have a query: lists of a segment intersected and united."""
    rules = tuple(r for r in rules if _asks(r))
    lists = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("fold", "trigram"), "postings"))).alias("lists"))
    none = F.slice(F.element_at(F.map_values("lists"), 1), 1, 0)

    def of(query: Query, fold: bool) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.element_at("lists", F.struct(F.lit(fold).alias("fold"), F.lit(query).alias("trigram"))), none)
        return reduce(F.array_intersect if query[0] == "all" else F.array_union, [of(q, fold) for q in query[1]])

    found = [F.struct(F.lit(r.kind).alias("kind"), of(query, fold).alias("ids")) for r in rules for fold, query in [trigrams(r.regex)]]
    if not found:
        return lists.select(F.explode(none).alias("id"), F.array().cast("array<string>").alias("kinds"))
    each = lists.select(F.explode(F.array(*found)).alias("x")).select("x.kind", F.explode("x.ids").alias("id"))
    return each.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _before(items: Column, value, join, start) -> Column:
    """items as structs (x, at): at is ``start`` joined with the values of all items before x.

    Spark copies an array to append to it; so sums run within blocks, and over blocks, which keeps a text of many matches far from the
    square of their number.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(start), lambda s, x: join(s, value(x))))
    heads = F.aggregate(totals, F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("all")), lambda s, t: F.struct(join(s["at"], t).alias("at"), F.array_append(s["all"], s["at"]).alias("all")), lambda s: s["all"])

    def within(z: Column) -> Column:
        ats = F.aggregate(z["b"], F.struct(z["h"].alias("at"), F.array().cast("array<int>").alias("all")), lambda s, x: F.struct(join(s["at"], value(x)).alias("at"), F.array_append(s["all"], s["at"]).alias("all")), lambda s: s["all"])
        return F.arrays_zip(z["b"].alias("x"), ats.alias("at"))

    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), heads.alias("h")), within))


SPANS = "array<struct<start:int,end:int,kind:string>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of a rule in code points: matches and the gaps between them give the places."""
    regex = F.lit(rule.tight or rule.regex)
    least, group = (1, 0) if rule.tight else (rule.least, rule.group)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    measured = F.regexp_extract_all(text, regex, F.lit(group)) if group else whole
    sizes = lambda c: F.transform(c, lambda x: F.length(x))
    pieces = F.arrays_zip(sizes(F.split(text, regex, -1)).alias("gap"), sizes(whole).alias("all"), sizes(measured).alias("part"))
    placed = _before(F.filter(pieces, lambda p: p["all"].isNotNull()), lambda p: p["gap"] + p["all"], lambda a, b: a + b, 0)
    good = F.filter(placed, lambda p: p["x"]["part"] >= least)
    found = F.transform(good, lambda p: F.struct((p["at"] + p["x"]["gap"]).alias("start"), (p["at"] + p["x"]["gap"] + p["x"]["all"]).alias("end"), F.lit(rule.kind).alias("kind")))
    return F.when(text.rlike(rule.tight or rule.regex), found).otherwise(F.array().cast(SPANS))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """docs with ``__spans``, an array of (start, end, kind) by start, then the order of the rules.

    Rules are verified on the candidates of the index and, where they have no query, on all texts. Null and empty texts have no spans;
    rows with a null doc_id are not in the index and are scanned by all rules; repeated ids are candidates together; an
    empty table gives an empty result; other columns pass through whatever their names, but for ``__spans``, which is replaced.
    """
    # the candidates as a table: its size is known when the join is planned, so texts are only shuffled if it is too large to send
    found = written(candidates(build_index(docs.select("doc_id", "text"), rules, segment_rows), rules), "candidates")
    empty = F.array().cast(SPANS)
    text = F.coalesce("row.text", F.lit(""))
    # the caller's columns live in a struct of their own, so no name of theirs meets one of ours
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "__spans"]).alias("row"))
    joined = own.join(found, F.col("row.doc_id") == F.col("id"), "left")
    each = [F.when(F.array_contains("kinds", r.kind) | F.col("row.doc_id").isNull(), spans_of(text, r)).otherwise(empty) if _asks(r) else spans_of(text, r) for r in rules]
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    ranked = F.array_sort(F.transform(F.flatten(F.array(*each)), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    listed = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.select("row", listed.alias("__spans")).select("row.*", "__spans")


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span (overlapping ones together) replaced by ``mask``; texts without secrets stay as they are.

    Null texts stay null; columns and their names pass through as they are, but for ``__spans``, which is dropped.
    """
    columns = [c for c in docs.columns if c != "__spans"]
    found = find_secrets(docs, rules).withColumn("__spans", _before(F.col("__spans"), lambda s: s["end"], F.greatest, 0))
    text = F.col("text")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("__spans") / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice("__spans", b * BLOCK + 1, BLOCK))
    # each block's stretch of the text is cut out once, its pieces from that
    ends = lambda b: F.array_max(F.transform(b, lambda s: F.greatest(s["x"]["end"], s["at"])))
    parts = F.transform(blocks, lambda b: F.struct(b.alias("spans"), b[0]["at"].alias("low"), F.substring(text, b[0]["at"] + 1, ends(b) - b[0]["at"]).alias("part")))

    def masked(p: Column) -> Column:
        piece = lambda s: F.when(s["x"]["start"] >= s["at"], F.concat(F.substring(p["part"], s["at"] - p["low"] + 1, s["x"]["start"] - s["at"]), F.lit(mask))).otherwise("")
        return F.array_join(F.transform(p["spans"], piece), "")

    whole = F.concat(F.array_join(F.transform(parts, masked), ""), F.substring(text, ends(F.col("__spans")) + 1, F.length(text)))
    return found.select(*[F.when(F.size("__spans") > 0, whole).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns])


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("__spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("__spans")).alias("spans"))


QUERIES = {"op4_secret_scans": op4_secret_scans}


def _oracle() -> str:
    """DuckDB: every rule over every text, places from the pieces between matches."""
    each = []
    for rank, r in enumerate(RULES):
        regex = r.regex.replace("'", "''")
        each.append(f"SELECT r, '{r.kind}' AS kind, {rank} AS rank, {r.least} AS least, regexp_split_to_array(t, '{regex}') AS gaps, regexp_extract_all(t, '{regex}') AS al, regexp_extract_all(t, '{regex}', {r.group}) AS part FROM d WHERE regexp_matches(t, '{regex}')")
    sizes = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    start = f"cast({sizes.format('gaps[1:i]')} + {sizes.format('al[1:i-1]')} AS bigint)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(each)}),
s AS (SELECT r, kind, rank, {start} AS a, length(al[i]) AS n FROM m, LATERAL (SELECT unnest(range(1, len(al) + 1)) AS i) WHERE length(part[i]) >= least),
l AS (SELECT *, concat(kind, ':', a, ':', a + n) AS said FROM s)
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg(said, ',' ORDER BY a, rank) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY a, rank), '') AS spans
FROM d LEFT JOIN l USING (r) GROUP BY d.r"""


ORACLES: dict[str, str] = {"op4_secret_scans": _oracle()}
