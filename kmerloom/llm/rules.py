"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule compares a count of a text with a share of another count, such as symbols with words, and has a few cutoffs from lenient to strict;
a configuration is one cutoff, or none, for each rule. For every stratum (a language) the labelled documents are the holdout: how many
good ones a configuration rejects is a binomial count, and the configuration is proven if the exact binomial tail at ``RISK`` is at
most ``ERROR`` over the number of all hypotheses (strata times configurations, Bonferroni). So with probability 1 - ``ERROR`` no stratum
loses more than ``RISK`` of its good documents that pass the base rules, however the configuration is picked among the proven ones: the
one that rejects the most documents labelled bad is taken. A stratum without a proven configuration rejects nothing.

Texts are measured where they lie, in one pass; what is shuffled are counts, and the classes of labelled texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import table, written

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The share of good documents of a stratum that may be rejected, and the chance that any stratum's true share is larger.
RISK, ERROR = 0.05, 0.05
_SPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """Rejects where 100 * ``count`` >= cutoff * ``of`` and ``count`` > 0; cutoffs fall, so each rejects what the ones before it do."""

    count: str
    of: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("n_symbols", "n_words", (100, 30, 10)),
    Rule("n_dup_lines", "n_lines", (60, 40, 25)),
    Rule("n_capitals", "word_chars", (60, 40, 25)),
    Rule("n_repeat_words", "n_words", (25, 15, 8)),
)
#: Counts of a text, in the order of ``measure``.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _long(c: Column, name: str) -> Column:
    return c.cast("long").alias(name)


def measure(docs: DataFrame, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(row, counts) for each row of ``docs(text)``: ``row`` a struct of the carried columns (all by default), ``counts`` one of ``COUNTS``.

    Words lie between blanks; lines are those with a word, a duplicate one equals an earlier line; repeated words lie in windows of
    ``WINDOW`` words that the text holds twice or more. Null, empty and blank texts count nothing. Each step is a projection of its own:
    arrays that lambdas look into are computed once. Windows are compared by 64-bit hashes of hashes.
    """
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    bare = F.btrim(text, F.lit(_SPACE))
    words = F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    own = docs.select(
        row,
        words.alias("w"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).alias("n_capitals"),
    )
    after = lambda a, step: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step)))
    own = own.select("*", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), after(F.col("w"), 1).alias("h2")).drop("w", "lines")
    own = own.withColumn("h4", after(F.col("h2"), 2)).drop("h2")
    own = own.withColumn("h8", F.slice(after(F.col("h4"), 4), F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)))).drop("h4")
    # few texts repeat a window: only those are sorted
    placed = F.sort_array(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    own = own.withColumn("sorted", F.when(F.size(F.array_distinct("h8")) < F.size("h8"), placed)).drop("h8")
    same = lambda i, j: F.coalesce(F.get("sorted", i)["h"] == F.get("sorted", j)["h"], F.lit(False))
    twice = F.filter(F.transform("sorted", lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["p"])), lambda p: p.isNotNull())
    own = own.withColumn("starts", F.sort_array(twice)).drop("sorted")
    step = F.transform("starts", lambda p, i: F.least(F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    covered = F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0))
    return own.withColumn("n_repeat_words", covered).select("row", F.struct(*[_long(F.col(c), c) for c in COUNTS]).alias("counts"))


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])


def level(counts: Column, rule: Rule) -> Column:
    """How many of the rule's cutoffs reject the text. The strict cutoffs are the last, so a configuration's cutoff number c rejects
    what has a level of at least that many from the end."""
    hits = [F.when((counts[rule.count] > 0) & (100 * counts[rule.count] >= cut * counts[rule.of]), 1).otherwise(0) for cut in rule.cutoffs]
    return reduce(Column.__add__, hits)


def rejects(levels: Column, config: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text of these levels is rejected by a configuration: its digit for a rule is 0 (off) or the cutoff's place, from 1."""
    out, base = F.lit(False), 1
    for i, r in enumerate(rules):
        digit = F.pmod(F.floor(config / base), F.lit(len(r.cutoffs) + 1))
        # the text fails the cutoffs from place len - level + 1 on
        out = out | ((digit > 0) & (levels[i] + digit > len(r.cutoffs)))
        base *= len(r.cutoffs) + 1
    return out


def configurations(rules: tuple[Rule, ...]) -> int:
    return math.prod(len(r.cutoffs) + 1 for r in rules)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, from 16 places further on so that it holds for small n; the error is below 1e-12."""
    y = n.cast("double") + 16
    series = (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(reduce(Column.__mul__, [(y - i) / 16 for i in range(16)])) - 16 * math.log(16)


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= x). Terms further below x than forty deviations are left out, under 1e-300 of the sum; for x beyond the mean, where the
    tail is about a half or more, it is given as 1."""
    lowest = F.greatest(x - F.ceil(40 * F.sqrt(x + 1.0)).cast("long"), F.lit(0).cast("long"))
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = F.aggregate(F.sequence(lowest, x), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(x > n * p, 1.0).otherwise(F.least(total, F.lit(1.0)))


def holdout(measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, label: str = "quality") -> DataFrame:
    """(stratum, levels, good, bad): labelled texts that pass the base rules, counted by stratum and levels.

    ``measured(row.doc_id, stratum, levels, failed, h)``. Copies of a text in a stratum count once, as they are no independent draws, and
    are good if any of them is; an id or text with both labels is good, so that doubt never helps a rule. Labels other than 0 and 1 are none.
    """
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    own = measured.where(~F.col("failed")).select(F.col("row.doc_id").alias("id"), "stratum", "levels", "h")
    texts = own.join(marks, "id").groupBy("stratum", "h").agg(F.max("y").alias("y"), F.min("levels").alias("levels"))
    return texts.groupBy("stratum", "levels").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))


def proven(counted: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, config, n, false_rejections, caught, p): the configuration picked in each stratum, of those that are proven; of equal ones
    that with the fewest false rejections, then the smallest number. Strata that prove none are not there."""
    every = configurations(rules)
    each = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(every - 1))).alias("config"))
    hit = rejects(F.col("levels"), F.col("config"), rules)
    sums = each.groupBy("stratum", "config").agg(F.sum("good").alias("n"), F.coalesce(F.sum(F.when(hit, F.col("good"))), F.lit(0)).alias("false_rejections"), F.coalesce(F.sum(F.when(hit, F.col("bad"))), F.lit(0)).alias("caught"))
    strata = counted.agg((F.count_distinct("stratum") + F.max(F.col("stratum").isNull().cast("int"))).alias("strata"))
    tested = sums.withColumn("p", binomial_tail(F.col("false_rejections"), F.col("n"), risk)).join(F.broadcast(strata), F.col("p") <= F.lit(error) / (F.col("strata") * every))
    best = F.max_by(F.struct("config", "n", "false_rejections", "caught", "p"), F.struct("caught", -F.col("false_rejections"), -F.col("config")))
    return tested.groupBy("stratum").agg(best.alias("x")).select("stratum", "x.*")


def judge(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] | None = None, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR, label: str = "quality") -> DataFrame:
    """(row, counts, base_failed, kept) for each row of ``docs(doc_id, text, <stratum>)``; ``row`` is a struct of the carried columns, all by
    default, so no name of theirs meets one of ours.

    What is kept passes the base rules and is not rejected by its stratum's configuration. Null strata are a stratum; null doc_ids have no
    label; rows that repeat an id are judged each by its own text; with no labels or an empty table only the base rules hold. A
    null label counts as none. Which configurations were picked is what ``proven(holdout(...))`` says.
    """
    columns = tuple(docs.columns) if carry is None else carry
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"), F.col("doc_id"), F.col(f"`{stratum}`").alias("stratum"), F.xxhash64("text").alias("h"), "text")
    own = measure(inner, ("own", "doc_id", "stratum", "h"))
    levels = F.array(*[level(F.col("counts"), r) for r in rules])
    own = own.select(F.struct("row.doc_id", "row.own").alias("row"), "row.stratum", "row.h", "counts", base_failed(F.col("counts")).alias("failed"), levels.alias("levels"))
    own = written(own, "measured")
    # a row for each stratum, of known size: sent if small, else the join can split a hot stratum
    picked = written(proven(holdout(own, labels, rules, label), rules, risk, error).select(F.col("stratum").alias("of"), "config"), "cutoffs")
    joined = own.join(picked, F.col("stratum").eqNullSafe(F.col("of")), "left")
    rejected = F.coalesce(rejects(F.col("levels"), F.col("config"), rules), F.lit(False))
    return joined.select(F.col("row.own").alias("row"), "counts", F.col("failed").alias("base_failed"), (~F.col("failed") & ~rejected).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with their columns."""
    return judge(docs, labels, **how).where("kept").select("row.*")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), ("doc_id",))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("row.doc_id", *[f"counts.{c}" for c in base], "base_failed", "kept")


QUERIES = {"op11_quality_rules": op11_quality_rules}


def _oracle() -> str:
    """DuckDB: the same counts, holdouts, exact tails and verdicts."""
    every = configurations(RULES)
    levels = ", ".join(" + ".join(f"(CASE WHEN {r.count} > 0 AND 100 * {r.count} >= {c} * {r.of} THEN 1 ELSE 0 END)" for c in r.cutoffs) + f" AS l{i}" for i, r in enumerate(RULES))
    hits, base = [], 1
    for i, r in enumerate(RULES):
        digit = f"(config // {base} % {len(r.cutoffs) + 1})"
        hits.append(f"({digit} > 0 AND l{i} + {digit} > {len(r.cutoffs)})")
        base *= len(r.cutoffs) + 1
    hit = " OR ".join(hits)
    log_term = f"lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, text FROM documents),
f AS (SELECT r, doc_id, lang, text, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals FROM t),
g AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS gram FROM f, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)),
d AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
k AS (SELECT r, count(DISTINCT p) AS n FROM d, LATERAL (SELECT unnest(range(i, i + {WINDOW})) AS p) GROUP BY r),
c AS (SELECT f.r, doc_id, lang, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, n_capitals, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words FROM f LEFT JOIN k USING (r)),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {levels} FROM c),
y AS (SELECT doc_id, max(quality) AS y FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
x AS (SELECT lang, max(y) AS y, any_value(l0) AS l0, any_value(l1) AS l1, any_value(l2) AS l2, any_value(l3) AS l3 FROM v JOIN y USING (doc_id) WHERE NOT base_failed GROUP BY lang, text),
s AS (SELECT lang, config, count(*) FILTER (y = 1) AS n, count(*) FILTER (y = 1 AND ({hit})) AS x, count(*) FILTER (y = 0 AND ({hit})) AS caught FROM x, range({every}) c(config) GROUP BY lang, config),
p AS (SELECT lang, config, x, caught FROM s WHERE x <= n * {RISK} AND list_sum(list_transform(range(0, x + 1), lambda i: exp({log_term}))) <= {ERROR} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM x)) * {every})),
b AS (SELECT lang, arg_max(config, (caught, -x, -config)) AS config FROM p GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({hit}, false) AS kept FROM v LEFT JOIN b ON v.lang IS NOT DISTINCT FROM b.lang"""


ORACLES: dict[str, str] = {"op11_quality_rules": _oracle()}
