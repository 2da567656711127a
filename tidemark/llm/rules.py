"""Operator 11: quality rules as a short-circuit cascade, in DataFrame functions only.

Every document gets five base measures and a base verdict. Documents that pass it go
through a cascade of rules: a rule runs only on what all rules before it let pass, so
the order decides what the cascade costs, never what it keeps. The order is found on a
sample: each rule's seconds a row (its own job over the sample, less that of an empty
rule) and the rows that it rejects. The next rule is always the one that rejects most, a
second, of what the rules chosen so far let pass.

Measures are array expressions inside one row, so texts are never exploded or
shuffled. ``_let`` names a value inside an expression; without it Spark would compute
the words again for every element of a lambda.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

#: Rows of the sample that costs and rejections are estimated on, on average.
SAMPLE_ROWS = 1000
#: Each sampled row is judged so often when a rule is timed.
TIMED_REPEATS = 2
#: White space; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Bits of a window's place in a packed number; longer texts compare their windows as strings.
PLACE_BITS = 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _covered(places: Column) -> Column:
    """Words that windows of three at the ascending ``places`` cover."""
    def own(x: Column, k: Column, all_: Column) -> Column:
        return F.least(F.lit(3).cast("long"), F.coalesce(F.get(all_, k + 1) - x, F.lit(3).cast("long")))

    return _let(places, lambda p: _total(F.transform(p, lambda x, k: own(x, k, p))))


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that the array ``words`` has twice or more, each word once.

    A window's 64-bit hash and its place are packed into one number, so equal windows
    are neighbours after a primitive sort. Windows that agree in the hash bits are compared
    word by word; should two differ, all windows of the text are compared as strings.
    """
    mask = (1 << PLACE_BITS) - 1

    def window(i: Column) -> list[Column]:
        return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    def near(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0, F.lit(False))

    def differ(x: Column, y: Column) -> Column:
        a, b = x.bitwiseAND(F.lit(mask)).cast("int"), y.bitwiseAND(F.lit(mask)).cast("int")
        return near(x, y) & (F.array(*window(a)) != F.array(*window(b)))

    size = F.size(words)
    places = F.sequence(F.lit(0), size - 3)

    def as_strings() -> Column:
        rows = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("s"), i.cast("long").alias("i"))))

        def again(s: Column) -> Column:
            same = lambda x, k: F.coalesce(x["s"] == F.get(s, k - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get(s, k + 1)["s"], F.lit(False))
            return _covered(F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])))

        return _let(rows, again)

    packed = F.sort_array(F.transform(places, lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))

    def judged(d: Column) -> Column:
        clash = F.exists(F.transform(d, lambda x, k: F.coalesce(differ(x, F.get(d, k - 1)), F.lit(False))), lambda x: x)
        return F.when(clash, as_strings()).otherwise(_covered(F.sort_array(F.transform(d, lambda x: x.bitwiseAND(F.lit(mask))))))

    def matched(s: Column) -> Column:
        return _let(F.filter(s, lambda x, k: near(x, F.get(s, k - 1)) | near(x, F.get(s, k + 1))), judged)

    fast = _let(packed, matched)
    return F.when(size < 3, F.lit(0).cast("long")).when(size > mask, as_strings()).otherwise(fast)


def base_measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word)."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = _let(lines, lambda s: F.struct(F.size(s).cast("long").alias("n"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("dup")))

    def measured(w: Column, s: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            s["dup"].alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"), s["n"].alias("n_lines"),
        )

    return _let(words, lambda w: _let(of_lines, lambda s: measured(w, s)))


class Rule(NamedTuple):
    """A name and a condition that rejects; it reads the text and the base measures."""

    name: str
    rejects: Column


def default_rules(text: str = "text") -> list[Rule]:
    """Rules that ordinary prose of any language passes."""
    t, words, lines = F.coalesce(F.col(text), F.lit("")), F.col("n_words"), F.col("n_lines")

    def share_of_lines(pattern: str, most: float) -> Column:
        found = F.filter(F.split(t, "\n", -1), lambda s: s.rlike(pattern))
        return F.size(found) > most * lines

    return [
        Rule("symbols", F.col("n_symbols") > 0.1 * words),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 12 * words)),
        Rule("repeated_lines", F.col("n_dup_lines") > 0.6 * lines),
        Rule("shouting", F.length(F.regexp_replace(t, r"\P{Lu}+", "")) > 0.5 * F.length(F.regexp_replace(t, r"\P{L}+", ""))),
        Rule("exclaiming", F.regexp_count(t, F.lit("[!¡！]")) > 0.3 * words),
        Rule("unlettered", F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*\p{L}")) < 0.7 * words),
        Rule("ellipses", share_of_lines(r"(\.\.\.|…)[\x20\x09-\x0D]*\z", 0.3)),
        Rule("bullets", share_of_lines(r"^[\x20\x09-\x0D]*[-*•·▪]", 0.9)),
    ]


def rule_order(rules: list[Rule], rejected: dict[int, int], cost: dict[str, float]) -> list[Rule]:
    """``rules`` by rejection per cost. ``rejected`` counts sampled rows by the bits of the rules that reject them."""
    left, order = list(range(len(rules))), []
    while left:
        def gain(i: int) -> tuple:
            hits = sum(n for bits, n in rejected.items() if bits >> i & 1 and not any(bits >> j & 1 for j in order))
            return -hits / cost[rules[i].name], cost[rules[i].name], rules[i].name

        best = min(left, key=gain)
        left.remove(best)
        order.append(best)
    return [rules[i] for i in order]


def estimate(sample: DataFrame, rules: list[Rule], repeats: int = TIMED_REPEATS) -> tuple[dict[int, int], dict[str, float]]:
    """(rows by the bits of the rules that reject them, seconds of each rule) on a sample that is at hand."""
    bits = [F.when(r.rejects, F.lit(1 << i)).otherwise(0) for i, r in enumerate(rules)]
    counted = sample.groupBy(sum(bits[1:], bits[0]).alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()  # no more rows than the sample
    many = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def seconds(condition: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            many.agg(F.count_if(condition).alias("n")).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    nothing = seconds(F.col("n_words") < 0)
    return {r["bits"]: r["n"] for r in counted}, {r.name: max(seconds(r.rejects) - nothing, nothing / 1000) for r in rules}


def judged(docs: DataFrame, rules: list[Rule] | None = None, *, text: str = "text", least_words: int = 50, most_repeated: float = 0.5, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """``docs`` with the base measures, ``base_failed``, ``kept`` and ``rejected_by``.

    Null and empty texts have no words and fail the base. Every row is judged for itself,
    repeated rows and null ids included. ``rejected_by`` names ``base`` or the rule that rejected,
    null if none did; it depends on the order found, ``kept`` does not. Empty input
    gives an empty table. Columns of ``docs`` with the names of the new ones are replaced.
    """
    rules = default_rules(text) if rules is None else rules
    named = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    new = [*named, "base_failed", "kept", "rejected_by"]
    own = [c for c in docs.columns if c not in new]
    measured = docs.withColumn("__base", base_measures(F.col(text))).select(*own, *[F.col("__base")[c].alias(c) for c in named])
    few, repeated = F.col("n_words") < least_words, F.col("n_repeat_words") > most_repeated * F.col("n_words")
    measured = measured.withColumn("base_failed", few | repeated)
    n = docs.count()
    if n and len(rules) > 1:
        sample = docs.select(text).sample(fraction=min(1.0, sample_rows / n), seed=seed).withColumn("__base", base_measures(F.col(text)))
        sample = cut(sample.select(text, *[F.col("__base")[c].alias(c) for c in named]).where(~(few | repeated)))
        rules = rule_order(rules, *estimate(sample, rules))
    by = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        by = by.when(r.rejects, F.lit(r.name))
    return measured.withColumn("rejected_by", by).withColumn("kept", F.col("rejected_by").isNull()).select(*own, *new)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: DuckDB: all rules at once, in no order.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i + 1 : i + 3] AS x FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM again, range(3) t(o) GROUP BY doc_id
), m AS (
  SELECT doc_id, t, l, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(t, '\p{Lu}')) AS upper, len(regexp_extract_all(t, '\p{L}')) AS letters, len(regexp_extract_all(t, '[!¡！]')) AS bangs,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered,
    len(list_filter(l, lambda s: regexp_matches(s, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS ellipses,
    len(list_filter(l, lambda s: regexp_matches(s, '^[\x20\x09-\x0D]*[-*•·▪]'))) AS bullets
  FROM d LEFT JOIN repeated USING (doc_id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
    OR n_symbols > 0.1 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR n_dup_lines > 0.6 * len(l)
    OR upper > 0.5 * letters OR bangs > 0.3 * n_words OR lettered < 0.7 * n_words OR ellipses > 0.3 * len(l) OR bullets > 0.9 * len(l)) AS kept
FROM based
"""
