"""Operators 11 to 13 against plain loops, and the cases that their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic, rules, search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"


# --- 12: runs -----------------------------------------------------------------------------


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_text(r):
    n, k = r.randint(0, 160), r.randint(1, 4)
    w = [f"w{r.randrange(k)}" for _ in range(n)]
    kind = r.randint(0, 3)
    if kind == 1 and n:
        a = r.randrange(n)
        p = 1 + (n - a) // r.randint(3, 10)
        w = w[:a] + [w[a + i % p] for i in range(n - a)]
    if kind == 2:
        x, y = ["b"], ["b", "a"]
        while len(y) < n:
            x, y = y, y + x
        w = y
    if kind == 3:
        w = w[:30] * r.randint(1, 6)
    return w


def test_runs_match_plain_loops(spark):
    r = random.Random(12)
    texts = {i: r.choice([" ", "\n", "\t\x0b "]).join(periodic_text(r)) for i in range(120)}
    for least, batch in ((12, 400), (3, 1), (50, 10**6)):
        got = periodic.periodic_runs(spark.createDataFrame(list(texts.items()), DOCS), least=least, batch_words=batch)
        for row in got.collect():
            w = WORD.findall(texts[row.doc_id])
            want = plain_runs(w, least)
            assert [tuple(x) for x in row.runs] == want
            assert row.collapsed == collapsed(w, want)


def test_op12_on_planted_documents(spark, tmp_path):
    r = random.Random(5)
    texts = {i: " ".join(f"v{r.randrange(40)}" for _ in range(r.randint(0, 300))) for i in range(90)}
    texts |= {100: None, 101: "", 102: "one", 103: "a " * 500}
    spark.createDataFrame(list(texts.items()), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    seen = 0
    for row in periodic.op12_periodic_runs(spark, str(tmp_path)).collect():
        w, h = WORD.findall(texts[row.doc_id] or ""), zlib.crc32(str(row.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        seen += bool(best)
        assert (row.n_runs, (row.start, row.length, row.period, row.exponent_milli)) == (len(runs), want)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert seen >= 4


def test_runs_stay_within_documents_and_long_texts_are_whole(spark):
    long = [f"x{i % 7}" for i in range(9000)] + [f"y{i}" for i in range(20_000)] + [f"z{i % 3000}" for i in range(9000)]
    rows = [(1, "a b c " * 3), (2, "a b c " * 3), (3, " ".join(long)), (3, "p " * 12), (None, "q " * 12)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], DOCS + ", collapsed string").coalesce(1)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs]) for r in periodic.periodic_runs(df).collect()), key=str)
    whole = [(0, 9000, 7), (29_000, 9000, 3000)]
    assert got == sorted([(1, []), (2, []), (3, whole), (3, [(0, 12, 1)]), (None, [(0, 12, 1)])], key=str)
    assert periodic.periodic_runs(df.limit(0)).collect() == []


def test_wavelet_matrix_counts_and_selects(spark):
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (64, 64), (777, 5000)):
        v = rng.integers(0, top, n)
        t = periodic.WaveletMatrix(v, top)
        lo = rng.integers(0, n, 200)
        hi = lo + 1 + (rng.random(200) * (n - lo)).astype(int)
        x = rng.integers(0, top + 3, 200)
        assert t.below(lo, hi, x).tolist() == [int((v[a:b] < c).sum()) for a, b, c in zip(lo, hi, x)]
        k = (rng.random(200) * (hi - lo)).astype(int)
        assert t.select(lo, hi, k).tolist() == [int(np.sort(v[a:b])[i]) for a, b, i in zip(lo, hi, k)]


# --- 13: search ---------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    """docs: (id, text) rows; items: (id, text) rows -> {(id, text): [(rank, doc_id, score)]}."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(d, Counter(TERM.findall((t or "").translate(fold)))) for d, t in docs]
    n_docs = sum(1 for _, c in terms if c)
    total = sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = {}
    for i, text in set(items):
        if text is None:
            continue
        scored = []
        for d, c in terms:
            if not c:
                continue
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in TERM.findall(text.translate(fold)))
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out[i, text] = [(r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return out


def searched(df):
    out = defaultdict(list)
    for r in df.orderBy("item_id", "tag", "rank").collect():
        out[r.item_id, r.tag].append((r.rank, r.doc_id, r.score))
    return out


@pytest.mark.parametrize("postings", [10**6, 40, 3])
def test_search_matches_a_plain_ranking(spark, postings):
    r = random.Random(13)
    vocabulary = ["the", "The", "of", "é", "Émile", "ß", "x1", "42", "co-op", "a_b", "日本", "İ"] + [f"t{i}" for i in range(60)]
    def text(n):
        return " ".join(r.choice(vocabulary[: r.randint(1, len(vocabulary))]) for _ in range(n))

    docs = [(i, text(r.randint(0, 60))) for i in range(150)] + [(i, "the of t1") for i in range(200, 240)] + [(7, "t2 t2 t2"), (7, "t2 t2 t2"), (None, "t2 t2 t2"), (900, None), (901, ""), (902, "--")]
    items = [(i, text(r.randint(0, 12))) for i in range(12)] + [(3, "t2 The the"), (3, "t2 The the"), (3, "other words t2"), (50, None), (51, ""), (None, "t2 of")]
    got = searched(search.search(spark.createDataFrame([(*d, "n") for d in docs], DOCS + ", tag string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int").repartition(3), postings=postings))
    want = {(i, hashlib.md5(t.encode()).hexdigest()): rows for (i, t), rows in plain_search(docs, items).items() if rows}
    assert got == want


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_heaps_keep_the_best_whatever_the_order():
    r = random.Random(3)
    rows = [(r.randrange(5), r.randint(1, 9), r.random() < 0.1, i % 40) for i in range(2000)]
    heaps = search.Heaps(10, 5)
    for a in range(0, 2000, 37):
        heaps.offer(*[np.array(x) for x in zip(*rows[a : a + 37])])
    got = sorted(zip(*[x.tolist() for x in heaps.rows]))
    want = [x for i in range(5) for x in sorted((y for y in rows if y[0] == i), key=lambda y: (-y[1], y[2], y[3]))[:10]]
    assert got == sorted(want)


def test_scores_beyond_exact_doubles_are_summed_as_integers(spark):
    docs = spark.createDataFrame([(i, f"w{i} w{i}") for i in range(3)], DOCS)
    many = " ".join(["w1"] * 3_000_000)  # one term repeated: weight x 3 million x part is over 2^53
    got = search.search(docs, spark.createDataFrame([(1, many)], "item_id long, text string")).first()
    w = search.term_weight(3, 1)
    assert got.score == 3_000_000 * w * (2_000_000_000 // (2000 + 8 * search.length_part(2, 3, 6)))


# --- 11: rules ----------------------------------------------------------------------------


def plain_measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [s for s in t.split("\n") if WORD.search(s)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + o for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for o in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def rule_texts():
    r = random.Random(11)
    words = ["the", "of", "naïve", "日本語", "x|y", "#", "**", "end.", "😀", "<b>"]
    texts = [r.choice(["", " "]).join([" ".join(r.choice(words) for _ in range(r.randint(0, 8))) + r.choice(["\n", " ", "\r\n", "\t"]) for _ in range(r.randint(0, 40))]) for _ in range(60)]
    return texts + [None, "", " \n\t", "one", "a b", "a b c a b c", "a b c " * 100, "same line\n" * 80, "SHOUT LOUD " * 40, "what! now! " * 50, "--- 12 34 " * 50, "wait for it...\n" * 60, "\n".join(f"- item {i} of the list here" for i in range(40)), "clean prose goes on here " + " ".join(f"word{i}" for i in range(90))]


def test_base_measures_match_plain_loops(spark, monkeypatch):
    texts = rule_texts()
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], DOCS + ", n_words int")
    for bits in (20, 3):  # with three bits longer texts go the way of strings
        monkeypatch.setattr(rules, "PLACE_BITS", bits)
        for row in rules.judged(df, []).collect():
            got = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
            assert got == plain_measures(texts[row.doc_id])
            assert row.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
            assert row.kept == (not row.base_failed) and (row.rejected_by == "base") == row.base_failed


def test_windows_with_equal_hash_bits_are_told_apart(spark, monkeypatch):
    """With 62 bits for the place the hash has two, so most texts hold different windows that look alike."""
    texts = [" ".join(f"u{i % k}x" for i in range(n)) for n in (5, 30, 90) for k in (4, 17, 200)]
    monkeypatch.setattr(rules, "PLACE_BITS", 62)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for row in rules.judged(df, []).collect():
        assert row.n_repeat_words == plain_measures(texts[row.doc_id])[4]


def test_order_decides_cost_and_not_the_verdict(spark):
    texts = rule_texts()
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    default = rules.default_rules()
    one = {r.doc_id: r.kept for r in rules.judged(df).collect()}
    other = {r.doc_id: r.kept for r in rules.judged(df, default[::-1], sample_rows=10**9).collect()}
    assert one == other
    assert one[len(texts) - 1] and not any(one[len(texts) - i] for i in range(2, 8))


def test_rules_are_ordered_by_rejection_per_cost():
    named = [rules.Rule(x, None) for x in "abcd"]
    # a rejects 10 at cost 1; b rejects the same 10 and 5 more at cost 1.2; c rejects 6 others at cost 3; d nothing
    rejected = {0b0011: 10, 0b0010: 5, 0b0100: 6, 0: 100}
    order = rules.rule_order(named, rejected, {"a": 1.0, "b": 1.2, "c": 3.0, "d": 0.5})
    assert [r.name for r in order] == ["b", "c", "d", "a"]


def test_rules_run_no_python_and_survive_empty_tables(spark):
    df = spark.createDataFrame(list(enumerate(rule_texts())), DOCS)
    plan = rules.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert rules.judged(df.limit(0)).count() == 0
    again = rules.judged(df.unionByName(df).withColumn("kept", F.lit("x")).withColumn("doc_id", F.lit(None).cast("long")))
    assert again.count() == 2 * df.count() and dict(again.dtypes)["kept"] == "boolean"
