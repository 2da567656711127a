"""Corpus operators against brute force on small fixtures, and their edge cases."""

import hashlib
import pickle
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF, normal
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontaminate, embeddings, lines, mixing, pages, quality, queries, simhash, substrings, tokens, toxicity
from tidemark.llm.common import connected_components, labelled_sample, table

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng, text):
    w = text.split(" ")
    w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, repeats, null, empty and long texts."""
    rng = random.Random(4)
    texts = [None, "", "   \n\t ", "one", "ab " * 400, words(rng, 3000)]
    base = [words(rng, 120) + "\n" + words(rng, 60) for _ in range(12)]
    texts += base + base[:4] + [edited(rng, t) for t in base[:6] for _ in range(3)]
    passage = words(rng, 70)
    texts += [words(rng, 40) + " " + passage + " " + words(rng, 30) for _ in range(3)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[8])  # a repeated row
    return spark.createDataFrame(rows, DOC), rows


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)] + [(100, 100 + i) for i in range(1, 40)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components({x for e in edges for x in e}, edges)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_substrings(spark, corpus):
    df, rows = corpus
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen: dict[bytes, int] = {}
    for _, t in texts:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    want = []
    for d, t in texts:
        cover = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                cover[i : i + 200] = True
        spans = int((cover[1:] & ~cover[:-1]).sum() + cover[0])
        want.append((d, len(t), int(cover.sum()), spans, hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    found = substrings.remove_repeated(df)
    got = [(r["doc_id"], sum(s["b"] - s["a"] for s in r["spans"]) + len(r["kept"]), sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found.collect()]
    assert sorted(got) == sorted(want)
    assert substrings.remove_repeated(df.limit(0)).count() == 0


def test_substrings_of_long_repeated_and_clashing_rows(spark):
    """A text of several pieces with repeats across their border; rows that repeat; other columns."""
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(substrings.CHUNK + 4000))
    border = long[substrings.CHUNK - 300 : substrings.CHUNK + 300]
    rows = [(1, long, 5, "x"), (2, "start " + border + " end", 6, "y")] + [(3, words(rng, 100), 7, "z")] * 40 + [(None, None, 8, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k long, spans string").repartition(4)
    got = sorted(((r["doc_id"], [(s["a"], s["b"]) for s in r["spans"]], len(r["kept"])) for r in substrings.remove_repeated(df).collect()), key=str)
    edge = substrings.CHUNK - 300
    third = len(rows[2][1])
    want = [(1, [(edge, edge + 600)], len(long) - 600), (2, [(6, 606)], 10)] + [(3, [(0, third)], 0)] * 40 + [(None, [], 0)]
    assert got == sorted(want, key=str)
    keyed = df.select(F.xxhash64("doc_id", "text").alias("k"), F.lit(1).cast("long").alias("k2"), F.col("text").cast("binary").alias("text"))
    assert max(len(r["spans"]) for r in substrings.repeated_spans(keyed.where("text IS NOT NULL")).collect()) < third


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op7_mix_sources", "op10_simhash"])
def test_matches_sql(spark, duck, name):
    ours, theirs = normal(queries.queries()[name](spark, SF).toPandas()), normal(duck.execute(queries.oracle_sql()[name]).df())
    assert ours == theirs and len(ours[1]) > 0


def test_suffix_order_on_random_bytes():
    rng = np.random.default_rng(0)
    raw = bytes(rng.integers(97, 99, 3000).astype(np.uint8))
    raw += raw[100:500] + raw[700:1200]
    n = len(raw) - 59
    buf = np.frombuffer(raw + bytes(80), np.uint8)
    got = substrings.repeated_starts(buf, np.arange(n), np.zeros(n, np.int64), 60)
    seen: dict[bytes, int] = {}
    for i in range(n):
        seen[raw[i : i + 60]] = seen.get(raw[i : i + 60], 0) + 1
    assert got.tolist() == [seen[raw[i : i + 60]] > 1 for i in range(n)]


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    vs = [*base, *(base[:20] + rng.normal(scale=0.05, size=(20, 16))), *(base[:10] * 3.0), *(base[:10] + rng.normal(scale=0.2, size=(10, 16)))]
    rows = [(i, [float(x) for x in np.float32(v)], 0) for i, v in enumerate(vs)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [1.0, 2.0], 1), (505, [1e38] * 16, 1), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    n, linked = [0] * len(good), []
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= 0.95:
                n[a] += 1
                n[b] += 1
                linked.append((good[a][0], good[b][0]))
    comp = components({r[0] for r in rows}, linked)
    want = sorted((i, k, comp[i], comp[i] == i) for (i, _), k in zip(good, n))
    got = sorted(tuple(r) for r in embeddings.near_vectors(df).collect())
    assert len(got) == len(rows)
    bad = {500, 501, 502, 503}
    assert [g for g in got if g[0] in bad] == [(i, 0, i, True) for i in sorted(bad)]
    found = sum(g[1] for g in got)
    assert found >= 0.9 * sum(w[1] for w in want)
    assert [g for g in got if g[0] not in bad] == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def off_centre(norm, n=2200, d=64, near=300):
    """Unit vectors whose mean has about that norm, then ``near`` more at cosine 0.95 to 0.97 to the first."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, d))
    x = np.sqrt(1 - norm**2) * x / np.linalg.norm(x, axis=1)[:, None]
    x[:, 0] += norm
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = rng.normal(size=(near, d))
    w -= (w * x[:near]).sum(1)[:, None] * x[:near]
    c = rng.uniform(0.9501, 0.97, near)[:, None]
    return np.vstack([x, c * x[:near] + np.sqrt(1 - c**2) * w / np.linalg.norm(w, axis=1)[:, None]])


@pytest.mark.parametrize("norm", [0.8, 0.9, 0.97])
def test_embeddings_off_centre(spark, norm):
    x = off_centre(norm)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = int((x @ x.T >= 0.95).sum()) - len(x)
    found = sum(r["n_links"] for r in embeddings.near_vectors(df).collect())
    assert 0.95 * want <= found <= want


def test_embeddings_recall_on_the_table(spark):
    """The table at sf0.01 and near copies of a quarter of it, in eight buckets and more."""
    rng = np.random.default_rng(3)
    rows = table(spark, "/root/testdata/sf0.01", "embeddings").select("embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    w = rng.normal(size=x[::4].shape)
    near = x[::4] / np.linalg.norm(x[::4], axis=1)[:, None] + rng.uniform(0.2, 0.31, (len(w), 1)) * w / np.linalg.norm(w, axis=1)[:, None]
    x = np.vstack([x, near])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df, bucket_rows=64).collect()}
    assert len(got) == len(x) and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.95 * want.sum() > 100


def test_embeddings_in_hot_buckets_and_many_tables(spark, monkeypatch):
    """One group of near vectors in one bucket of each table, in blocks of 60 rows."""
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(1200, 32)), 3 * rng.normal(size=32) + rng.normal(scale=0.3, size=(200, 32))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    groups = embeddings.map_groups
    monkeypatch.setattr(embeddings, "map_groups", lambda *a, block_rows, **k: groups(*a, block_rows=60, **k))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df, bucket_rows=8).collect()}
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.95 * want.sum() > 1000


@pytest.mark.parametrize("direct_rows", [256, 3])
def test_embeddings_of_many_lengths(spark, direct_rows):
    lengths = range(2, 72) if direct_rows == 256 else range(30, 42)
    vs = [v for d in lengths for v in off_centre(0.0, 3, d, 1)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    want = [0] * len(vs)
    for i, v in enumerate(vs):
        want[i] = sum(len(u) == len(v) and u @ v >= 0.95 for u in vs) - 1
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(df, direct_rows=direct_rows, least_cosine=0.95).collect()}
    assert [got[i] for i in range(len(vs))] == want
    assert all(want[k * 4] for k in range(len(lengths)))


def test_pages():
    body = "<p>" + "Long text with many words that goes on. " * 5 + "</p><p>Short.</p><p>A &amp; b&nbsp; c<br>d</p>"
    want = ("Long text with many words that goes on. " * 5).strip() + "\n\nShort.\n\nA & b c d"
    noise = '<nav><ul><li><a href="/">Home</a></li></ul></nav><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side</p></div><form><label>Name</label></form>'
    tail = '<section id="comments"><article class="comment"><p>I disagree at great length with all of this text</p></article></section><footer>end</footer><script>var x = "<p>no</p>";</script>'
    for page in (
        f"<html><head><title>t</title><style>p{{}}</style></head><body>{noise}<article>{body}</article>{tail}</body></html>",
        f"<html><body>{noise}<main>{body}</main>{tail}",
        f'<html><body>{noise}<div class="content">{body}</div>{tail}</body></html>',
    ):
        assert pages.main_text(page) == want
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>x</nav>") == ""


def test_pages_main_beside_an_unmarked_article():
    main = "<p>" + "Long text with many words that goes on. " * 12 + "</p>"
    reply = "<p>" + "I disagree with all of this, and at length. " * 3 + "</p>"
    want = "\n\n".join([("Long text with many words that goes on. " * 12).strip()] * 4)
    assert pages.main_text(f"<body><nav>x</nav><main>{main * 4}</main><article>{reply}</article></body>") == want
    assert pages.main_text(f"<body><nav>x</nav><main>{main * 4}<article>{reply}</article></main></body>").startswith(want)
    assert pages.main_text(f"<body><main><p>Links and more</p><article>{main * 4}</article></main><article>{reply}</article></body>") == want


def test_pages_keeps_sibling_sections_and_wrappers():
    def words(n):
        return ("word " * n)[: n - 1] + "."

    first, second = [words(30), words(2000), words(400), words(400), words(400)], [words(30)] + [words(200)] * 6
    for kind in ("section", "div"):
        page = "<body><nav>x</nav><div>" + "".join(f"<{kind}><h2>{part[0]}</h2>" + "".join(f"<p>{t}</p>" for t in part[1:]) + f"</{kind}>" for part in (first, second)) + "</div></body>"
        assert pages.main_text(page) == "\n\n".join(first + second)
    body, want = f"<p>{words(500)}</p>" * 4, "\n\n".join([words(500)] * 4)
    side = f'<div class="sidebar"><p>{words(100)}</p></div>'
    for wrapper in ('div class="content with-sidebar"', 'div id="search-page"', 'form action="/page"', 'div class="post comments-open"'):
        assert pages.main_text(f"<body><nav>x</nav><{wrapper}>{body}{side}</{wrapper.split()[0]}></body>") == want, wrapper
    replies = f'<div class="comments"><p>{words(90)}</p><p>{words(90)}</p></div><div class="ad">{words(600)}</div>'
    assert pages.main_text(f"<body><div>{body}</div>{replies}</body>") == want
    assert pages.main_text(f"<body><article><p>{words(120)}</p></article>{replies}</body>") == words(120)


LONG = ("Long text with many words that goes on. " * 12).strip()


def test_pages_without_named_content():
    links = "<ul>" + "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(20)) + "</ul>"
    want = f"{LONG}\n\n{LONG}"
    assert pages.main_text(f"<body><div>{links}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>") == want
    assert pages.main_text(f"<body>{links}<p>{LONG}</p><p>{LONG}</p></body>") == want


def test_pages_bring_no_sidebar_back_by_weight():
    teaser = "".join(f"<div><h3>Teaser {i}</h3><p>{LONG} {LONG}</p></div>" for i in range(3))
    content = f"<p>{LONG}</p><p>{LONG[:90]}</p>"
    want = f"{LONG}\n\n{LONG[:90].strip()}"
    for name in ("sidebar", "promo", "cookie-notice", "comments", "related"):
        assert pages.main_text(f'<body><div class="content">{content}</div><div class="{name}">{teaser}</div></body>') == want, name
        assert pages.main_text(f'<body><div class="{name}">{teaser}</div><div>{content}</div></body>') == want, name
    # a wrapper with the page's h1, or with all of its prose, is the content whatever its name
    assert pages.main_text(f'<body><p>{LONG[:90]}</p><div class="sidebar"><h1>Title</h1>{teaser}</div></body>').startswith("Title")
    assert pages.main_text(f'<body><p>By someone</p><div class="widget">{content}</div></body>').endswith(want)


def unnamed_page(r):
    """A page of plain elements and its text: menus, prose of uneven length, link lists around."""
    def prose(n):
        return " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) for _ in range(n)) + "."

    def links(n):
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose(2)}</a></li>' for i in range(n)) + "</ul>"

    body = [f"<p>{prose(r.randint(25, 90))}</p>" for _ in range(r.randint(3, 9))]
    for _ in range(r.randint(0, 2)):  # short paragraphs between long ones
        body.insert(r.randint(1, len(body) - 1), f"<p>{prose(r.randint(3, 8))}</p>")
    small = "".join(f"<p><b>{prose(2)}</b></p>" for _ in range(r.randint(3, 6)))  # no links, but short
    html = f"<html><body><div>{links(r.randint(4, 9))}</div><div>{''.join(body)}</div><div>{small}</div><div>{links(r.randint(3, 8))}</div></body></html>"
    return html, "\n\n".join(x[3:-4] for x in body)


def test_clusters_find_the_content_of_pages_that_name_none(monkeypatch):
    r = random.Random(4)
    made = [unnamed_page(r) for _ in range(200)]
    assert sum(pages.main_text(h) == want for h, want in made) >= 196
    # without the clusters the same pages come out wrong: they decide here
    monkeypatch.setattr(pages, "content_cluster", lambda chars, tags, sigma=1.0: np.arange(len(chars)) % 2 == 0)
    assert sum(pages.main_text(h) == want for h, want in made) < 100


def test_pages_two_articles_forms_and_class_names():
    body = f"<p>{LONG}</p>" * 3
    want = "\n\n".join([LONG] * 3)
    assert pages.main_text(f"<body><article>{body}</article><div>x</div><article>{body[: 2 * len(body) // 3]}</article></body>") == "\n\n".join([LONG] * 5)
    assert pages.main_text(f"<body><form action='/'><label>q</label><article>{body}</article></form></body>") == want
    for name in ("content social", "post-tags-list", "main-nav-page"):
        assert pages.main_text(f'<body><nav>a</nav><div class="{name}">{body}</div></body>') == want, name
        assert pages.main_text(f'<body><nav>a</nav><article class="{name}">{body}</article></body>') == want, name


def test_pages_clusters_choose_the_region(monkeypatch):
    menu = "".join(f'<p><a href="/{i}">A link to page {i}</a></p>' for i in range(12))
    page = f"<body><div>{menu}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    two = f"<body><article><p>{LONG}</p></article><main>{menu}</main></body>"
    right, right_two = pages.main_text(page), pages.main_text(two)
    assert right == f"{LONG}\n\n{LONG}" and right_two == LONG
    monkeypatch.setattr(pages, "content_cluster", lambda chars, tags, sigma=1.0: np.arange(len(chars)) % 2 == 0)
    assert pages.main_text(page) != right
    monkeypatch.setattr(pages, "content_cluster", lambda chars, tags, sigma=1.0: chars < 100)
    assert pages.main_text(page) != right


@pytest.mark.parametrize("tag", ["div", 'div class="content social"', "span", "article", "ul"])
def test_pages_deep_nesting_takes_linear_time(tag):
    began = time.time()
    got = pages.main_text(f"<{tag}>" * 20_000 + f"<p>{LONG}</p>" + "</b>" * 20_000 + f"</{tag.split()[0]}>" * 20_000)
    assert got == LONG and time.time() - began < 10


def test_pages_tables(spark):
    long = f"<article><p>{LONG}</p>" + f"<p>{LONG}</p>" * 2000 + "</article>"
    df = spark.createDataFrame([(1, "u", long, 5), (None, None, "", 6), (1, "u", long, 5)], "page_id long, url string, html string, n_chars int")
    got = pages.extract(df)
    assert got.columns == ["page_id", "url", "html", "n_chars", "text"]
    assert sorted(len(r["text"]) for r in got.collect()) == [0] + [2001 * len(LONG) + 4000] * 2
    assert pages.extract(df.limit(0)).count() == 0


def test_pages_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "<p>a</p>", "y"), (2, "u", "<p>a</p>", "y")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in pages.extract(df).collect()) == [(1, ""), (2, "a"), (2, "a")]


def test_toxicity_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 5.0, "trash": 4.0, "lowei*": 3.0}).build()
    for t in ("you IDIOT!!", "1d10t", "ıdiot idi0t", "іdіоt", "i​diot", "idiot###"):
        assert lex.measure(t)[1] >= 1, t
    assert lex.measure("a trash can here")[1] == 0
    assert lex.measure("loweihr und loweia")[1] == 2
    assert lex.measure("idiotic")[1] == 0
    assert lex.measure(None) == lex.measure("") == (0.0, 0, 0)
    assert lex.measure("call 555-1234 or 2024-01-01")[1] == 0


def test_toxicity_substitutes_in_long_runs():
    lex = toxicity.Lexicon({"idiot": 5.0, "trash": 4.0}).build()
    for sep in (",", "/", "-", ";", "...", "_", "!!!!", "~" * 50):
        assert lex.measure(sep.join(["1d10t", "tr4sh"] * 5))[1] == 10, sep
    assert lex.measure("1d10t!," * 10)[1] == 10
    assert lex.measure("x" * 60 + "/1d10t?tr4sh")[1] == 2
    assert lex.measure("see/1d107")[1] == 1
    assert lex.measure("3fa85f64-5717-4562-b3fc-2c963f66afa6" * 3)[1] == 0


def test_toxicity_exceptions_are_found_and_cost_linear_time(spark):
    rng = random.Random(2)
    lex = toxicity.Lexicon({"bad": 2.0, "vile*": 3.0, "villa*": 1.0}, ("bad luck", "vile of bad")).build()
    pool = ["bad", "luck", "vile", "vileness", "villain", "of", "good", "badly", "BAD!", "b4d"]
    for _ in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        w = toxicity.fold(text).split()
        spared = {i + j for i in range(len(w)) for phrase in (["bad", "luck"], ["vile", "of", "bad"]) if w[i : i + len(phrase)] == phrase for j in range(len(phrase))}
        want = [max([2.0] * (x == "bad") + [3.0] * x.startswith("vile") + [1.0] * x.startswith("villa"), default=0) for i, x in enumerate(w) if i not in spared]
        assert lex.measure(text) == (sum(want), sum(x > 0 for x in want), len(w)), text
    began = time.time()
    assert lex.measure("bad luck bad " * 30_000)[1] == 30_000 and time.time() - began < 5
    labelled = [(f"you vermin {words(rng, 5)}", 1) for _ in range(200)] + [(f"the vermin count {words(rng, 5)}", 0) for _ in range(20)] + [(words(rng, 8), 0) for _ in range(1200)]
    learned = toxicity.learn_lexicon(spark.createDataFrame(labelled, "text string, toxic int"), least_odds=1.0)
    assert "vermin count" in learned.exceptions and learned.measure("the vermin count")[1] == 0 < learned.measure("you vermin")[1]


def test_toxicity_tables(spark):
    lex = toxicity.Lexicon({"idiot": 5.0}, bias=-4.0, by_sum=2.0, by_rate=1.0)
    long = "word " * 200_000 + "idiot"
    df = spark.createDataFrame([(1, "idiot", 1), (1, "idiot", 1), (2, None, 2), (3, "", 3), (None, "a", 4), (4, long, 5)], "doc_id long, text string, score int")
    got = sorted(((r["doc_id"] or 0, r["n_hits"], r["n_words"]) for r in toxicity.score_texts(df, lex).collect()))
    assert got == [(0, 0, 1), (1, 1, 1), (1, 1, 1), (2, 0, 0), (3, 0, 0), (4, 1, 200_001)]
    assert toxicity.score_texts(df.limit(0), lex).count() == 0


def test_labelled_samples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(700)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 3, seed=1)
    assert got.columns == ["text", "toxic"] and got.count() == 3
    assert labelled_sample(docs, labels, "toxic", 100, seed=1).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(7))


def test_toxicity_held_out_accuracy(spark):
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9
    assert toxicity.learn_lexicon(spark.createDataFrame([], "text string, toxic int")).score(0.0, 0) < 0.5


def test_quality_held_out_accuracy_and_shrinkage(spark, corpus):
    sf = "/root/testdata/sf0.01"
    judged = quality.op1_quality(spark, sf).select("doc_id", "keep").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    held = [(r["keep"], r["label"]) for r in judged if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([k == (y == 1) for k, y in held]) > 0.95
    s = spark.createDataFrame([("a", "p", 0.9)] * 50 + [("b", "p", 0.1)] * 50 + [("c", "q", 0.1)], "source string, lang string, evidence double")
    post = {r["host"]: r["host_posterior"] for r in quality.site_posteriors(s, host="source", path="lang").collect()}
    assert post["b"] < post["c"] < post["a"] and post["c"] > 0.1  # one document shrinks to the global mean
    df, rows = corpus
    model = quality.learn_classifier(spark.createDataFrame([], "text string, quality int"))
    assert quality.classify(df.withColumn("evidence", F.lit(1)), model).count() == len(rows)
    assert quality.classify(df.limit(0), model).count() == 0


def judged(rows, model):
    """Quality of (host, path, text) rows from the classifier's evidence and both posterior levels."""
    evidence = [float(model(quality.measure((t or "").encode())[None, :])[0]) for _, _, t in rows]

    def posterior(groups, prior):
        n = sum(g[0] for g in groups.values())
        v = sum(g[0] * prior[x] * (1 - prior[x]) for x, g in groups.items()) / n
        spread = sum(g[0] * (g[1] / g[0] - prior[x]) ** 2 for x, g in groups.items())
        between = (spread - len(groups) * v) / max(1e-9, n - sum(g[0] ** 2 for g in groups.values()) / n)
        m = min(quality.MOST_STRENGTH, max(quality.LEAST_STRENGTH, v / between - 1)) if len(groups) > 1 and between > 0 else quality.MOST_STRENGTH
        return {x: (g[1] + m * prior[x]) / (g[0] + m) for x, g in groups.items()}

    def grouped(keys):
        out = {}
        for x, e in zip(keys, evidence):
            n, good = out.get(x, (0, 0.0))
            out[x] = (n + 1, good + e)
        return out

    mean = (sum(evidence) + 1) / (len(rows) + 2)
    hosts, paths = grouped([r[0] for r in rows]), grouped([r[:2] for r in rows])
    by_host = posterior(hosts, {h: mean for h in hosts})
    by_path = posterior(paths, {x: by_host[x[0]] for x in paths})

    def logit(p):
        p = min(max(p, 1e-4), 1 - 1e-4)
        return np.log(p / (1 - p))

    return [1 / (1 + np.exp(-(logit(e) + logit(by_path[r[:2]]) - logit(mean)))) for r, e in zip(rows, evidence)]


def test_quality_against_brute_force(spark, corpus, monkeypatch):
    df, rows = corpus
    k = len(quality.MEASURES)
    model = quality.Classifier(np.zeros(k), np.ones(k), np.random.default_rng(4).normal(size=2 * k + 1))
    want = sorted(zip([r[0] for r in rows], judged([(r[3], r[2], r[1]) for r in rows], model)))
    for most in (100_000, 0):  # sites broadcast, and joined
        monkeypatch.setattr(quality, "BROADCAST_SITES", most)
        got = sorted((r["doc_id"], r["quality"]) for r in quality.judge(df, model, keys=["doc_id"]).collect())
        assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([q for _, q in got], [q for _, q in want])


def dropped_lines(rows):
    """{row number: line numbers} that repeat, by all pairs of different lines; rows are (id, text) in order."""
    places = [(k, i, line) for k, (_, t) in enumerate(rows) for i, line in enumerate((t or "").split("\n")) if line.strip()]
    texts = list(dict.fromkeys(line for _, _, line in places))
    sets = [lines.shingles(t) for t in texts]
    comp = components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if lines.jaccard(sets[i], sets[j]) >= 0.8])
    at = {t: comp[i] for i, t in enumerate(texts)}
    seen, out = set(), {}
    for k, i, line in places:
        if at[line] in seen:
            out.setdefault(k, []).append(i)
        seen.add(at[line])
    return out


def simhash_of(t):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    """Every stage of the pipeline, and ``run`` as a whole, against plain loops over the same rows."""
    import duckdb

    rng = random.Random(12)
    rows = list(dict.fromkeys(corpus[1]))
    rows += [(100 + i, "BUY NOW!!! $$$ %%% ### " * rng.randint(5, 30), "en", "spam", 9) for i in range(12)]
    long = rows[5][1].split()
    items = [(1, " ".join(long[50:90])), (2, words(rng, 30))]
    labels = [(r[0], int(r[0] < 100), 0) for r in rows if r[0] % 3]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, DOC)
    docs.coalesce(2).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, rows):
        return sorted(map(tuple, stages[name](spark, spark.createDataFrame(rows, DOC), sf).collect()), key=lambda r: (r[0], r[1] or "", r[5:]))

    text = {r[0]: r[1] for r in rows}
    train = [(quality.measure((text[d] or "").encode()), q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5]
    model = quality.Classifier.fit(np.array([x for x, _ in train]), np.array([float(q) for _, q in train]))
    rows = [r for r, q in zip(rows, judged([(r[3], r[2], r[1]) for r in rows], model)) if q >= 0.5]
    assert after("quality", list(dict.fromkeys(corpus[1])) + [r for r in docs.collect() if r[0] >= 100]) == sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert 10 < len(rows) < len(text)

    before, gone = rows, dropped_lines([(r[0], r[1]) for r in rows])
    rows = [(r[0], None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone.get(k, [])), *r[2:]) for k, r in enumerate(rows)]
    assert after("line_dedup", before) == rows and gone

    before, fps = rows, [simhash_of(r[1]) for r in rows]
    comp = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    rows = [r for i, r in enumerate(rows) if comp[i] == i]
    assert after("near_dedup", before) == rows and len(rows) < len(before)

    def holds(t, x):
        w, iw = decontaminate.words_of((t or "").encode()), decontaminate.words_of(x.encode())
        own = decontaminate.shingles_of(iw, 5)
        return len(own & decontaminate.shingles_of(w, 5)) >= 0.8 * len(own)

    before = rows
    rows = [r for r in rows if not any(holds(r[1], x) for _, x in items)]
    assert after("benchmark_free", before) == rows and len(rows) < len(before)

    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in rows])
    times = {d: taken // size for d, size, taken in duck.execute(f"SELECT doc_id, size, taken FROM ({mixing.OP7_SQL})").fetchall() if size}
    mixed = [(*r, k) for r in rows for k in range(1, times.get(r[0], 0) + 1)]
    assert after("mixing", rows) == mixed
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=lambda r: (r[0], r[5])) == mixed


def test_lines(spark, corpus):
    df, rows = corpus
    by_id = {r[0]: (r[1] or "") for r in rows}
    places = [(d, i, line) for d, t in sorted(by_id.items()) for i, line in enumerate(t.split("\n")) if line.strip()]
    texts = list(dict.fromkeys(line for _, _, line in places))
    sets = [lines.shingles(t) for t in texts]
    comp = components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if lines.jaccard(sets[i], sets[j]) >= 0.8])
    seen, want = set(), {}
    for d, i, line in places:
        c = comp[texts.index(line)]
        if c in seen:
            want.setdefault(d, []).append(i)
        seen.add(c)
    got = {r["doc_id"]: list(r["line_nos"]) for r in lines.repeated_lines(df).collect()}
    assert got == want
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    df.write.mode("overwrite").parquet(spark.conf.get("spark.checkpoint.dir") + "/lines_fixture/documents.parquet")
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], list(r["removed_lines"])) for r in lines.op6_line_dedup(spark, spark.conf.get("spark.checkpoint.dir") + "/lines_fixture").collect()}
    assert found == {d: (t.count("\n") + 1 if r is not None else 0, len(want.get(d, [])), want.get(d, [])) for d, t in by_id.items() for r in [dict((x[0], x[1]) for x in rows)[d]]}
    kept = lines.drop_repeated_lines(df.withColumn("line_nos", F.lit(1)))
    assert kept.count() == len(rows) and kept.columns == [*df.columns, "line_nos"]
    assert {r["text"] for r in kept.where("doc_id = 0").collect()} == {None}
    assert lines.repeated_lines(df.limit(0)).count() == 0


def test_lines_of_one_id_with_two_texts(spark):
    rows = [(1, "alpha beta gamma\nonly here, in the first text\nshared line of both"), (1, "shared line of both\nonly here, in the second text, also"), (2, "shared line of both"), (None, "shared line of both")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines_left = sorted(line for r in lines.drop_repeated_lines(df).where("doc_id IS NOT NULL").collect() for line in r["text"].split("\n") if line)
    assert lines_left == ["alpha beta gamma", "only here, in the first text", "only here, in the second text, also", "shared line of both"]
    assert lines.drop_repeated_lines(df).where("doc_id IS NULL").first()["text"] == "shared line of both"


@pytest.mark.parametrize("alphabet", ["abcdefgh", "".join(chr(0x4E00 + i) for i in range(400))])
def test_lines_in_large_groups(spark, alphabet, monkeypatch):
    """Hundreds of variants of one line under one key, in blocks of 50 rows, and chains of variants."""
    rng = random.Random(5)
    base = [rng.choice(alphabet) for _ in range(300)]
    texts = ["".join(base)]
    for _ in range(180):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(300)] = rng.choice(alphabet)
        texts.append("".join(own))
    step = list(base)
    for i in range(40):  # each like the one before it, the last unlike the first
        step[(i * 37) % 300] = rng.choice(alphabet)
        texts.append("".join(step))
    groups = lines.link_groups
    monkeypatch.setattr(lines, "link_groups", lambda *a, block_rows, **k: groups(*a, block_rows=50, **k))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [lines.shingles(t) for t in texts]
    comp = components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if lines.jaccard(sets[i], sets[j]) >= 0.8])
    got = {r["doc_id"] for r in lines.repeated_lines(df).collect()}
    assert got == {i for i in comp if comp[i] != i}


def test_line_bands_keep_their_recall():
    rng = random.Random(6)
    met = n = 0
    while n < 1500:
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(200))
        b = list(a)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(200)] = "z"
        b = "".join(b)
        if 0.8 <= lines.jaccard(lines.shingles(a), lines.shingles(b)) <= 0.84:
            n += 1
            keys = lines.band_keys([a, b])
            met += bool((keys[0] == keys[1]).any())
    assert met >= 0.985 * n


def test_mixing(spark, corpus):
    df, rows = corpus
    got = mixing.mix(df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:  # clamp and share again until none is above
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    target = fixed | share
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"]
    biggest = max(r["size"] for r in got)
    for s in order:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= biggest
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()))
    assert mixing.mix(df.select("doc_id", "source", F.lit(1).alias("size")).limit(0)).count() == 0


def test_tokens(spark, corpus):
    df, rows = corpus
    scores = tokens.unigram_scores(tokens.load_pieces(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"))

    def brute(word):
        best = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            n = len(word[d - 1].encode())
            options = [(best[d - 1][0] - 1e4 * n, best[d - 1][1] + n)] + [(best[j][0] + scores[word[j:d]], best[j][1] + 1) for j in range(d) if word[j:d] in scores]
            top = max(o[0] for o in options)
            best.append(min((o for o in options if o[0] >= top - 1e-9), key=lambda o: o[1]))
        return best[-1][1]

    got = sorted((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in tokens.token_counts(df, scores, trie_words=50).collect())
    assert got == sorted((r[0], len((r[1] or "").split()), sum(brute("▁" + w) for w in (r[1] or "").split())) for r in rows)


def test_tokens_of_very_long_words():
    scores = tokens.unigram_scores(tokens.load_pieces(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"))
    count = tokens.TrieCounter(scores)
    rng = random.Random(1)
    some = ["▁" + "".join(rng.choice("abcdeä猫 t") for _ in range(n)) for n in (1, 15, 16, 17, 63, 64, 300, 511)]
    assert [count._count_one(w) for w in some] == count(some).tolist()
    began = time.time()
    assert count(["▁" + "ab" * 50_000])[0] > 1000 and time.time() - began < 10


def test_decontamination(spark, corpus, duck):
    df, rows = corpus
    rng = random.Random(9)
    long = rows[5][1].split()
    items = [(1, " ".join(long[50:90])), (2, words(rng, 30)), (3, edited(rng, " ".join(long[100:160]))), (4, "one"), (5, None), (6, ""), (7, " ".join(long[7:10]).upper())]
    it = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t, *_ in rows:
        w = decontaminate.words_of((t or "").encode())
        for i, x in items:
            iw = decontaminate.words_of((x or "").encode())
            k = min(5, len(iw))
            own = decontaminate.shingles_of(iw, k)
            shared = len(own & decontaminate.shingles_of(w, k)) if k else 0
            if own and shared >= 0.8 * len(own) - 1e-9:
                want.append((d, i, shared, len(own)))
    assert sorted(map(tuple, decontaminate.contained_items(df, it).collect())) == sorted(want)
    assert sorted(map(tuple, decontaminate.contained_items(df, it, block_bytes=200).collect())) == sorted(want)  # in blocks
    kept = decontaminate.decontaminate(df, it)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {w[0] for w in want}
    assert decontaminate.contained_items(df.limit(0), it).count() == 0 and decontaminate.contained_items(df, it.limit(0)).count() == 0
    ours, theirs = normal(queries.queries()["op9_decontaminate"](spark, SF).toPandas()), normal(duck.execute(queries.oracle_sql()["op9_decontaminate"]).df())
    assert ours == theirs


def test_simhash(spark, corpus):
    df, rows = corpus

    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    texts_apart = [words(random.Random(i), 80) for i in (1, 2)]
    fps = [(r[0], fp(r[1])) for r in rows]
    comp = components({d for d, _ in fps}, [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 4])
    got = sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_components(df).collect())
    assert got == sorted((d, x, comp[d]) for d, x in fps)
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(df).collect()) == sorted({c for c in comp.values()})
    assert simhash.simhash_components(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, texts_apart[0], "a"), (1, texts_apart[1], "b"), (1, texts_apart[1], "c"), (2, texts_apart[0], "d"), (None, texts_apart[0], "e")], "doc_id long, text string, fp string")
    kept = simhash.keep_one_of_each(twice)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(0, texts_apart[0]), (1, texts_apart[0]), (1, texts_apart[1])])
    assert kept.columns == twice.columns


@pytest.mark.parametrize(("block_rows", "one_in"), [(4096, 64), (20, 64), (20, 1)])
def test_simhash_links_are_complete_for_close_fingerprints(spark, monkeypatch, block_rows, one_in):
    monkeypatch.setattr(common, "SAMPLE_ONE_IN", one_in)  # with 1 every hot key is split in its first exchange
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre}
    for x in list(rng.integers(0, 1 << 63, 200)):
        fps.add(int(x))
    for _ in range(300):  # a dense ball of near copies
        y = centre
        for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
            y ^= 1 << int(b)
        fps.add(y)
    fps = sorted(simhash._signed(x) for x in fps)
    got = connected_components(simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), block_rows=block_rows))
    found = {r["id"]: r["component_id"] for r in got.collect()}
    want = components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 4])
    assert {x: found.get(x, x) for x in fps} == want


def test_count_filter_rejects_pairs_and_no_near_one():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    near = a.copy()
    for i in range(len(a)):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            near[i] ^= np.uint64(1 << int(b))
    assert (simhash.shared_bytes(a ^ near) >= 4).all()
    # pairs of one list agree in its three bytes; of those that agree in no other by plan, chance alone adds a fourth
    other = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    mask = np.uint64(simhash.MASKS[0])
    met = (other & ~mask) | (a & mask)
    kept = (simhash.shared_bytes(a ^ met) >= 4).mean()
    assert len(simhash.MASKS) == 56 and 0.005 < kept < 0.04


@pytest.mark.parametrize("one_in", [64, 1])
def test_hot_keys_meet_in_blocks_whatever_the_sample_shows(spark, monkeypatch, one_in):
    monkeypatch.setattr(common, "SAMPLE_ONE_IN", one_in)
    rows = [(k, i) for k, n in ((1, 300), (2, 40), (3, 1), (4, 12)) for i in range(1000 * k, 1000 * k + n)]

    def pairs(groups):
        for whole, starts in groups:
            k, v = whole.column("k").to_numpy(), whole.column("v").to_numpy()
            blk, diag = whole.column("blk").to_numpy(), whole.column("diag").to_numpy()
            for i, j in common.pairs_of_groups(starts):
                met = diag[i] | (blk[i] != blk[j])
                i, j = i[met], j[met]
                assert (k[i] == k[j]).all()
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(v[i], v[j])), pa.array(np.maximum(v[i], v[j]))], ["a", "b"])

    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = sorted(map(tuple, common.map_groups(df, ["k"], "v", pairs, "a long, b long", block_rows=16).collect()))
    assert got == sorted((a, b) for k, a in rows for k2, b in rows if k == k2 and a < b)


def test_a_prefix_is_scored_once_for_all_words_and_batches(monkeypatch):
    r = random.Random(8)
    scores = {p: -r.random() - 1 for p in ["a", "b", "ab", "ba", "abb", "é", "▁", "▁a", "aa", "bab"]}
    words = ["".join(r.choice("abé日") for _ in range(r.choice([1, 2, 5, 20, 70, 200]))) for _ in range(300)]
    words += ["ab" * 8 + x for x in ("", "a", "b" * 60, "a" * 300)]  # one prefix across all classes of length
    scored = []
    score = tokens.TrieCounter._score
    monkeypatch.setattr(tokens.TrieCounter, "_score", lambda self, node, *a: (scored.extend(node.tolist()), score(self, node, *a))[1])
    trie = tokens.TrieCounter(scores)
    got = np.concatenate([trie(words[i : i + 37]) for i in range(0, len(words), 37)])
    assert got.tolist() == [trie._count_one(w) for w in words]
    assert len(scored) == len(set(scored)) == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    trie.forget()
    assert trie(words[:50]).tolist() == got[:50].tolist()


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF).persist()
        rows = docs.select("doc_id").collect()
        assert rows and {r["doc_id"] for r in rows} <= before, name
        assert docs.columns == (columns if i < 4 else [*columns, "repetition"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "benchmark_free", "mixing"]


def test_stages_take_empty_documents(spark):
    empty = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_a_bitmap_stays_packed_on_the_driver(spark):
    made = common.bitmap(spark.range(0, 3_000_000, 1000).select((F.col("id") * 7919 - 5).alias("v")))
    assert len(pickle.dumps(made)) < 1 << 20  # 16 MB unpacked
    bits = pickle.loads(pickle.dumps(made))
    v = np.arange(0, 3_000_000, 1000) * 7919 - 5
    assert common.set_bits(v, bits).all() and common.set_bits(v + 1, bits).sum() < 30
    assert not pickle.loads(pickle.dumps(common.bitmap(spark.range(0).select(F.col("id").alias("v"))))).any()
