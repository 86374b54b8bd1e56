"""Operators 2, 5, 6, 7 and 8 against plain versions."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, html_text, language, mixing, quality

from .helpers import words


def test_fingerprints(spark, unique, unique_rows):
    order = sorted(unique_rows, reverse=True)
    following = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1])}
    text = {r[0]: r[1] or "" for r in unique_rows}
    got = fingerprints.compare_edited(unique).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    seen, errors = {}, []

    def sets(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in got:
        t, u = text[r.doc_id], following[r.doc_id]
        e = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors.append(abs(r.near_edited - jaccard(sets(t), sets(e))))
        assert abs(r.near_next - jaccard(sets(t), sets(u))) < 0.2
    assert np.mean(errors) < 0.05


def test_fingerprint_odd_tables(spark, docs, rows):
    got = fingerprints.compare_edited(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert fingerprints.compare_edited(docs.limit(0)).count() == 0
    one = fingerprints.compare_edited(docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()} == {r.doc_id: r.fingerprint for r in got}


def test_fingerprint_likeness_is_unbiased():
    r = random.Random(4)
    near, true = [], []
    for _ in range(60):
        w = [str(r.random()) for _ in range(300)]
        k = r.randrange(300)
        a, b = " ".join(w), " ".join(w[:k] + [str(r.random()) for _ in range(300 - k)])
        t, some = fingerprints.bins_of(pa.array([a, b]))
        low, _ = fingerprints.packed(t, some)
        near.append(fingerprints.likeness(low[:1], some[:1], low[1:], some[1:])[0])
        s = [{tuple(x[i : i + 5]) for i in range(296)} for x in (a.split(), b.split())]
        true.append(len(s[0] & s[1]) / len(s[0] | s[1]))
    assert abs(np.mean(np.array(near) - true)) < 0.015 and np.abs(np.array(near) - true).max() < 0.12


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice"><p>We use cookies, and more of them than you would think. Accept all of them now.</p></div>
<main><article><h1>Head&amp;line</h1><p>First  para\ngraph with <b>bold</b> and <a href=x>link</a>, long enough to count.</p><div class="ad">Buy this now, it is cheap.</div>
<p>Second paragraph&nbsp;is unclosed &lt;here&gt;, with commas, too.<p>Third &eacute;l&#232;ve.<ul><li>Item one, of a list.</li><li>Item two.</li></ul><form><input><button>Send</button></form></article>
<section id="comments"><p>A reader says: what a fine article, I could read it all day long, really.</p></section></main>
<aside><p>Related stories, which are many, and long, and not of interest here.</p></aside><footer>&copy; all rights</footer></body></html>"""


def test_html_article():
    assert html_text.content(PAGE) == [
        "Head&line", "First para graph with bold and link, long enough to count.", "Second paragraph is unclosed <here>, with commas, too.", "Third élève.", "Item one, of a list.", "Item two.",
    ]


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "</p></div>", "<script>x", "<nav><a>x</a></nav>", "<!-- open", "<p>a<p>b</div></p>", "<" * 500, "<div>" * 500 + "x"])
def test_html_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_without_article_elements():
    page = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div><div><h2>Title</h2><p>Long text of the page, with points. And more of it, and more, to the end.</p><p>Yes.</p></div></div></body>"
    assert html_text.content(page) == ["Title", "Long text of the page, with points. And more of it, and more, to the end.", "Yes."]


LINES = [f"Line {i} of the text, which is long enough to be content, with points. And commas, of course." for i in range(10)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LINES)
ITEMS = "".join(f"<li>{x}</li>" for x in LINES)


@pytest.mark.parametrize(
    "page,before,after",
    [
        (f"<article><header><h1>Title</h1></header><div class=body>{PARAGRAPHS}</div></article>", ["Title"], []),
        (f"<article><h1>Title</h1><p>Intro.</p><ul>{ITEMS}</ul></article>", ["Title", "Intro."], []),
        (f"<article><section>{PARAGRAPHS}</section><section><p>A short end.</p></section></article>", [], ["A short end."]),
        (f"<body><div><div>{PARAGRAPHS}</div><div><p>{LINES[0]}</p></div></div></body>", [], LINES[:1]),
        (f"<body><div id=menu><a href=/>x</a></div><div><div><h1>Title</h1><p>By me.</p></div><div class=text>{PARAGRAPHS}</div></div></body>", ["Title", "By me."], []),
        (f"<body><main><article>{PARAGRAPHS}</article></main><div><p>Elsewhere.</p></div></body>", [], []),
    ],
)
def test_html_whole_article(page, before, after):
    assert html_text.content(page) == before + LINES + after


@pytest.mark.parametrize("around", ["<article>{}</article>", "<body><main><div>{}</div></main></body>", "<body><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul><div>{}</div></body>"])
def test_html_links_in_the_article(around):
    """A title that is a permalink, a short paragraph and references that are links; menus beside it stay out."""
    inner = f"<h1><a href=/1>Title</a></h1>{PARAGRAPHS}<p>See <a href=/2>this longer one</a>.</p><ul><li><a href=/3>First reference</a></li><li><a href=/4>Second reference</a></li></ul>"
    assert html_text.content(around.format(inner)) == ["Title", *LINES, "See this longer one.", "First reference", "Second reference"]


def test_html_links_around_the_article():
    page = f"<body><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul><h2><a href=/1>Title</a></h2>{PARAGRAPHS}<div><p><a href=/c>Next</a></p></div></body>"
    assert html_text.content(page) == ["Title", *LINES]
    assert html_text.content("<ul><li><a href=/>Home</a></li></ul><article><h1><a href=/1>Title</a></h1><p><a href=/2>All of it</a></p></article>") == ["Title", "All of it"]
    assert html_text.content("<ul><li><a href=/>Home</a></li></ul>") == []


def test_html_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = "\n\n".join(html_text.content(PAGE))
    assert text and Counter((r.page_id, r.url, r.text) for r in got) == {(1, "u", text): 2, (None, None, ""): 1, (2, "v", ""): 1}
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>x" * 160_000, "<div>" * 100_000 + "<p>x.</p>" * 30_000, "<p title='it>Hello." * 50_000 + "'", "<a \"'>x" * 150_000, "<script " * 130_000, "<div>" * 50_000 + "</span></p>" * 60_000, "<!--" * 250_000],
)
def test_html_of_a_megabyte_in_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def test_html_odd_quotes_and_attributes():
    assert html_text.content("<p title='it>Hello, this is a page.</p><p>More text.</p>") == ["Hello, this is a page.", "More text."]
    page = "<article><p title='hidden gems'>First, one.</p><p data-id=ad>Second one.</p><p title='a > b'>Third one.</p><p hidden>Not this.</p></article>"
    assert html_text.content(page) == ["First, one.", "Second one.", "Third one."]
    assert html_text.content("<article><p>Text, and more.</p><p>1 < 2.</p></article><p title=") == ["Text, and more.", "1 < 2."]


def measures(t):
    t = t or ""
    w = words(t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in "".join(w)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_measures(spark, docs, rows):
    got = quality.assess(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == sorted(key((r[0], *measures(r[1]))) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.assess(docs.limit(0)).count() == 0


def test_quality_fit_matches_plain_expectation_maximisation(spark):
    """Two thousand votes drawn from known accuracies: the fit finds them, and the verdicts are the plain posterior's."""
    r = random.Random(5)
    rules = tuple(quality.Rule(f"r{j}", f"v{j} = -1", f"v{j} = 1") for j in range(4))
    truth, rows = [], []
    for _ in range(2000):
        good = r.random() < 0.8
        truth.append(good)
        rows.append(tuple(0 if r.random() < 0.2 else (1 if (r.random() < 0.9) == good else -1) for _ in rules))
    marked = spark.createDataFrame(rows, ", ".join(f"v{j} int" for j in range(4))).select("*", *[x.vote() for x in rules])
    m = quality.fit(marked, rules)
    assert abs(m.prior - 0.8) < 0.05 and all(abs(a - 0.9) < 0.06 and abs(b - 0.9) < 0.08 for a, b in m.accuracies().values())
    got = marked.select(*[f"vote_r{j}" for j in range(4)], m.posterior().alias("p")).collect()
    for x in got:
        good, bad = m.prior, 1 - m.prior
        for v, vote in zip(m.votes, x[:4]):
            good, bad = good * v[vote][0], bad * v[vote][1]
        assert x.p == pytest.approx(good / (good + bad))
    assert [x[:4] for x in got] == rows and sum((x.p >= 0.5) == t for x, t in zip(got, truth)) > 1850


def test_quality_filter_keeps_columns(spark, docs):
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    want = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.keep_good(docs.limit(0)).count() == 0


def talk(spark, n=400):
    r = random.Random(3)
    syllables = {"en": "th er on an re he in ed nd ha".split(), "fr": "le ou que é ai eau ment tre la eux".split(), "de": "sch ein ung ich der ge ver zu au ü".split()}
    rows = []
    for i in range(n):
        lang = r.choice(list(syllables))
        t = " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 80)))
        rows.append((i, t, lang))
    rows += [(n, None, "en"), (n + 1, "12 34 !?", "fr"), (n + 2, "", None), (None, "the thing", "en"), (5, rows[5][1], rows[5][2])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy(spark):
    rows, df = talk(spark)
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (400, 401, 402)} == {"und"}
    # Predictions look at texts alone.
    blind = {r.doc_id: r.lang_pred for r in language.predict(df.withColumn("lang", F.lit("xx")), language.fit(df.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))).collect()}
    assert all(blind[r.doc_id] == r.lang_pred for r in got if r.doc_id is not None)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(df).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_language_of_one_repeated_id(spark):
    """All rows of a language share an id, and so a hash, whatever side of the first cut that falls on."""
    rows = [(i, t, g) for i in (1, 7) for g, t in (("en", "the other thing and"), ("fr", "que le temps é"))] * 80
    for i in range(8):
        df = spark.createDataFrame([(i, t, g) for _, t, g in rows], "doc_id long, text string, lang string")
        assert set(language.fit(df, sample=40).langs) == {"en", "fr"}


def test_nystroem_equals_full_kernel_ridge():
    """With every row a landmark the solution is kernel ridge regression itself."""
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("abcd" if i % 2 else "wxyz"), 40)) for i in range(12)]
    x = language.presence(texts)
    m = language.solve(x, ["a" if i % 2 else "w" for i in range(12)], 12, 1e-2)
    k = language.kernel(x, x).astype(float)
    y = np.array([1.0 if i % 2 else -1.0 for i in range(12)])
    full = k @ np.linalg.solve(k + 12 / 2 * 1e-2 * np.eye(12), y)
    assert np.sign(m.scores(x)[:, 0]).tolist() == y.tolist() and np.allclose(m.scores(x)[:, 0], full, atol=0.05)
    s = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts[:2]]
    assert abs(k[0, 1] - len(s[0] & s[1]) / np.sqrt(len(s[0]) * len(s[1]))) < 0.02


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([0, 10], [3, 1], 15) == [0, 15]
    t = mixing.targets([5, 50, 500, 5000], [3, 1, 2, 3], 1.5 * 5555)
    assert sum(t) == pytest.approx(1.5 * 5555) and all(x <= 2 * n for x, n in zip(t, (5, 50, 500, 5000)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(n):
    p = mixing.permuted(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n)) and (n < 64 or p.tolist() != list(range(n)))


def test_shards_share_out_the_quotas():
    q = np.array([1000, 0, 37, 4096])
    s = mixing.Shards(q, 128, 3)
    before = np.zeros(4, int)
    for k in range(s.n):
        counts, start = s[k]
        assert (start == before).all() and counts.sum() == min(128, q.sum() - 128 * k)
        before = before + counts
    assert (before == q).all()
    again = mixing.Shards(q, 128, 3)
    assert all((again[k][0] == mixing.Shards(q, 128, 3)[k][0]).all() for k in (7, 3, 30))


def test_shards_in_regions():
    """Quotas beyond one region are spread evenly, and drawn inside the regions."""
    q = np.array([100_000, 0, 37, 409_600])
    s = mixing.Shards(q, 128, 3, region=4096)
    before = np.zeros(4, int)
    for k in range(s.n):
        counts, start = s[k]
        assert (start == before).all() and counts.sum() == min(128, q.sum() - 128 * k) and (counts >= 0).all()
        before = before + counts
    assert (before == q).all() and len(s.regions) == -(-s.n // 32)
    assert mixing.even([3, 10**18, 0], 10**17)[1] > 99 * 10**15
    big = mixing.Shards(np.array([3 * 10**11, 10**11]), 4096, 1)
    assert big[10**7][0].sum() == 4096


def test_mix_takes_what_the_slots_read(spark, unique, unique_rows):
    """Words taken of every document, against the slots drawn one by one."""
    block, shard, seed = 8, 64, 17
    sources = mixing.plan([(n, sum(len(words(r[1])) for r in unique_rows if r[3] == n)) for n in {r[3] for r in unique_rows}], block)
    drawn = [Counter() for _ in sources]
    shards = mixing.Shards(np.array([x.slots for x in sources]), shard, seed)
    for place in range(shards.n):
        counts, before = shards[place]
        for k, x in enumerate(sources):
            for slot in range(before[k], before[k] + counts[k]):
                epoch, i = divmod(slot, x.blocks)
                drawn[k][int(mixing.permuted(np.array([i]), x.blocks, (seed * 1_000_003 + k) * 64 + epoch)[0])] += 1
    want = {}
    for k, x in enumerate(sources):
        at = 0
        for r in sorted((r for r in unique_rows if r[3] == x.name), key=lambda r: r[0]):
            n = len(words(r[1]))
            want[r[0]] = sum(drawn[k][w // block] for w in range(at, at + n))
            at += n
    assert {r.doc_id: r.taken for r in mixing.mix_sources(unique, block, shard, seed=seed).collect()} == want


def test_mix(spark, unique, unique_rows):
    got = mixing.mix_sources(unique, block=8).collect()
    size = {r[0]: len(words(r[1])) for r in unique_rows}
    by = defaultdict(lambda: [0, 0, 0])
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
        assert r.source_size == sum(size[x[0]] for x in unique_rows if x[3] == r.source)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    assert [by[s][2] for s in names] == pytest.approx(mixing.targets([by[s][0] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(size.values())))
    assert all(abs(taken - target) <= 0.03 * target + 16 for _, taken, target in by.values())
    assert sorted(got) == sorted(mixing.mix_sources(unique.repartition(2), block=8).collect())


def test_mix_odd_tables(spark, docs, rows):
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    got = mixing.mix_sources(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.taken for r in mixing.mix_sources(docs.where("text IS NULL")).collect()} == {0}
    out = mixing.mixed(docs)
    assert out.schema == docs.schema and all(words(r.text) for r in out.collect() if r.doc_id is not None)
