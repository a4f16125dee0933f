"""The corpus operators against brute force, on planted and awkward rows."""

import collections
import hashlib
import math
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, html, lines, pii, quality, simhash, substrings, tokencounts, urls
from tessera.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 997}" for k in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree at night"
TEXTS = [
    None, "", " \n\t ", "one", BASE, BASE, BASE.replace("owls", "cats"), BASE + "\n" + BASE, "x " * 200, LONG, LONG + " tail", "Ünïcödé 日本語 🙂 words with\x0bodd\x0cspace", BASE.upper(),
    "mail a.b+c@d-e.co.uk and b@c.d_e@f.gh then 1.2.3.4 or 999.1.1.1 card 4556-7375 8689 9855 phone +1 (212) 555-0147 end",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _k string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", None if k == 3 else f"h{k % 3}", len(t or ""), "extra") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, BASE, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].fillna("~").itertuples(index=False, name=None)))
    assert key(got) == key(want)


# --- 1 -------------------------------------------------------------------------


def test_urls(spark):
    given = ["http://A.Example.NET/en/x?q#f", "https://x.net", "https://x.net/", "ftp://a.example.com/de/", "http://my-example.com/de/", None, "no scheme", "://", "http://q.org/fr/1#a://b", "https://b.org/x"]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(given)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][:3] == ("x.net", "", None) and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2] is None
    assert got[5] == ("", "", None, "allow") == got[6] == got[7] and got[8][2] == "org/fr/"
    assert urls.judge(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.xxhash64("id") % 7 == 0).alias("listed"))
    cascade = urls.Cascade.build(universe)
    assert len(cascade.levels) > 2
    assert universe.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    assert urls.Cascade.build(universe.where("NOT listed")).levels == []


def test_large_list_is_joined(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "https://b.com/")], "page_id bigint, url string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, max_bytes=0).collect()} == {1: "block", 2: "allow"}


# --- 2 ----------------------------------------------------------------------------


def test_decontamination(spark):
    item = "A train leaves Paris at 9 with 120 people and Anna counts 120 bags before it stops in Rome after 5 hours"
    other = item.replace("120", "77").replace("Anna", "Olaf").replace(" 5 ", " 8 ")
    broken = item.replace("120 bags", "33 bags")
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item)], "item_id bigint, text string")
    rows = [(1, "before it. " + item + " and after"), (2, other), (3, broken), (4, "a train leaves"), (5, None), (6, ""), (7, item.upper()), (8, " ".join(item.split()[:10])), (9, item.replace("Paris", "rain").replace("Anna", "snow").replace("Rome", "fog").upper()), (1, "before it. " + item + " and after")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert {(1, 1), (2, 1)} <= found and not {d for d, _ in found} & {3, 4, 5, 6, 8}
    assert decontaminate.contaminated(spark.createDataFrame([], "doc_id bigint, text string"), bench).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench.limit(0)).count() == 0


def test_decontamination_in_other_case(spark):
    item = "A train leaves Paris at 9 with 120 people and Anna counts 120 bags before it stops in Rome after 5 hours"
    german = "Die Köchin kauft auf dem Markt in der Straße am Fluss 3 Körbe Äpfel und bringt den Kindern der Schule 2 Kuchen"
    bench = spark.createDataFrame([(1, item), (2, german)], "item_id bigint, text string")
    rows = [(10 * i + k, made) for i, x in ((1, item), (2, german)) for k, made in enumerate((x, x.upper(), x.lower(), x.title()))]
    rows.append((30, item.replace("Paris", "rain").replace("Anna", "snow").replace("Rome", "fog").lower()))
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10 * i + k, i) for i in (1, 2) for k in range(4)}
    assert all(r.n_hit == r.n_windows for r in got)


def slow_template(text):
    """(kind, template, plain form, bare word) of each word, by rules written anew."""
    out, begins = [], True
    for line in (text or "").split("\n"):
        for raw in line.split():
            core = raw.strip(decontaminate.EDGES)
            low = core.casefold()
            if core:
                if re.fullmatch(r"[+-]?[$€£]?[0-9][0-9.,:/]*(%|[a-zA-Z]{1,3})?", core) or low in decontaminate.NUMBERS:
                    t = p = "<num>"
                elif low in decontaminate.UNITS:
                    t = p = "<unit>"
                else:
                    t = p = low
                    if core[0].isupper() and core != core.upper() and not begins:
                        t = "<name>"
                out.append((t, p, low))
            begins = raw.endswith((".", "!", "?", ":", ";", '"', "”", "»"))
        begins = True
    return out


def slow_contaminated(docs, items, width=5, similarity=0.8):
    def windows(words):
        if len(words) < width:
            return []
        return [(i, tuple(t for t, _, _ in words[i : i + width]), tuple(p for _, p, _ in words[i : i + width])) for i in range(len(words) - width + 1)]

    def slots(words, i, k):
        return tuple(w[2] for w in words[i : i + width] if w[k] in ("<num>", "<unit>", "<name>"))

    found = set()
    docs = [(d, slow_template(t)) for d, t in docs]
    for item, text in items:
        words = slow_template(text)
        mine = windows(words)
        if not words:
            continue
        if not mine:
            bare = [w[2] for w in words]
            found |= {(d, item) for d, ws in docs if any([w[2] for w in ws[i : i + len(bare)]] == bare for i in range(len(ws) - len(bare) + 1))}
            continue
        need = math.ceil(similarity * len({t for _, t, _ in mine}) - 1e-9)
        by_form = collections.defaultdict(set)  # both forms of a window, as the item has them
        for i, t, p in mine:
            for k, form in {0: t, 1: p}.items():
                by_form[form].add((i, t, slots(words, i, k)))
        for d, ws in docs:
            hit, same, shifts = set(), set(), collections.Counter()
            met = set()
            for j, t, p in windows(ws):
                for k, form in ((0, t), (1, p)) if t != p else ((0, t),):
                    for i, window, its in by_form.get(form, ()):
                        theirs = slots(ws, j, k)
                        hit.add(window)
                        if its == theirs:
                            same.add(window)
                        if its:
                            met.add((j - i, form, i, j, its, theirs))
            if len(hit) < need:
                continue
            for m in met:
                shifts[m[0]] += 1
            agree = True
            if shifts:
                best = max(shifts, key=lambda x: (shifts[x], -x))
                seen = collections.defaultdict(set)
                for m in met:
                    if m[0] == best:
                        for a, b in zip(m[4], m[5]):
                            seen[a].add(b)
                agree = all(len(x) == 1 for x in seen.values())
            if agree or len(same) >= need:
                found.add((d, item))
    return found


def test_decontamination_by_brute_force(spark, corpus):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(corpus, bench).collect()}
    assert got and got == slow_contaminated([(r.doc_id, r.text) for r in corpus.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_decontamination_of_random_items(spark):
    import random

    r = random.Random(11)
    vocabulary = ["the", "train", "leaves", "Paris", "Rome", "Anna", "with", "and", "120", "33", "five", "km", "kg", "bags.", "stops", "(then)", "-", "Olaf,"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice((1, 2, 3, 4, 5, 6, 9, 14)))) for k in range(40)] + [(90, ""), (91, None), (92, "... -")]
    docs = []
    for k in range(300):
        t = r.choice(items)[1] or ""
        swaps = r.sample([("120", "77"), ("33", "34"), ("Anna", "Olga"), ("Paris", "Bonn"), ("km", "miles"), ("five", "6")], r.randint(0, 3))
        for a, b in swaps:
            t = t.replace(a, b, r.choice((1, -1)))
        docs.append((k, " ".join((text(r.randint(0, 5)), r.choice((t, t, t.upper(), t.lower())), text(r.randint(0, 5))))))
    docs += [(400, "33 " * 300), (401, None), (402, "")]
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = slow_contaminated(docs, items)
    assert got == want and len(want) > 100


def test_short_items_and_changed_values(spark):
    long = "A train with 120 seats leaves the town and 120 people wait " + " ".join(f"word{k}" for k in range(36))
    bench = spark.createDataFrame([(1, "What is two plus"), (2, long)], "item_id bigint, text string")
    rows = [(1, "Say: what is TWO plus two?"), (2, "what is plus two"), (3, long.replace("120 people", "121 people")), (4, long.replace("120", "121"))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 2)}


# --- 3 -------------------------------------------------------------------------------


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>First  <b>bold</b>\n text&nbsp;here.<p>Second<br>line
    <script>var x = "<p>no</p>";</script><form><input>Sign</form></p><div class="comments"><p>Reader says</p></div></article><aside>Side</aside><footer>&copy; me</footer>"""
    assert html.main_text(page) == "Head & more\nFirst bold text here.\nSecond line"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("just text") == "just text"
    assert html.main_text("<article>" + "<p>a</p>" * 3000) == "\n".join("a" * 3000)


PROSE = "This sentence is plain prose, as articles have it, and goes on for a while without any link in it. "


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>Intro text <noscript><p>enable js</p></noscript> and more.</p></article>", "Intro text and more."),
        ("<article><p>a<button><div>x</div></button>b</p></article>", "ab"),
        ("<div class='content has-sidebar'><h1>T</h1><p>Words of the page.</p></div>", "T\nWords of the page."),
        ("<div class='layout side-by-side'><p>Words of the page.</p></div>", "Words of the page."),
        ("<div id='page-with-nav'><article><p>Words.</p></article></div>", "Words."),
        ("<div class='sidebar'><main><p>Words.</p></main></div><div class='sidebar'>Side</div>", "Words."),
        ("<div class='modal'><p>All there is.</p></div>", "All there is."),
        ("<form><main><p>Words.</p><form>Ask</form></main></form>", "Words."),
        ("<article><p>Words <span class='advert'>BUY <span>NOW</span></span>go on.</p></article>", "Words go on."),
        (f"<div><p>{PROSE * 5}</p></div><div><p>Short.</p></div><div><p>{PROSE * 5}</p></div>", "\n".join([(PROSE * 5).strip(), "Short.", (PROSE * 5).strip()])),
        (f"<article><p>{PROSE * 3}</p><div><a href=x>One link</a><br><a href=y>and another</a></div><p>End.</p></article>", (PROSE * 3).strip() + "\nEnd."),
        (f"<h1>Title</h1><div><p>{PROSE * 3}</p><p>End.</p></div><div><a href=x>One</a> <a href=y>Two</a></div>", "Title\n" + (PROSE * 3).strip() + "\nEnd."),
        (f"<article class=teaser><a href=x>More here</a></article><div><p>{PROSE * 9}</p><p>End.</p></div>", (PROSE * 9).strip() + "\nEnd."),
        (f"<article><p>{PROSE}</p></article><div class=comments><article><p>{PROSE * 3}</p></article></div>", PROSE.strip()),
        ("<div>" * 50_000 + "deep", "deep"),
    ],
)
def test_html_pages(page, want):
    assert html.main_text(page) == want


def test_html_on_generated_pages():
    """Pages of a known article among known clutter; half of them have no article element."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuw") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    links = lambda n: " ".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(n))
    clutter = [
        lambda: f"<nav><ul>{links(6)}</ul></nav>", lambda: f"<div class='top-menu'><ul>{links(5)}</ul></div>", lambda: f"<div><ul>{links(8)}</ul></div>", lambda: f"<aside><p>{prose(40)}</p></aside>", lambda: f"<div class='cookie-notice'><p>{prose(30)}</p></div>",
        lambda: f"<div class='sidebar'><p>{prose(30)}</p></div>", lambda: f"<script>var x = '<p>{prose(9)}</p>';</script>", lambda: f"<form>{prose(8)}<input><button>{word()}</button></form>", lambda: f"<section id='comments'><p>{prose(50)}</p></section>", lambda: f"<div class='ad'>{prose(12)}</div>", lambda: f"<footer>{prose(10)} <a href='#'>{word()}</a></footer>",
    ]
    for _ in range(400):
        blocks = [prose(r.randint(3, 8))] + [prose(r.randint(30, 90)) if r.random() < 0.8 else prose(r.randint(2, 6)) for _ in range(r.randint(3, 9))]
        made = [f"<h1>{blocks[0]}</h1>"]
        for b in blocks[1:]:
            first, _, rest = b.partition(" ")
            made.append(r.choice((f"<p>{b}</p>", f"<p>{b}", f"<p><b>{first}</b> {rest}</p>", f"<p>{first} <span class='advert'>{word()}</span>{rest}</p>", f"<p>{b}<noscript><p>{word()}</p></noscript></p>")))
        tag = r.choice(("article", "main", "div class='story'", "div"))
        body = f"<{tag}>{''.join(made)}</{tag.split()[0]}>"
        parts = [r.choice(clutter)() for _ in range(r.randint(0, 4))] + [body] + [r.choice(clutter)() for _ in range(r.randint(0, 4))]
        page = f"<html><head><title>{prose(3)}</title></head><body>{''.join(parts)}</body></html>"
        assert html.main_text(page) == "\n".join(blocks), page


def test_html_frames(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>x"), (2, None, "<p>x")], "page_id bigint, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect()]
    assert sorted(got) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert html.extract(pages.limit(0)).count() == 0


# --- 4 ----------------------------------------------------------------------------------


def slow_features(text):
    text = text or ""
    ws = WORD.findall(text)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = collections.Counter(wins)
    cov = set()
    for i, w in enumerate(wins):
        if n[w] > 1:
            cov.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(cov)


def test_quality(docs, empty):
    for r in quality.judge(docs).collect():
        text = BASE if r.doc_id is None else TEXTS[r.doc_id]
        want = slow_features(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.judge(docs).count() == docs.count()
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs).where("kept").count()


def test_failing_host_takes_its_documents(spark):
    rows = [(k, BASE + f" {k}" if k % 10 == 0 else "short", "bad") for k in range(100)] + [(100 + k, BASE + f" {k}", f"good{k % 5}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert kept == set(range(100, 150)) == {r.doc_id for r in quality.keep(df).collect()}


# --- 5 ------------------------------------------------------------------------------------


def slow_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    return [[m.span() for m in E.finditer(t)], [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))], [m.span() for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))], [m.span() for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]]


def test_base_spans_by_brute_force():
    import random

    r = random.Random(5)
    for _ in range(20_000):
        t = "".join(r.choice("ab1234567890..@@+-- ()_%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == slow_spans(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000 + " @", "1" * 300_000, "+" + "1" * 300_000, "1." * 100_000, "a@" * 100_000, "@" * 200_000, "a.b@" + "c." * 100_000):
        pii.base_spans(t)


def test_field_makes_labels_agree(docs, empty):
    text = "Pay 4556737586899855 now. +1 (269) 555-3296 4556737586899855 again"
    base = [pii.base_spans(text)]
    assert [s for s in base[0][2]] == [(4, 20)]
    assert (2, text.rindex("4556"), text.rindex("4556") + 16) in pii.added_spans([text], base)[0]
    plain = "In 2024 there were 120 of 3,400 items, 12:30 and 1.5 each 100200300"
    assert pii.added_spans([plain], [pii.base_spans(plain)]) == [[]]
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    r = got[13]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, slow_spans(TEXTS[13])))
    flat = ",".join(f"{k}:{s}:{e}" for k, spans in zip(pii.KINDS, slow_spans(TEXTS[13])) for s, e in spans)
    assert r.base_sha256 == hashlib.sha256(flat.encode()).hexdigest() and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(empty).count() == 0


def test_marginals_by_enumeration():
    """On a chain and a star message passing is exact; with a loop it agrees on the label."""
    import itertools

    r = np.random.default_rng(3)

    def exact(scores, edges, strength):
        out, k = np.zeros_like(scores), scores.shape[1]
        for labels in itertools.product(range(k), repeat=len(scores)):
            v = np.exp(sum(scores[i, x] for i, x in enumerate(labels)) + sum(s for (a, b), s in zip(edges, strength) if labels[a] == labels[b]))
            for i, x in enumerate(labels):
                out[i, x] += v
        return out / out.sum(1, keepdims=True)

    for edges in ([(0, 1), (1, 2), (2, 3)], [(0, 1), (0, 2), (0, 3)], []):
        for _ in range(20):
            scores, strength = r.normal(size=(4, 3)) * 2, np.abs(r.normal(size=len(edges))) * 3
            got = pii.messages(scores, np.array(edges, np.int64).reshape(-1, 2), strength, rounds=80)
            assert np.allclose(got, exact(scores, edges, strength), atol=1e-6)
    for _ in range(40):
        scores, strength = r.normal(size=(4, 3)) * 2, np.full(4, 1.0)
        edges = [(0, 1), (1, 2), (2, 3), (0, 3)]
        got, want = pii.messages(scores, np.array(edges), strength, rounds=80), exact(scores, edges, strength)
        clear = np.sort(want, 1)[:, -1] > 0.8
        assert (got.argmax(1) == want.argmax(1))[clear].all()


def test_potentials_are_fitted_and_mentions_found():
    weights, (chain, skip) = pii.fitted()
    assert skip > 2 and skip > chain
    found = planted = wrong = 0
    for text, spans in pii.generated(300, seed=99):
        base = pii.base_spans(text)
        known = [s for kind in base for s in kind]
        got = pii.added_spans([text], [base])[0]
        for kind, s, e in spans:
            if not any(a < e and b > s for a, b in known):
                planted += 1
                found += any(k == kind and a < e and b > s for k, a, b in got)
        wrong += sum(not any(s < b and e > a for _, s, e in spans) for _, a, b in got)
    assert planted > 100 and found >= 0.9 * planted and wrong <= 0.02 * planted
    text = "+1 555-123-4567 then later 5551234567 again, but 5559876543 is no repeat"
    assert pii.added_spans([text], [pii.base_spans(text)]) == [[(3, 27, 37)]]


def test_field_judges_whole_tokens(monkeypatch):
    seen, shape = [], pii.shape
    pii.fitted()
    monkeypatch.setattr(pii, "shape", lambda token: seen.append(token) or shape(token))
    token = "a1" + "/b" * 200 + "@c.de-4556"
    pii.added_spans([token], [pii.base_spans("")])
    assert seen == [token]


# --- 6 -------------------------------------------------------------------------------------


def slow_lines(rows, t=0.8):
    all_lines = [(d, k, frozenset(WORD.findall(x))) for d, text in rows for k, x in enumerate((text or "").split("\n")) if WORD.search(x)]
    all_lines.sort(key=lambda x: x[:2])
    out = set()
    for i, (d, k, s) in enumerate(all_lines):
        if any((d2, k2) != (d, k) and len(s & s2) >= t * len(s | s2) - 1e-9 for d2, k2, s2 in all_lines[:i]):
            out.add((d, k))
    return out


def test_line_dedup(spark, docs, empty):
    import random

    r = random.Random(2)
    rows = []
    for k in range(120):
        made = []
        for _ in range(r.randint(0, 4)):
            ws = [f"v{r.randint(0, 40)}" for _ in range(r.choice((1, 3, 8, 12)))]
            made.append(" ".join(ws))
        rows.append((k, "\n".join(made)))
    base = [f"t{k}" for k in range(20)]
    for k in range(120, 200):  # a group of near copies
        ws = base[:]
        for _ in range(r.randint(0, 4)):
            ws[r.randrange(20)] = f"u{r.randint(0, 99)}"
        rows.append((k, " ".join(ws)))
    df = spark.createDataFrame([*rows, (500, None), (None, "a\nb")], "doc_id bigint, text string").withColumn("_gone", F.lit(1))
    got = lines.out_lines(df).collect()
    assert {(x.doc, x.line) for x in got} == slow_lines(rows)
    sets = {(d, k): frozenset(WORD.findall(x)) for d, t in rows for k, x in enumerate(t.split("\n"))}
    for x in got:
        a, b = sets[x.src_doc, x.src_line], sets[x.doc, x.line]
        assert (x.src_doc, x.src_line) < (x.doc, x.line) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    kept = {x.doc_id: x.text for x in lines.remove(df).collect()}
    gone = slow_lines(rows)
    assert kept[None] == "a\nb" and kept[500] is None
    assert all(kept[d] == "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows)
    assert lines.remove(empty).count() == 0 and lines.remove(docs).count() == docs.count()


@pytest.mark.parametrize("t", [0.5, 0.8])
def test_short_lines_by_brute_force(spark, t):
    import random

    r = random.Random(5)
    rows = [(0, "a b c d"), (1, "a b c d e\nz a b c d"), (2, "p q r s t"), (3, "q p s r"), (4, "k l m\nk l m n")]
    rows += [(k, "\n".join(" ".join(r.sample("ghijuvwxy", r.randint(1, 6))) for _ in range(3))) for k in range(5, 60)]
    got = lines.out_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), similarity=t).collect()
    assert {(x.doc, x.line) for x in got} == slow_lines(rows, t)
    assert {(1, 0), (1, 1), (3, 0)} <= {(x.doc, x.line) for x in got}


def test_rows_that_repeat_a_key_keep_their_own_lines(spark):
    first, own = "the same line stands in both of these texts", "unique words that nobody else ever said here"
    rows = [(1, first), (2, first + "\nrest a b c"), (2, own), (2, own), (3, "x\n" + own)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc, r.line, r.src_doc, r.src_line) for r in lines.out_lines(df).collect()) == [(2, 0, 1, 0), (3, 1, 2, 0)]
    assert sorted(r.text for r in lines.remove(df).collect()) == sorted([first, "rest a b c", own, own, "x"])


def test_only_wanted_lines_are_read_for_words(monkeypatch):
    """Verification passes pick few lines; what they pick has the sets that a pass over all lines gives it."""
    read, words = [], lines.Words
    monkeypatch.setattr(lines, "Words", lambda x: read.append(len((made := words(x)).data)) or made)
    texts = pa.array(["a b\n\n c a\nd", None, "", "\nx y z\n", "e f g h", "\n"])
    ranks = np.arange(lines.SLOTS, dtype=np.uint32)
    every = lines.LineSets(texts, ranks)
    some = lines.LineSets(texts, ranks, lambda doc, number: (doc == 0) & (number > 0) | (doc == 3))
    none = lines.LineSets(texts, ranks, lambda doc, number: doc < 0)
    assert read == [26, 10, 0] and len(none.n) == 0
    kept = [k for k, x in enumerate(zip(every.doc.tolist(), every.number.tolist())) if x in ((0, 2), (0, 3), (3, 1))]
    assert (some.doc.tolist(), some.number.tolist()) == ([0, 0, 3], [2, 3, 1]) and [every.sid[k] for k in kept] == some.sid.tolist()
    assert some.keys.tolist() == [x for k in kept for x in every.keys[every.starts[k] : every.starts[k] + every.n[k]].tolist()]


@pytest.mark.parametrize("count", [1, 50, 70_000])
def test_words_of_a_line_are_in_order_if_slots_clash(count):
    r = np.random.default_rng(4)
    line = np.sort(r.integers(0, count, 100_000))
    keys = r.integers(0, 6, len(line)).astype(np.uint64) << np.uint64(64 - lines.SLOT_BITS) | r.integers(0, 9, len(line)).astype(np.uint64)
    assert (lines.in_order(keys, line, count) == keys[np.lexsort((keys, line))]).all()


def test_sketch_groups_over_batches(spark):
    """A group longer than a batch meets its first and its previous lines; every result is an earlier line."""
    rows = [(k, " ".join([f"w{j}" for j in range(24)] + [f"x{k % 7}", f"y{k % 5}"])) for k in range(3000)]
    got = lines.out_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc for r in got} == set(range(1, 3000)) and all(r.src_doc < r.doc for r in got)


# --- 7 --------------------------------------------------------------------------------------


def test_token_counts(docs, empty):
    scores = tokencounts.log_probabilities(bpe.load_ranks(VOCABULARY))
    longest = max(map(len, scores))

    def slow(b):
        best = [(0.0, 0)]
        for i in range(1, len(b) + 1):
            best.append(max((best[j][0] + scores[b[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if b[j:i] in scores))
        return -best[-1][1]

    for r in tokencounts.count(docs, VOCABULARY, public_tokenizers.PATTERN).collect():
        found = regex.findall(public_tokenizers.PATTERN, (BASE if r.doc_id is None else TEXTS[r.doc_id]) or "")
        assert (r.n_pretokens, r.n_tokens) == (len(found), sum(slow(x.encode()) * n for x, n in collections.Counter(found).items()))
    assert tokencounts.count(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    made = tokencounts.counter(VOCABULARY, public_tokenizers.PATTERN)
    run = "abcdefgh" * 40_000  # one pre-token of 320,000 bytes
    assert made.count([run, run[:1000]]) == [(1, made.trie.alone(run.encode())), (1, slow(run[:1000].encode()))] and run not in made.kept
    assert made.trie.alone(run[:1000].encode()) == slow(run[:1000].encode())


CLASHES = ["n_words", "kept", "fingerprint", "component_id", "spans", "ids", "n_tokens", "verdict", "host", "_k", "k", "t", "th", "at", "_text", "_doc", "_words", "_host", "_gone", "doc", "line", "h", "c", "fp", "item_id", "decoded"]


def test_extra_columns_with_the_names_of_results(spark, docs, empty):
    import corpus_pipeline

    for frame in (docs, empty):
        wide = frame.drop("_k").selectExpr("*", *(f"'x' AS `{n}`" for n in CLASHES))
        bench = spark.createDataFrame([(1, BASE)], "item_id bigint, text string").selectExpr("*", "'y' AS id", "'z' AS k")
        n = wide.count()
        assert quality.judge(wide).count() == n and pii.find(wide).count() == n and simhash.groups(wide).count() == n and substrings.remove(wide).count() == n
        assert bpe.encode_digests(wide, VOCABULARY, public_tokenizers.PATTERN).count() == n and tokencounts.count(wide, VOCABULARY, public_tokenizers.PATTERN).count() == n
        assert decontaminate.contaminated(wide, bench).columns[:2] == ["doc_id", "item_id"]
        for k, stage in enumerate((quality.keep, lines.remove, simhash.one_of_each, lambda d: decontaminate.clean(d, bench))):
            out = stage(wide)
            assert out.columns == wide.columns, k
            assert out.where(" OR ".join(f"`{c}` <> 'x'" for c in CLASHES)).count() == 0
        last = corpus_pipeline.encode_and_decode(spark, wide, "")
        assert last.columns[: len(wide.columns)] == wide.columns and len(last.columns) == len(wide.columns) + 2 and last.count() == n
    pages = spark.createDataFrame([(1, "http://a.com/x", "<p>x", "e", "f")], "page_id bigint, url string, html string, host string, text string")
    assert urls.judge(pages).first().host == "a.com" and html.extract(pages).first().text == "x"


# --- 8 ---------------------------------------------------------------------------------------


def slow_fingerprint(text):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = WORD.findall(ws)
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(fps))]


def test_fingerprints(docs, empty):
    got = {r.doc_id: r for r in simhash.groups(docs).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k].fingerprint == f"{slow_fingerprint(t):016x}"
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0 and got[5].component_id == 4 == got[None].component_id
    assert simhash.groups(empty).count() == 0
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert 4 in kept and 5 not in kept and None in kept


@pytest.mark.parametrize("block", [8, 2048])
def test_links_by_brute_force(spark, block):
    rng = np.random.default_rng(3)
    fps = set(rng.integers(0, 1 << 63, 300).tolist())
    for f in list(fps)[:40]:
        x = f
        for _ in range(8):  # chains of near fingerprints
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    want = slow_components(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp bigint")
    from tessera.llm.graph import components

    found = {r.node: r.root for r in components(simhash.links(df, block=block)).collect()}
    got = [found.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    pairs = lambda labels: {frozenset(np.flatnonzero(np.array(labels, dtype=object) == x).tolist()) for x in set(labels)}
    assert pairs(got) == pairs(want)


def test_more_bands_give_the_same_links(spark):
    from tessera.llm.graph import components

    assert [simhash.bands_for(n) for n in (0, 1, 10**7, 10**8, 10**9, 10**12)] == [6, 6, 6, 7, 8, 16]
    r = np.random.default_rng(12)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 6), replace=False)) for b in base for _ in range(6)}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    made = [sorted((x.node, x.root) for x in components(simhash.links(df, bands=b)).collect()) for b in (6, 8, 10)]
    assert made[0] and made[0] == made[1] == made[2]


# --- 9 -----------------------------------------------------------------------------------------


def reference():
    ranks = bpe.load_ranks(VOCABULARY)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_libraries(docs, empty):
    enc = reference()
    for r in bpe.encode_digests(docs, VOCABULARY, public_tokenizers.PATTERN).collect():
        text = (BASE if r.doc_id is None else TEXTS[r.doc_id]) or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode_digests(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY)
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and back.columns == [*docs.columns, "ids", "decoded"]
    trip = bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert trip.columns == [*docs.columns, "ids"] and trip.count() == docs.count()
    assert bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, into="LANG").columns == [*docs.columns, "_LANG"]


def test_random_texts_and_chunks():
    import random

    enc, mine, r = reference(), bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN), random.Random(4)
    for _ in range(2000):
        t = "".join(chr(r.choice((r.randint(0, 127), r.randint(0, 0x2FFF), r.randint(0x10000, 0x1FFFF)))) for _ in range(r.randint(0, 50)))
        assert memoryview(mine.packed(t)).cast("I").tolist() == enc.encode_ordinary(t)
    for b in (b"abcabc" * 3000, b"a" * 9000, "日本語".encode() * 2000):
        assert mine.machine.encode(b) == list(mine.machine.stream((b[i : i + 97] for i in range(0, len(b), 97)), look=300))
    back = bpe.Decoder(mine.ranks)
    ids = enc.encode_ordinary("naïve 🙂 日本")
    assert "".join(back.feed([i]) for i in ids) + back.feed((), True) == "naïve 🙂 日本"


@pytest.mark.parametrize("most", [50, 500, 5000])
def test_tables_that_are_full_are_made_again(most):
    import random

    enc, ranks, r = reference(), bpe.load_ranks(VOCABULARY), random.Random(most)
    small = bpe.Transducer(ranks, max_states=most)
    resets, reset = [], small.reset
    small.reset = lambda: (resets.append(1), reset())
    entries = list(ranks)
    for k in range(20_000):
        piece = b"".join(r.choices(entries, k=r.randint(1, 4))) if k % 2 else bytes(r.choices(range(256), k=r.randint(1, 12)))
        assert small.encode(piece) == enc._encode_single_piece(piece)
    assert resets


# --- 10 -----------------------------------------------------------------------------------------


def slow_substrings(rows):
    first, words = {}, {}
    for d, t in rows:
        ws = words[d] = WORD.findall(t or "")
        for i in range(len(ws) - 12):
            key = tuple(ws[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - 12):
            if first[tuple(ws[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out[d] = len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest()
    return out


def test_spans_that_differ_are_told(spark):
    """Two later spans of one source, one of which has other words than the source."""
    rows = [(1, 10, 0, 20, 111, None, None, None), (1, 10, 0, 20, 111, 5, 50, 3), (1, 10, 0, 20, 222, 6, 60, 4), (2, 10, 0, 20, 7, None, None, None), (2, 10, 0, 20, 7, 8, 80, 0)]
    sides = spark.createDataFrame(rows, "src_doc long, src_th long, s long, n long, d long, doc long, th long, start long")
    assert [(r["_k"], r.th, r.bad) for r in substrings._differing(sides).collect()] == [(6, 60, [4])]


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 20)
    rows = [(k, " ".join(f"p{j}" for j in range(30)) + f" own{k}") for k in range(100)] + [(100 + k, f"q{k} " * 30) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove(df).collect()} == slow_substrings(rows)


def test_substring_dedup(spark, docs, empty, corpus):
    import random

    r = random.Random(6)
    rows = [(k, " ".join(r.choice("a b c d") for _ in range(r.randint(0, 60)))) for k in range(60)]
    passage = [f"p{k}" for k in range(60)]
    for k in range(60, 120):
        i = r.randint(0, 40)
        rows.append((k, " ".join([f"x{r.random()}", *passage[i : i + r.randint(10, 40)], "y z"])))
    rows += [(200, None), (201, ""), (202, "é " * 40), (203, "é " * 41)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove(df).collect()} == slow_substrings(rows)
    rows = [(x.doc_id, x.text) for x in corpus.collect()]
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove(corpus).collect()} == slow_substrings(rows)
    spans = substrings.repeats(df).select("doc", F.inline("mine")).collect()
    words = {d: (t or "").split() for d, t in [(x.doc_id, x.text) for x in df.collect()]}
    assert any(x["count"] > 5 for x in spans)
    for x in spans:
        n, s = x["count"] + 12, x["start"] + x["shift"]
        assert x.src_doc < x.doc and words[x.doc][x["start"] : x["start"] + n] == words[x.src_doc][s : s + n]
    got = [x for x in substrings.remove(docs).collect() if x.doc_id is None]
    assert [(x.n_words, x.n_removed) for x in got] == [(21, 0)]
    assert substrings.remove(docs).count() == docs.count() and substrings.remove(empty).count() == 0


