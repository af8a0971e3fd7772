"""Operators on single texts: encoding, chat, HTML, personal data, toxicity, fingerprints."""

import hashlib
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlake.llm import bpe, chat, html_text, pii, spotsigs, toxicity
from gridlake.llm.queries import op2_chat, op5_spotsigs, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "x", None, "a", 1), (3, "x", None, "a", 1),
    (4, "word " * 5000, "en", "b", 25000), (5, " \n\t ", "en", "b", 4), (6, "Ünïcödé 😀 <|endoftext|> </s>[INST]", "en", "c", 1),
]


@pytest.fixture()
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with those of results."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("id", "ids", "words", "keys", "size", "copy1", "rep", "_text", "spans", "score", "host", "part")})


# Encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_bpe_equals_the_library_on_whole_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = bpe.encode_documents(docs, vocabulary()).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_bpe_equals_the_library_on_any_latin_text(text):
    enc = bpe.word_bpe(vocabulary())
    ids = enc.encode(text)
    lib = _library()
    want = lib.encode(text, add_special_tokens=False).ids
    assert ids == want and enc.decode(ids) == lib.decode(want, skip_special_tokens=False)


def _library(kept=[]):  # noqa: B006
    from tokenizers import Tokenizer

    if not kept:
        kept.append(Tokenizer.from_file(vocabulary()))
    return kept[0]


def test_no_merge_crosses_a_forced_boundary():
    enc = bpe.word_bpe(vocabulary())
    for word in ("internationalization", "zqxjkv", "don’t", "日本語", "a" * 300):
        data, parts = word.encode(), []
        starts = enc.cuts(data)
        for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
            ids = [enc.byte_ids[x] for x in data[a:b]]
            if b == len(data):
                ids[-1] = enc.end_ids[data[-1]]
            parts += enc.merge(ids)
        whole = [enc.byte_ids[x] for x in data[:-1]] + [enc.end_ids[data[-1]]]
        assert parts == enc.merge(whole)


def test_bpe_on_odd_rows_and_empty_tables(spark, odd, library):
    rows = bpe.encode_documents(odd, vocabulary()).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].ids == by[2].ids == by[5].ids == [] and by[1].decoded == ""
    assert 49407 in by[6].ids and by[4].n_tokens == 5000
    assert bpe.encode_documents(odd.limit(0), vocabulary()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("abe' t", min_size=1, max_size=30), st.integers(1, 40))
def test_the_heap_merges_as_the_list_does(text, times):
    enc = bpe.word_bpe(vocabulary())
    ids = [enc.byte_ids[b] for b in (text * times).encode()]
    want = _merged_plainly(enc, list(ids))
    assert enc.merge_long(list(ids)) == want and enc.merge(list(ids)) == want


def _merged_plainly(enc, s):
    while True:
        ranks = [enc.merges.get(x << 20 | y, bpe.NO_MERGE) for x, y in zip(s, s[1:], strict=False)]
        if not ranks or min(ranks) == bpe.NO_MERGE:
            return s
        k = ranks.index(min(ranks))
        s[k : k + 2] = [ranks[k] & 0xFFFFF]


def test_very_long_words_take_seconds(library):
    import time

    enc = bpe.word_bpe(vocabulary())
    rng = np.random.default_rng(0)
    begun = time.time()
    for text in ("a" * 1_000_000, "".join(rng.choice(list("aeinrst"), 1_000_000)), "héllo日本" * 100_000):
        ids = enc.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert time.time() - begun < 60


def test_bpe_equals_the_library_on_every_code_point(library):
    """Alone and inside a word: all code points that Python's tables know, but surrogates."""
    enc = bpe.word_bpe(vocabulary())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    odd = []
    for at in range(0, len(points), 500):
        text = " ".join(f"{c} a{c}b" for c in points[at : at + 500])
        if enc.encode(text) != library.encode(text, add_special_tokens=False).ids:
            odd += [c for c in points[at : at + 500] if enc.encode(f"{c} a{c}b") != library.encode(f"{c} a{c}b", add_special_tokens=False).ids]
    assert not odd, (len(odd), [hex(ord(c)) for c in odd[:20]])


# Chat


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>[]/\\sINSTROLE x", max_size=40))
def test_escape_is_reversible_and_hides_control_strings(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text
    assert not any(c in shown for c in chat.CONTROLS)


def test_chat_reads_back_what_was_said(spark, sf):
    got = {r.conv_id: r for r in op2_chat(spark, sf).collect()}
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in turns] + [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {t[0] for t in turns}:
        mine = sorted(t for t in turns if t[0] == conv)
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in mine)
        learnt = "".join(x for _, _, r, x in mine if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert got[conv].n_turns == len(mine) and got[conv].loss_chars == len(learnt)


def test_chat_sequence_and_mask(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(1, 0, None, None, 9), (1, 1, "assistant", "hello there", 9), (1, 1, "assistant", "hello there", 9), (None, 0, "user", "<s>", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    out = chat.format_conversations(df, path)
    got = sorted(out.where("conv_id = 1").collect(), key=lambda r: r.seq)
    assert [r.seq for r in got] == [0, 1, 2]
    assert [r.start for r in got] == [0, len(got[0].ids), len(got[0].ids) + len(got[1].ids)]
    assert all(len(r["mask"]) == len(r.ids) for r in got) and sum(got[0]["mask"]) == 0
    begin, turn, role, end_turn, end = chat.reserved(path)
    for r in got[1:]:  # the mask covers what stands between the mark of the role and the end
        at = r.ids.index(role) + 1
        assert r["mask"] == [int(at <= k < len(r.ids) - 1) for k in range(len(r.ids))] and r.ids[-1] == end and sum(r["mask"]) > 0
    moved = out.orderBy(F.desc("seq"))
    assert sorted(map(str, chat.read_back(moved, path).collect())) == sorted(map(str, chat.read_back(out, path, in_order=True).collect()))
    assert chat.read_back(out, path).where("conv_id IS NULL").first().n_turns == 1
    assert chat.read_back(chat.format_conversations(df.limit(0), path), path).count() == 0


# HTML


def test_html_keeps_the_article_of_every_page(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_leaves_out_what_is_no_article():
    page = """<html><head><title>T</title></head><body><header><a href=/>Home</a> The site of all sites</header>
    <div id="cookie-notice">We use cookies. Accept all of them.</div><aside class=sidebar><p>One thing happened here today. It was big.</p></aside>
    <main><h1>Title here</h1><p>First paragraph with a <a href=b>link</a> &amp; more.<p>Short.<div class="ad">Buy now! It is cheap.</div>
    <ul><li>Item one<li>Item two</ul><script>var x = "<p>no</p>";</script><form><label>Email</label></form></main>
    <section id=comments><p>Great article, I really liked it. Thanks.</p></section><footer>&copy; 2024</footer>"""
    assert html_text.main_text(page) == "Title here\nFirst paragraph with a link & more.\nShort.\nItem one\nItem two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_minimum_cut_is_minimal(data):
    n = data.draw(st.integers(1, 7))
    scores = data.draw(st.lists(st.integers(-4, 4), min_size=n, max_size=n))
    edges = {(a, b): data.draw(st.integers(0, 3)) for b in range(n) for a in range(b)}

    def cost(side):
        return sum(max(0, -s) if x else max(0, s) for s, x in zip(scores, side, strict=True)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])

    found = html_text.source_side([float(s) for s in scores], edges)
    assert cost(found) == min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))


def test_texts_full_of_addresses(spark):
    """Thousands of spans in one text: every one is found and replaced, in a time that does not grow with their square."""
    n = 6000
    text = "1.2.3.4 a@b.cd " * n
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = pii.train(df)
    start = time.perf_counter()
    row = pii.find(df, model=model).first()
    assert (row.n_ip, row.n_email, row.n_added) == (n, n, 0)
    want = sorted([("ip", 15 * k, 15 * k + 7) for k in range(n)] + [("email", 15 * k + 8, 15 * k + 14) for k in range(n)], key=lambda x: (pii.KINDS.index(x[0]), x[1]))
    assert row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
    assert pii.redact(df, model=model).first().text == "[IP] [EMAIL] " * n
    assert time.perf_counter() - start < 120


def test_minimum_cut_of_many_blocks_takes_seconds():
    """Long pages of short blocks of all kinds, and a graph without structure, where max-flow has to run."""
    rng = random.Random(4)
    kinds = ["<p>%s</p>", "<li>%s</li>", "<div>%s</div>", "<ul><li><a href=x>%s</a></li>", "</ul><div><p>%s</p></div>"]
    page = "".join(rng.choice(kinds) % " ".join(rng.choice(["menu", "the", "story", "long"]) for _ in range(rng.randint(1, 6))) for _ in range(100_000))
    start = time.perf_counter()
    blocks = html_text.blocks_of(page)
    edges = html_text.edges_of(blocks)
    for scores in ([b.score for b in blocks], [rng.uniform(-1, 1) for _ in blocks]):
        assert len(html_text.source_side(scores, edges)) == len(blocks) >= 100_000
    tangle = {tuple(sorted(rng.sample(range(2000), 2))): 1.0 for _ in range(8000)}
    html_text.source_side([rng.uniform(-1, 1) for _ in range(2000)], tangle)
    assert time.perf_counter() - start < 60


def test_html_of_deep_nesting_takes_seconds():
    import time

    begun = time.time()
    deep = "<div><b>" * 30_000 + "Some words that stand deep inside. Yes, they do." + "</i></div>" * 30_000
    html_text.main_text("<article>" + deep + "</article>")
    assert time.time() - begun < 20


def test_html_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, "u", "<p>Some words that stand alone. Yes.</p>", 2)], "page_id long, url string, html string, text int")
    assert {r.url: r.text for r in html_text.extract(df).collect()}[None] == ""
    assert html_text.extract(df.limit(0)).count() == 0


# Personal data


def _luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4) if k % 2 else int(c)) for k, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    for kind, pattern in pii.FIXED.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                yield f"{kind}:{m.start()}:{m.end()}"


TRICKY = ["a@b.c_d@e.f é x@y.z.", "1.2.3.4.5.6.7.8 9.9.9 300.1.1.1 0255.1.1.1", "4539 1488 0343 6467 4539148803436467", "+1 (323) 555-9830 +49-30-1234567.", "a" * 5000 + "@b.c", "1-" * 4000, "1" * 9000, "+" + "1 " * 4000]


def test_base_spans_equal_plain_matching(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([*TRICKY, None, ""])], "doc_id long, text string"))
    found = pii.find(docs).join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    for r in found:
        want = list(_base(r.text or ""))
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(w.startswith(kind + ":") for w in want)


def test_look_alikes_are_added_and_redacted(spark):
    rows = [(k, f"call +1 (323) 555-{1000 + k} or mail user{k}@mail.example.com today") for k in range(60)]
    rows += [(100 + k, f"item {1000 + 7 * k} of {k} and part {90000 + k} here") for k in range(60)]
    rows += [(200, "call (323) 555-9830 please"), (201, None), (202, "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    model = pii.train(df)
    got = {r.doc_id: r for r in pii.find(df, model=model).collect()}
    assert got[200].spans == "phone:5:19" and got[200].n_added == 1 and got[200].n_phone == 0
    assert all(got[100 + k].spans == "" for k in range(60))
    text = {r.doc_id: r.text for r in pii.redact(df, model=model).collect()}
    assert text[0] == "call [PHONE] or mail [EMAIL] today" and text[200] == "call [PHONE] please" and text[201] is None and text[202] == ""
    assert pii.find(df.limit(0)).count() == 0


def test_threshold_is_calibrated():
    score, good, bad = np.array([0.1, 1.0, 2.0, 3.0]), np.array([1.0, 50.0, 90.0, 99.0]), np.array([99.0, 50.0, 1.0, 0.0])
    assert pii.threshold_of(score, good, bad) == 2.0
    assert pii.threshold_of(score, good * 0, bad) == float("inf")


# Toxicity


def test_grammar_weakens_negated_and_reported_insults():
    reader = toxicity.Reader(toxicity.Model({}, toxicity.PLAIN))
    plain, negated, reported, aimed = (sum(reader.clauses(t)[0]) for t in ("He is an idiot.", "He is not an idiot.", "She said he is an idiot.", "You are an idiot."))
    assert negated < plain < aimed and reported < plain
    assert not reader.clauses("I will kill time.")[0] and reader.clauses("You they kill.")[0]
    assert len(reader.clauses("idiot. fine. moron!")[0]) == 2


def test_composition_equals_running_one_after_the_other():
    a, b = toxicity.negation(), toxicity.aimed()
    ab = toxicity.compose(a, b)
    rng = np.random.default_rng(0)
    for _ in range(200):
        word = rng.integers(0, 9, 12).tolist()
        one, sa, sb, total, s = 0.0, 0, 0, 0.0, 0
        for x in word:
            y, w, sa = a[sa, x]
            y, v, sb = b[sb, y]
            one += w + v
            _, u, s = ab[s, x]
            total += u
        assert abs(one - total) < 1e-9


def test_toxicity_learns_and_holds_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, changed)
    assert model.stems == again.stems and np.allclose(model.coefficients, again.coefficients)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.7


def test_toxicity_on_held_out_documents_of_a_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    assert np.mean([np.mean((g > np.array(bad)) + 0.5 * (g == np.array(bad))) for g in good]) > 0.93
    assert sum(r.predicted for r in rows if r.toxic) > 0.8 * len(good) and sum(r.predicted for r in rows if not r.toxic) < 0.02 * len(bad)


def test_toxicity_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 1, None), (99, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.without_toxic(odd, model).count() == len(ODD)
    assert toxicity.score(odd.limit(0), model).count() == 0


# Fingerprints


def test_spot_signatures():
    text = "The quick brown fox and the lazy dog jumped over a big red fence"
    assert len(spotsigs.signatures(text)) == 4
    assert len(spotsigs.signatures(None)) == 0 and len(spotsigs.signatures("zzz")) == 1


def test_pruned_jaccard_equals_the_plain_one():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 60)).astype("u8")) for _ in range(2))
        plain = len(np.intersect1d(a, b)) / len(np.union1d(a, b)) if len(a) and len(b) else float(len(a) == len(b))
        assert abs(spotsigs.jaccard(a, b) - plain) < 1e-12
        assert spotsigs.jaccard(a, b, 0.5) == (spotsigs.jaccard(a, b) if plain >= 0.5 else 0.0)


def test_fingerprints_of_edited_texts(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: r for r in op5_spotsigs(spark, sf).collect()}
    for k, (i, text) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (spotsigs.signatures(t) for t in (text, edited, after))
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert got[i].fingerprint == spotsigs.fingerprint(a) and got[i].edited_fingerprint == spotsigs.fingerprint(b)
        assert got[i].near_edited == spotsigs.jaccard(a, b) and got[i].near_next == spotsigs.jaccard(a, c)


def test_following_documents_across_ranges(spark, odd, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS_A_RANGE", 7)
    df = spark.createDataFrame([(k * 3, f"the text number {k} is of {k} and so") for k in range(100)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in spotsigs.with_next(df).collect()}
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    for k, (i, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(k + 1) % 100][1][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert Counter(r.doc_id for r in spotsigs.with_next(odd).collect()) == Counter(r[0] for r in ODD)
    one = spotsigs.with_next(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.with_next(df.limit(0)).count() == 0


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["the", "of", *[f"w{k}" for k in range(400)]], 120, p=[0.1, 0.1, *[0.002] * 400])) for _ in range(12)]
    rows = []
    for text in base:
        for share in (0.0, 0.0, 0.02, 0.04, 0.1):
            words = [f"z{rng.integers(1000)}" if rng.random() < share else w for w in text.split()]
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.a, r.b): r.likeness for r in spotsigs.similar_pairs(df).collect()}
    least = {}
    for i, t in rows:
        least.setdefault(spotsigs.signatures(t).tobytes(), i)
    reps = [(i, spotsigs.signatures(t)) for i, t in rows if least[spotsigs.signatures(t).tobytes()] == i and t]
    want = {(a, b): spotsigs.jaccard(x, y) for a, x in reps for b, y in reps if a < b and spotsigs.jaccard(x, y) >= spotsigs.LIKENESS}
    assert want and got == want


@pytest.mark.parametrize("partitions", [1, 200])
def test_toxicity_learns_the_same_in_any_number_of_partitions(spark, partitions):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = toxicity.train(docs, labels)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = toxicity.train(docs.repartition(partitions), labels)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got.stems == want.stems and np.allclose(got.coefficients, want.coefficients, rtol=1e-9)
    rows = toxicity.score(docs, got).where("held_out").join(labels, "doc_id").where("toxic = 1").collect()
    assert sum(r.predicted for r in rows) > 0.6 * len(rows)


def _clauses_by_hand(text, stems):
    """Clause scores by running the four transducers one after the other over each clause's words."""
    fixed = {w: k for k, words in ((toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS), (toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS)) for w in words}
    fixed |= {w: toxicity.INSULT + 2 for w in toxicity.INSULTS}
    out = []
    for clause in re.split(r"[.!?;\n]", (text or "").lower()):
        symbols = []
        for w in re.findall(r"[^\W_]+(?:'[^\W_]+)?", clause):
            levels = [stems[w[:n]] for n in range(1, len(w) + 1) if w[:n] in stems]
            symbols.append(max([fixed.get(w, 0), *(toxicity.INSULT + v - 1 for v in levels)]))
        total = 0.0
        for machine in (toxicity.negation(), toxicity.reported(), toxicity.aimed(), toxicity.insult()):
            state, passed = 0, []
            for x in symbols:
                y, w, state = machine[state, x]
                passed.append(y)
                total += w
            symbols = passed
        if total:
            out.append(total)
    return out


def test_scored_clauses_equal_the_transducers_run_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    reader, found = toxicity.Reader(model), 0
    for r in docs.select("text").collect():
        want = _clauses_by_hand(r.text, model.stems)
        got, _ = reader.clauses(r.text)
        assert np.allclose(got, want)
        found += len(got)
    assert found > 100


def test_bpe_merges_a_word_beside_other_signs_once(monkeypatch):
    encoder, made = bpe.WordBpe(vocabulary()), []
    plain = encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda s: made.append(1) or plain(s))
    texts = ["(vexillology), vexillology; vexillology!", "vexillology... \"vexillology\""]
    whole = bpe.WordBpe(vocabulary())
    monkeypatch.setattr(bpe, "UNCUT", 0, raising=False)
    want = [whole.encode(t) for t in texts]
    monkeypatch.undo()
    monkeypatch.setattr(encoder, "merge", lambda s: made.append(1) or plain(s))
    assert [encoder.encode(t) for t in texts] == want
    assert len(made) == len({w for t in texts for p in t.split() for w in encoder.words.findall(p)})
