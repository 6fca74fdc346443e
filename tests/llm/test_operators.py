"""The operators against brute force, on hand-made and on given rows."""

import gzip
import io
import itertools
import json
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from oracle_compare import connect, oracle_rows, spark_rows
from pyspark.sql import functions as F

from threadloom.llm import (
    components, html_text, language_id, language_model, mtree, packing, quality, rules, sentencepiece_ids, simhash, warc,
)
from threadloom.llm.common import prepare
from threadloom.llm.queries import ORACLES, QUERIES, piece_model

SF_DIR = "/root/testdata/sf0.001"
LONG = "Long lines of text, " * 3_000


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="module")
def docs(spark):
    """NULLs in every column, empty and long texts, copies, repeated rows, and columns whose
    names the operators use themselves."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [
        (1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, text + " more", "en", "b"),
        (4, None, None, None), (5, "", "en", "a"), (6, " \t\n\r ", "de", "b"), (7, LONG, "en", None),
        (None, text, None, "a"), (None, None, None, None), (8, "a b", "fr", "a"), (9, "12 34 !!", "fr", "c"),
        (10, "x " * 60, "en", "c"), (11, "Ünïcödé 日本語 🙂 \x00 end", "de", "c"), (12, "one\ntwo\none\none\n\n", "en", "c"),
    ]
    clash = ("row", "place", "id", "fp", "n_words", "kept", "host", "score", "found", "m", "key", "word", "bin_id")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return table.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == oracle_rows(connect(SF_DIR), ORACLES[name])


# --- 1 ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>One,  two\n three.<p>Fo&uuml;r</article>", "T & U\nOne, two three.\nFoür"),
        ("<div class=ad>Buy now, now, now</div><div><p>Some text, with commas, and more of it.</p><p>And again, so.</p></div>", "Some text, with commas, and more of it.\nAnd again, so."),
        ("<article><p>Text one<!-- <p>no</p> --><script>var a='<p>no</p>'</script> goes on</p></article><div id=comments><p>Great, great, great post, thanks a lot!</p></div>", "Text one goes on"),
        ("<article><p>Short &am</p><p>cut &amp</p></article>", "Short &am\ncut &"),
        ("<main><article><section><p>A first part, here.</p></section><section><p>A second part, here.</p></section></article><aside><p>Side, side, side, side.</p></aside></main>", "A first part, here.\nA second part, here."),
        ("<body class='has-sidebar'><form><p>Your mail, please</p></form><p>Plain page, no container, text.", "Plain page, no container, text."),
        ("<article><p>a<br>b</p><ul><li>c<li>d</ul></article>", "a b\nc\nd"),
        ("just text", "just text"),
        ("<p title='a>b'>quoted > sign</p><p", "quoted > sign"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


_STORY = "".join(f"<p>Paragraph {i} of the story, with commas, and with words enough to read.</p>" for i in range(12))
_STORY_TEXT = "\n".join(f"Paragraph {i} of the story, with commas, and with words enough to read." for i in range(12))


@pytest.mark.parametrize(
    "name",
    ["content", "content no-sidebar", "layout has-sidebar", "post with-comments", "alert-story", "side-by-side", "share-enabled post", "comments-open entry"],
)
@pytest.mark.parametrize("around", ["", "<nav><p>Home, news, more</p></nav><div class='menu'><a href=h>Home</a></div>"])
def test_marks_cannot_empty_a_page(name, around):
    readers = "<div id=comments>" + "<p>Great, great post, thanks a lot, I really liked it, all of it.</p>" * 40 + "</div>"
    page = f"<body>{around}<div class='{name}'>{_STORY}</div>{readers}<div class=footer><p>Imprint, terms</p></div></body>"
    assert html_text.main_text(page) == _STORY_TEXT
    page = f"<body>{around}<article class='ad-free story'>{_STORY}</article>{readers}</body>"
    assert html_text.main_text(page) == _STORY_TEXT


def test_marked_elements_beside_the_article_go():
    for name in ("alert", "sidebar", "cookie-notice", "related posts", "promo box", "newsletter"):
        aside = f"<div class='{name}'><p>{'Not of the story, but beside it. ' * 14}</p></div>"
        assert html_text.main_text(f"<div class=content>{_STORY}</div>{aside}") == _STORY_TEXT
        assert html_text.main_text(f"<div class='{name}'><p>A short one, without a story.</p></div>") == ""


def test_lists_of_links_inside_a_named_container():
    page = f"<main><div>{_STORY}</div><ul><li><a href=1>one link</a><li><a href=2>two</a></ul><ol><li>First, do this.<li>Then <a href=3>that</a>.</ol></main>"
    assert html_text.main_text(page) == _STORY_TEXT + "\nFirst, do this.\nThen that."


def test_time_grows_with_length():
    def seconds(page):
        start = time.process_time()
        html_text.main_text(page)
        return time.process_time() - start

    pages = ["<blockquote>a, b " * 10_000, "<div>a, b" * 10_000 + "</x>" * 10_000, "<b>" * 10_000 + "<p></p><li></li>" * 10_000]
    assert all(seconds(page) < 3.0 for page in pages)


def _brute_scores(root):
    """Points of every container by the definition, each paragraph walked on its own."""
    def inside(node):
        yield node
        for c in node.children:
            if isinstance(c, html_text.Node) and not c.drop:
                yield from inside(c)

    def strings(node):
        return [c for n in inside(node) for c in n.children if isinstance(c, str)]

    def length(node):
        return sum(len(" ".join(s.split())) for s in strings(node))

    scores = {}
    for node in inside(root):
        holds_block = any(isinstance(c, html_text.Node) and c.tag in html_text._BLOCK for c in node.children)
        if node.parent is None or not length(node) or not (node.tag in html_text._PARAGRAPH or node.tag == "div" and not holds_block):
            continue
        links = sum(length(n) for n in inside(node) if n.tag == "a") / length(node)
        points = (1 + sum(s.count(",") for s in strings(node)) + min(length(node) / 100, 3)) * (1 - links)
        above, level = node.parent, 0
        while above is not None:
            scores[id(above)] = scores.get(id(above), 0) + points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            above, level = above.parent, level + 1
    return scores


def test_scores_by_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "<p>Some, text, here", "</p>", "<section>", "</section>", "<li>", "<span>", "</span>", "words, and more words " * 9, "<td>"]) for _ in range(80))
        root = html_text.parse(page)
        order = list(html_text._walk(root))
        html_text._measure(order)
        html_text._best(order)
        expected = _brute_scores(root)
        assert {id(n): pytest.approx(n.score) for n in order if n.scored} == expected


def test_pages_with_broken_nesting_and_depth():
    deep = "<div>" * 3_000 + "<p>Deep, deep text.</p>"
    assert html_text.main_text(deep) == "Deep, deep text."
    assert html_text.main_text("</div></p><b><p>x, y<i>z</b></i></p>") == "x, yz"


def test_extraction_of_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, 0)], "page_id long, url string, html string, text int"
    )
    assert sorted(map(tuple, html_text.extracted(pages).collect()), key=str) == sorted(
        [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=str
    )
    assert html_text.extracted(pages.limit(0)).count() == 0


# --- 2 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    inner = warc.record(99, "http://in", b"inside", None)
    stored = "".join(chr(b) for b in inner)
    rows = [(i, f"http://x/{i}\n%", f"page {i % 5} " * (i % 7 + 1), 1) for i in range(60)]
    rows += [(60, None, None, 1), (61, "u", "", 1), (None, "n", "page 1 ", 1), (None, "m", "alone", 1), (59, "again", "page 4 " * 4, 1), (62, "w", stored, 1)]
    rows.append((63, "long", "".join(random.Random(0).choices("abcdefgh <>&", k=200_000)), 1))
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


@pytest.mark.parametrize("size", [100, 777, 8 << 20])
def test_archives_round_trip(spark, pages, size):
    rows = pages.collect()
    firsts = {}
    for r in rows:
        firsts.setdefault(r.html or "", []).append(r.page_id)
    expected = []
    for r in rows:
        ids = [i for i in firsts[r.html or ""] if i is not None]
        first = max(ids) if len(firsts[r.html or ""]) > 1 and ids else r.page_id
        revisit = first != r.page_id
        raw = (r.html or "").encode()
        expected.append((r.page_id, r.url, len(raw), warc.digest(raw), "revisit" if revisit else "response", first if revisit else None, None if revisit else raw))
    found = [
        (r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
        for r in warc.round_trip(pages, size=size).collect()
    ]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_ranges_go_to_many_tasks(spark, pages, tmp_path):
    files = warc.write_archives(pages.repartition(3), warc.qualified(spark, str(tmp_path / "warc")))
    read = warc.read_archives(spark, files, str(tmp_path), 1_000)
    ranges = sum(-(-f.bytes // 1_000) for f in files.collect())
    slots = spark.sparkContext.defaultParallelism
    # The long page alone is 130 ranges.
    assert ranges > 4 * slots and read.rdd.getNumPartitions() == max(4 * slots, -(-ranges // 16))
    assert read.count() == pages.count()


@pytest.mark.parametrize(("start", "stop"), [(0, 1 << 30), (50_000, 100_000)])
def test_bytes_are_read_once(start, stop):
    rng = random.Random(2)
    data = b"".join(warc.record(i, f"u{i}", "".join(rng.choices("abcdef ", k=rng.randrange(900))).encode(), None) for i in range(500))

    class Source:
        read, size = 0, staticmethod(lambda: len(data))

        def read_at(self, n, offset):
            self.read += n
            return data[offset : offset + n]

    source = Source()
    offsets = [at for at, _ in warc.MemberReader(source, start, stop)]
    assert len(offsets) == 500 if start == 0 else 100 < len(offsets) < 400
    assert source.read <= min(len(data), stop) - start + 2 * warc._READ


def test_small_payloads_are_stored_each(pages):
    kinds = warc.round_trip(pages, least=1_000_000).groupBy("record_type").count().collect()
    assert [(k.record_type, k["count"]) for k in kinds] == [("response", pages.count())]


def test_no_pages(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_is_plain_gzip():
    two = warc.record(1, "u", b"abc", None) + warc.record(2, "v", b"abc", 1)
    raw = gzip.GzipFile(fileobj=io.BytesIO(two)).read()
    assert raw.count(b"WARC/1.1\r\n") == 2 and b"WARC-Refers-To: <urn:page:1>" in raw


# --- 3 ---------------------------------------------------------------------------


def _measures(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


def test_measures(spark):
    texts = [None, "", "a", "a b", "a b c", "a b c a b c", "x " * 9, "a\nb\na\n \n \n#*|", "q r s t q r s u q r s", "é é x y é é x y"]
    table = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r.row.doc_id: r for r in rules.judged(table).collect()}
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _measures(text), text
        assert r.base_failed and not r.kept


def test_hosts_and_odd_rows(spark, docs, empty):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "bad", "mixed") for i in range(100)] + [(200 + i, good if i == 0 else "bad", "junk") for i in range(50)]
    rows += [(300, good, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.row.doc_id for r in rules.judged(table).where("kept").collect()}
    # The one good document of a host that is nearly all junk goes with it.
    assert kept == {i for i in range(100) if i % 10} | {300}
    assert rules.keep_good(docs).columns == docs.columns
    # Half of host b fails, and most of this small table does: its good document goes too.
    assert sorted(r.doc_id or 0 for r in rules.keep_good(docs).collect()) == [0, 1, 2, 2]
    assert rules.judged(empty).count() == 0


# --- 4 ---------------------------------------------------------------------------


def test_tables_equal_convolution():
    net = language_id.ByteNet(["a", "b"], seed=3)
    rows = language_id.windows_of("Some text to slide over, é ß. " * 20)
    tops = []
    for w, filters, bias in zip(language_id.WIDTHS, net.filters, net.bias, strict=True):
        answers = [net.embed[rows[:, i : i + w]].reshape(len(rows), -1) @ filters for i in range(rows.shape[1] - w + 1)]
        tops.append(np.maximum(np.max(answers, axis=0) + bias, 0))
    scores = np.concatenate(tops, axis=1) @ net.out + net.shift
    expected = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(rows), expected, atol=1e-5)


def test_gradients_of_the_net():
    net = language_id.ByteNet(["a", "b", "c"], seed=1)
    rows = np.random.default_rng(0).integers(0, 60, (5, 40)).astype(np.uint8)
    labels = np.array([0, 1, 2, 0, 1])
    grads = net._step(rows, labels)

    def loss():
        x, tops = net.embed[rows], []
        for w, f, b in zip(language_id.WIDTHS, net.filters, net.bias, strict=True):
            tops.append(np.maximum(np.max([x[:, i : i + w].reshape(5, -1) @ f + b for i in range(41 - w)], axis=0), 0))
        p = language_id._softmax((np.concatenate(tops, axis=1) @ net.out + net.shift).astype(np.float64))
        return -np.log(p[np.arange(5), labels]).mean()

    for part, grad in ((net.filters[1], grads[2]), (net.out, grads[-2]), (net.embed, grads[0])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        part[at] += 1e-2
        up = loss()
        part[at] -= 2e-2
        down = loss()
        part[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[at]) < 0.05 * abs(grad[at]) + 1e-3


def test_language_of_odd_rows(docs, empty):
    model = language_id.train(docs)
    found = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predicted(docs, model).collect()]
    assert len(found) == docs.count()
    for name, lang, score in found:
        assert 0.0 <= score <= 1.0
        assert (lang == "und") == (name in (4, 5, 6, 9) or name is None and score == 0.0)
    none = language_id.train(empty)
    assert {r.lang_pred for r in language_id.predicted(docs, none).collect()} == {"und"}
    assert language_id.predicted(empty, model).count() == 0


def test_rare_languages_are_learned(spark):
    rng = random.Random(8)
    # Languages of eight letters each; every second one is a hundred times rarer.
    letters = {f"l{i:02d}": rng.sample("abcdefghijklmnopqrstuvwxyz", 8) for i in range(24)}

    def text(lang):
        return " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(20))

    names = [lang for i, lang in enumerate(letters) for _ in range(2_000 if i % 2 else 20)]
    rows = [(i, text(lang), lang) for i, lang in enumerate(names)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(letters)
    right = [model.predict([text(lang)])[0][0] == lang for lang in letters for _ in range(10)]
    assert sum(right) >= 0.9 * len(right)


def test_language_of_repeated_ids(spark):
    rows = [(1 if lang == "a" else i, f"{word} " * 9, lang) for i in range(6_000) for lang, word in (("a", "uvw"), ("b", "xyz"))]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["a", "b"]


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows} == {2}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.95


# --- 5 ---------------------------------------------------------------------------


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    field = quality.LineField(np.zeros(quality.WIDTH), rng.normal(size=(2, 2)))
    scores = rng.normal(size=6)
    total, good = 0.0, np.zeros(6)
    for states in itertools.product((0, 1), repeat=6):
        weight = np.exp(sum(s for s, y in zip(scores, states, strict=True) if y) + sum(field.moves[a, b] for a, b in itertools.pairwise(states)))
        total += weight
        good += weight * np.array(states)
    assert np.allclose(field.marginals(scores), good / total)


def test_gradient_of_the_chain():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 4, quality.WIDTH)) * 0.2
    inside = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], float)
    x *= inside[:, :, None]
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.3, 0.5, 0.2])
    state = rng.normal(size=quality.WIDTH + 4) * 0.3

    def loss(s):
        moves, out = s[quality.WIDTH :].reshape(2, 2), 0.0
        for i, n in enumerate(inside.sum(axis=1).astype(int)):
            e = x[i, :n] @ s[: quality.WIDTH]
            paths = [sum(v for v, z in zip(e, z_, strict=True) if z) + sum(moves[a, b] for a, b in itertools.pairwise(z_)) for z_ in itertools.product((0, 1), repeat=n)]
            k = int(y[i])
            own = (e.sum() if k else 0.0) + (n - 1) * moves[k, k]
            out -= weight[i] * (own - np.log(np.exp(paths).sum()))
        return out / 3

    found = quality._gradient(state, x, inside, y, weight)
    for at in (0, 7, quality.WIDTH, quality.WIDTH + 1, quality.WIDTH + 3):
        step = np.zeros_like(state)
        step[at] = 1e-5
        assert abs((loss(state + step) - loss(state - step)) / 2e-5 - found[at]) < 1e-6


def test_quality_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(14)] + [(None, 1, 0), (3, None, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.scored(empty, quality.train(empty, labels)).count() == 0
    plain = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, plain).collect()} == {0.5}


def test_long_texts_teach(spark):
    good, bad = "\n".join(["Plain words of a line that reads well."] * 2_000), "\n".join(["## $$ %% 12 12 12 !!"] * 3)
    rows = [(i, good if i % 2 else bad, i % 2) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    # All good texts are long ones: without them there is one label only, and no evidence.
    model = quality.train(table.drop("quality"), table.drop("text"))
    assert model.quality(good) > 0.7 and model.quality(bad) < 0.3


def test_drawn_lines():
    features = np.arange(5_000.0).reshape(-1, 1)
    drawn = quality.drawn_lines(features)[:, 0]
    assert len(drawn) == quality.LINES and drawn[0] == 0 and drawn[-1] == 4_999
    assert (np.diff(drawn) >= 1).all() and (np.diff(drawn) == 1).sum() == len(drawn) - len(drawn) // quality.STRETCH
    assert quality.drawn_lines(features[:700]) is not features and len(quality.drawn_lines(features[:700])) == 700


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in rows]) > 0.95


# --- 6 ---------------------------------------------------------------------------


def _best(rows, k=5):
    kept = [
        (i, np.floor(256 * np.array(v, np.float64)).astype(np.int64))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, x in kept:
        if q % 50 == 0:
            scores = sorted((-int(x @ y), i) for i, y in kept if i != q and len(x) == len(y))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(120)]
    rows += [(None, [1.0] * 8), (601, None), (602, [None] * 8), (603, [float("nan")] * 8), (604, [float("inf")] * 8)]
    rows += [(650, [1.0, 2.0]), (651, [3.0, -1.0]), (700, [0.0] * 8), (800, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, place int")
    for group, block in ((64, 3), (16_384, 8_192)):
        found = mtree.top_k(table, F.col("vec_id") % 50 == 0, group=group, block=block)
        assert sorted(map(tuple, found.collect())) == _best(rows)
    assert mtree.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pages_hold_their_bounds():
    rng = np.random.default_rng(1)
    centers = rng.integers(-200, 200, (6, 5))
    vectors = np.concatenate([c + rng.integers(-9, 9, (150, 5)) for c in centers])
    largest = float((vectors**2).sum(axis=1).max())
    tree = mtree.Tree(vectors, np.arange(len(vectors)), largest, page=16)

    def below(page):
        leaf, entries, _, _, child = tree.pages[page]
        return list(entries) if leaf else [r for c in child for r in below(c)]

    for leaf, entries, radius, _, child in tree.pages:
        for e, r, c in zip(entries, radius, child, strict=True):
            if not leaf:
                assert tree._to(np.array(below(c)), tree.points[e]).max() <= r + 1e-9
    assert sorted(below(len(tree.pages) - 1)) == list(range(len(vectors)))


# --- 7 ---------------------------------------------------------------------------


def _groups(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_bit_slices():
    rng = random.Random(0)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = np.array(base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [0, 2**64 - 1], np.uint64)
    planes = simhash.planes_of(values)
    for radius in (1, 2, 3, 4, 5, 7):
        masks = simhash.near_masks(values[:, None], planes, radius)
        for i, a in enumerate(values.tolist()):
            row = int.from_bytes(masks[i].astype("<u8").tobytes(), "little")
            for j, b in enumerate(values.tolist()):
                assert (row >> j & 1) == ((a ^ b).bit_count() <= radius)


def test_blocks_past_the_radius_are_abandoned():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**64, 1_024, dtype=np.uint64)
    values[700] = values[3] ^ np.uint64(5)
    planes = simhash.planes_of(values)
    # The first 64 against all words; of the first word only later positions.
    outside = np.zeros((64, 16), np.uint64)
    outside[:, 0] = [(2 << i) - 1 for i in range(64)]
    masks, steps = simhash.near_blocks(values[:64, None], planes, 3, outside)
    assert [(i, w, int(masks[i, w])) for i, w in zip(*np.nonzero(masks), strict=True)] == [(3, 10, 1 << 700 - 640)]
    # All planes of all blocks would be 65,536 steps.
    assert steps < 0.45 * masks.size * 64


def test_fingerprint_by_definition():
    rng = random.Random(6)
    texts = [None, "", " \t", "One", "one TWO", "a b c", "a\u00a0b c\x0bd", "\u00c4\u00d6 x y z", "a b c d " * 300]
    texts += [" ".join(rng.choices(["Aa", "b", "cc", "D", "\u00e9"], k=rng.randrange(1, 40))) for _ in range(60)]
    for text in texts:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles] if words else []
        expected = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) % 2**64 == expected


@pytest.mark.parametrize("size", [3, 64, 65, 300])
def test_links_span_their_groups(size):
    rng = random.Random(size)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({rng.choice(seeds) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for _ in range(size)})
    a, b = simhash.links_in_groups(np.zeros(len(values), np.int64), np.array(values, np.uint64))
    links = [(x % 2**64, y % 2**64) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert all((x ^ y).bit_count() <= 3 for x, y in links)
    expected = _groups(values)
    assert len(links) == len(values) - len(set(expected.values()))


@pytest.mark.parametrize("tile", [4, 4_096])
def test_every_link_is_found(spark, tile):
    rng = random.Random(9)
    values = set()
    for _ in range(30):
        seed = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 20)):
            seed ^= sum(1 << k for k in rng.sample(range(64), rng.randrange(4)))
            values.add(seed)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=tile)
    found = {r.node % 2**64: r.root % 2**64 for r in components.components(links).collect()}
    expected = _groups(values)
    for x, y in itertools.combinations(sorted(values), 2):
        assert (expected[x] == expected[y]) == (found.get(x, x) == found.get(y, y))


def test_near_duplicates_of_odd_rows(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by_id[1][0] == by_id[2][0] == by_id[2][1]
    assert {x for i in (4, 5, 6) for x in by_id[i]} == {("0" * 16, 4)}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in rows}
    assert kept.count() == len(groups) and {r.doc_id for r in kept.collect()} == groups
    assert simhash.keep_one(empty).count() == 0


def test_rows_without_ids(spark):
    table = spark.createDataFrame([(None, "same text here"), (None, "same text here"), (None, "quite another one")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(table).collect()) == ["quite another one", "same text here"]
    assert {r.component_id for r in simhash.near_duplicates(table).collect()} == {None}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1_000, i) for i in range(1_001, 1_300)] + [(5_000, 5_000), (6_000, 6_001), (6_001, 6_000)]
    rng.shuffle(links)
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{i: 1_000 for i in range(1_001, 1_300)}, 6_001: 6_000}


# --- 8 ---------------------------------------------------------------------------


def _one_by_one(lengths, capacities, overhead):
    """Best fit decreasing piece by piece."""
    bins, waiting = [], sum(lengths)
    for n in sorted(lengths, reverse=True):
        waiting -= n
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += n
        else:
            bins.append([packing._opening(n, waiting, capacities, overhead), n])
    return sorted(min(c for c in capacities if c >= used) for _, used in bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_of_bins(seed):
    rng = random.Random(seed)
    capacities = ((16,), (8, 16, 32), (5, 7, 64))[seed % 3]
    lengths = [min(capacities[-1], 1 + int(rng.expovariate(0.2))) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_bins(counts, capacities, 2)
    used, placed = {}, {n: set() for n in counts}
    ends = {n: sorted(plan.rank[plan.length == n].tolist()) + [counts[n]] for n in counts}
    for n, rank, first, start in zip(plan.length.tolist(), plan.rank.tolist(), plan.bin.tolist(), plan.start.tolist(), strict=True):
        stop = next(e for e in ends[n] if e > rank)
        for r in range(rank, stop):
            used.setdefault(first + r - rank, []).append((start, n))
            placed[n].add(r)
    assert all(len(placed[n]) == counts[n] for n in counts)
    sizes = []
    for b, parts in used.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == c for (a, n), (c, _) in itertools.pairwise(parts))
        size = int(plan.capacity[np.searchsorted(plan.first, b, side="right") - 1])
        assert sum(n for _, n in parts) <= size and size == min(c for c in capacities if c >= sum(n for _, n in parts))
        sizes.append(size)
    assert sorted(used) == list(range(plan.bins))
    if len(capacities) == 1:
        assert sorted(sizes) == _one_by_one(lengths, capacities, 2)
    else:
        assert sum(sizes) <= 1.02 * sum(_one_by_one(lengths, capacities, 2)) + capacities[-1]


def test_lengths_that_fit_nowhere():
    with pytest.raises(ValueError):
        packing.plan_bins({9: 1}, (8,))


def test_packing_of_odd_rows(docs, empty):
    rows = packing.pack_documents(docs, capacities=(16, 64)).collect()
    tokens = {}
    for r in docs.collect():
        tokens.setdefault(r.doc_id, []).append(len((r.text or "").encode().split()) + 1)
    found = {}
    for r in rows:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_tokens
    assert found == {k: sum(v) for k, v in tokens.items()}
    spans = {}
    for r in rows:
        spans.setdefault((r.bin_id, r.capacity), []).append((r.position, r.n_tokens))
    for (_, capacity), parts in spans.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and sum(n for _, n in parts) <= capacity
    assert len({b for b, _ in spans}) == len(spans)
    assert packing.pack_documents(empty).count() == 0


# --- 9 ---------------------------------------------------------------------------


def test_chances_add_up(spark, docs):
    learning = docs.select("text")
    counts, tokens, distinct = language_model.word_counts(learning)
    vocab = language_model.vocabulary(counts, tokens, distinct)
    model = language_model.train(spark, learning, vocab)
    table = 10 ** model.log_probabilities()
    assert np.allclose(table.sum(axis=2), 1.0)
    # Inside a class, all its words and one unknown have all its chance.
    inside = np.zeros(language_model.SYMBOLS)
    for r in counts.collect():
        word = bytes(r.word)
        place = vocab.places[word]
        symbol = vocab.symbols[place]
        if language_model.WORDS <= symbol < vocab.end:
            assert symbol == vocab.class_of(word)
            inside[symbol] += (r.n + 0.5) / 10 ** vocab.weight[symbol]
    for symbol in np.flatnonzero(inside):
        assert abs(inside[symbol] + 0.5 / 10 ** vocab.weight[symbol] - 1.0) < 1e-9


def _unigram(rows):
    counts, known = {}, {}
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    for i, words in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, words in tokens:
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        out.append((i, len(words), sum(w in counts for w in words), n, round(base, 6)))
    del known
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [0, 5, 150_000])
def test_unigram_score(docs, head, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", head)
    found = language_model.scored(docs).collect()
    expected = _unigram([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == expected
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)


def test_model_beats_the_unigram(spark, empty):
    rows = [r for r in QUERIES["op9_lm_scoring"](spark, SF_DIR).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert language_model.scored(empty).count() == 0


# --- 10 --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    parts = ["  ", " ", "the", "ation", "é", "日本", "\n", "\t", "🙂", "a", "b", "ing", "   ", "▁", "I", "s", "'", "1", "23", "。", "ß", "x" * 30]
    return ["", " ", "  a"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]


def test_ids_equal_the_library(spark, odd_texts):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    texts = odd_texts + [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    blob = piece_model()
    model, library = sentencepiece_ids.PieceModel(blob), SentencePieceProcessor(model_proto=blob)
    for text in texts:
        ids = model.encode(text).tolist()
        assert ids == library.encode(text) and model.decode(ids) == library.decode(ids)

    # The same pieces with other scores, as a unigram model.
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(blob)
    proto.trainer_spec.model_type = sentencepiece_ids.UNIGRAM
    rng = random.Random(7)
    for piece in proto.pieces:
        if piece.type == sentencepiece_ids.NORMAL:
            piece.score = -5.0 - 10.0 * rng.random()
    blob = proto.SerializeToString()
    model, library = sentencepiece_ids.PieceModel(blob), SentencePieceProcessor(model_proto=blob)
    for text in odd_texts:
        ids, other = model.encode(text).tolist(), library.encode(text)
        if ids != other:  # the library adds up in 32 bits: equal sums may go either way
            total = [sum(proto.pieces[i].score for i in x if proto.pieces[i].type == 1) for x in (ids, other)]
            assert abs(total[0] - total[1]) < 1e-3
        assert list(model.stream("▁" + text.replace(" ", "▁") if text else "")) == ids


def test_stream_keeps_a_bounded_window(odd_texts):
    model = sentencepiece_ids.PieceModel(piece_model())
    search, ids, widest = sentencepiece_ids._Search(model), [], 0
    text = "▁" + "▁".join(["internationalization", "abc日本", "zzzz"] * 300)
    for char in text:
        ids += search.read(char)
        widest = max(widest, len(search.text))
    assert ids + search.finish() == model.encode(text.replace("▁", " ")[1:]).tolist()
    assert widest <= 4 * model.longest


def test_round_trip_of_rows(docs, empty):
    rows = sentencepiece_ids.round_trip(docs, piece_model()).collect()
    assert len(rows) == docs.count() and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    assert sentencepiece_ids.round_trip(empty, piece_model()).count() == 0


# --- the pipeline ----------------------------------------------------------------


def test_pipeline_equals_its_stages(spark, docs, empty):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "best_fit_packing"]
    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = {r.doc_id for r in QUERIES["op5_quality_classifier"](spark, SF_DIR).where("predicted = 1").collect()}
    first = corpus_pipeline.quality_classifier(spark, source, SF_DIR)
    assert first.columns == source.columns and {r.doc_id for r in first.collect()} == good
    second = {r.row.doc_id for r in rules.judged(source.where(F.col("doc_id").isin(sorted(good)))).where("kept").collect()}
    third = {r.component_id for r in simhash.near_duplicates(source.where(F.col("doc_id").isin(sorted(second)))).collect()}
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == third
    texts = {r.doc_id: r.text for r in source.collect()}
    assert sum(r.n_tokens for r in packed) == sum(len(texts[i].encode().split()) + 1 for i in third)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0
        stage(spark, docs, SF_DIR).collect()


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert json.dumps(sorted(QUERIES))
