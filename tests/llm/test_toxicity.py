"""Toxicity against a brute-force version of terms, neighbours, votes and steps."""

import math
import random
import re
import zlib
from collections import Counter
from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import toxicity
from threadloom.llm.common import prepare
from threadloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


def brute_steps(votes):
    """Chance for each distinct vote: the largest average that starts at or before it, of the least that end at or after."""
    share = sum(y * w for _, y, w in votes) / sum(w for *_, w in votes)
    at = sorted({v for v, *_ in votes})
    sums = {v: (sum(y * w for u, y, w in votes if u == v), sum(w for u, _, w in votes if u == v)) for v in at}
    one = sum(w for *_, w in votes) / len(votes)
    pools = [[v, *sums[v]] for v in at]
    while True:
        for i in range(len(pools) - 1):
            if pools[i][1] / pools[i][2] >= pools[i + 1][1] / pools[i + 1][2]:
                _, a, b = pools.pop(i + 1)
                pools[i][1] += a
                pools[i][2] += b
                break
        else:
            return [(v, (a + one * share) / (b + one)) for v, a, b in pools]


def brute(docs, labels):
    """Scores of (doc_id, text) rows; everybody against all examples."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4
    words = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    marks = {}
    for i, toxic in labels:
        if i is not None and toxic is not None and fold(i) != 2:
            marks[i] = max(marks.get(i, 0), int(toxic > 0))
    texts = {}
    for i, t in docs:
        if i in marks:
            texts[i] = min(texts.get(i, t or ""), t or "")
    sizes = Counter(marks.values())
    drawn = Counter(marks[i] for i in texts)
    n, ones = len(texts), sum(marks[i] for i in texts)
    have, of_ones = Counter(), Counter()
    for i, t in texts.items():
        have.update(words(t).keys())
        if marks[i]:
            of_ones.update(words(t).keys())
    have = {t: k for t, k in have.items() if k >= 3}
    terms = []
    for t, k in have.items():
        # Chi-square of the table of four.
        a, b, c, d = of_ones[t], k - of_ones[t], ones - of_ones[t], n - ones - k + of_ones[t]
        rest = (a + b) * (c + d) * (a + c) * (b + d)
        phi = (a * d - b * c) ** 2 / rest if rest else 0.0
        if phi >= 0.01 and math.erfc(math.sqrt(n * phi / 2)) * len(have) < 0.01:
            terms.append(t)
    df = Counter(w for _, t in docs for w in words(t).keys() & set(terms))

    def vector(t):
        raw = {w: (1 + math.log(k)) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, k in words(t).items() if w in terms}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    vectors = {i: vector(t) for i, t in texts.items()}

    def vote(own, skip=None):
        near = sorted((-sum(x * v.get(w, 0.0) for w, x in own.items()), i) for i, v in vectors.items() if i != skip)
        # Equal vectors may differ in the last digit here.
        near = [(round(s, 12), i) for s, i in near if s < 0]
        near = sorted(near)[: toxicity.NEIGHBOURS]
        weight = [sizes[marks[i]] / drawn[marks[i]] / (max(0.0, 1 + s) + 0.05) for s, i in near]
        return sum(w for w, (_, i) in zip(weight, near, strict=True) if marks[i]) / sum(weight) if near else None

    voted = [(vote(v, i), marks[i], sizes[marks[i]] / drawn[marks[i]]) for i, v in vectors.items()]
    none = [(y, w) for v, y, w in voted if v is None]
    alone = sum(y * w for y, w in none) / (sum(w for _, w in none) + 1) if none else 0.0
    merged = [(round(v, 9), y, w) for v, y, w in voted if v is not None]
    steps = brute_steps(merged) if merged else []

    def chance(v):
        if v is None or not steps:
            return alone
        return next((c for u, c in reversed(steps) if u <= round(v, 9)), steps[0][1])

    return terms, [(i, fold(i) == 2, round(chance(vote(vector(t))), 6)) for i, t in docs]


def compared(spark, docs, labels):
    terms, expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.toxic) for r in labels.collect()])
    rows = toxicity.scored(docs, labels).collect()
    assert sorted(((r.doc_id, r.held_out, round(r.score, 6)) for r in rows), key=repr) == sorted(expected, key=repr)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    return terms, rows


def made(spark, n, seed):
    rng = random.Random(seed)
    plain = [f"word{chr(97 + i)}" for i in range(26)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randrange(5, 40))
        if toxic:
            words += rng.choices(["nasty", "vile", "foul", "Rotten"], k=rng.randrange(1, 4))
        elif rng.random() < 0.1:
            words.append("foul")
        docs.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, int(toxic if rng.random() < 0.95 else not toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_brute_force(spark, seed):
    docs, labels = made(spark, 300, seed)
    terms, rows = compared(spark, docs, labels)
    assert {"nasty", "vile", "rotten"} <= set(terms) < {"nasty", "vile", "rotten", "foul", *(f"word{chr(97 + i)}" for i in range(26))}
    assert any(r.evidence for r in rows) and any(r.predicted for r in rows)


def test_query_equals_brute_force(spark):
    terms, expected = brute(*([tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{t}.parquet").select("doc_id", c).collect()] for t, c in (("documents", "text"), ("labels", "toxic"))))
    rows = QUERIES["op12_toxicity"](spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.held_out, round(r.score, 6)) for r in rows) == sorted(expected)


def test_held_out_documents_are_told_apart(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert right >= 0.9 * len(rows)


def test_odd_rows(spark):
    docs, labels = made(spark, 120, 5)
    extra = [(None, None), (None, "vile vile"), (500, None), (501, ""), (502, "vile " * 300_000), (502, "nasty"), (502, "nasty"), (503, "🙂 日本 \x00 123 _")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    labels = labels.union(spark.createDataFrame([(None, 1), (500, None), (501, 1), (502, 1), (502, 0), (502, 0), (9_999, 1)], labels.schema))
    clash = ("label", "id", "terms", "counts", "score", "held_out", "evidence", "toxic", "term", "n")
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))
    _, rows = compared(spark, wide, labels)
    assert len(rows) == docs.count()
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.scored(docs, labels.withColumn("toxic", F.lit(None).cast("int"))).collect()} == {0.0}


@pytest.mark.parametrize("block", [1, 4, 64])
def test_nearest_over_blocks(block):
    rng = random.Random(block)
    vectors = []
    for _ in range(400):
        terms = np.array(sorted(rng.sample(range(30), rng.randrange(0, 6))), np.int64)
        weights = np.array([rng.choice([1.0, 2.0, 3.0]) for _ in terms])
        vectors.append((terms, weights / (np.sqrt((weights**2).sum()) or 1.0)))
    ids = np.array(rng.sample(range(10_000), 400), np.int64)
    index = toxicity.BlockMaxIndex(vectors, ids, block)
    for place, (terms, weights) in enumerate(vectors):
        query = dict(zip(terms.tolist(), weights.tolist(), strict=True))
        # The same products added up in the same order; sum() would round only once.
        owns = [dict(zip(t.tolist(), x.tolist(), strict=True)) for t, x in vectors]
        scores = [reduce(add, (w * own.get(term, 0.0) for term, w in query.items()), 0.0) for own in owns]
        for skip in (None, place):
            expected = sorted((-s, int(ids[i]), i) for i, s in enumerate(scores) if s > 0 and i != skip)[:7]
            found = index.nearest(terms, weights, 7, skip)
            assert [i for _, i in found] == [i for *_, i in expected]
            assert np.allclose([s for s, _ in found], [-s for s, *_ in expected])
    assert index.read < 2 * 400 * index.blocks * 0.8


@pytest.mark.parametrize("seed", range(5))
def test_steps_rise_and_equal_pooling(seed):
    rng = random.Random(seed)
    votes = [(round(rng.random(), 1), int(rng.random() < 0.4), rng.choice([1.0, 2.5])) for _ in range(60)]
    starts, chances = toxicity.isotonic(*map(list, zip(*votes, strict=True)))
    expected = brute_steps(votes)
    assert starts.tolist() == [v for v, _ in expected] and np.allclose(chances, [c for _, c in expected])
