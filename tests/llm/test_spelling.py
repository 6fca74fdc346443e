"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import spelling
from threadloom.llm.common import prepare


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def texts(seed, alphabet="abé", n=400):
    """Words of few letters, so that many are near, some very frequent."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(alphabet, k=rng.randrange(6, 10))) for _ in range(60)]
    rows = []
    for i in range(n):
        picked = [words[min(int(rng.expovariate(0.2)), 59)] for _ in range(30)]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w.capitalize() if rng.random() < 0.1 else w for w in picked)))
    return rows


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("bound", [spelling.GROUP_WORDS, 4, 1])
def test_variants_equal_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_WORDS", bound)
    rows = texts(bound)
    rows += [(1_000 + i, "kettledrum " * 8 + "kettledru " * (i % 2) + "kettledr" * (i < 2)) for i in range(50)]
    expected = brute(rows)
    assert any(r[1] for r in expected) and any(r[2] not in (r[0], r[1]) for r in expected)
    assert found(spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(5))) == expected


def test_variants_with_hot_groups_joined_by_salt(spark, skewed, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_WORDS", 8)
    rows = texts(9, n=100)
    assert found(spelling.variants(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    long = "internationalization " * 20_000 + "x" * 5_000 + " " + "x" * 4_999 + " " + "y" + "x" * 4_999
    rows = [
        (1, None), (2, ""), (None, "Nothing nothing NOTHING nothinG nothink nothink"), (None, None), (3, long), (3, long),
        (4, "Größere größere GRÖSSERE ×××÷÷÷÷ ×××÷÷÷÷ nothing's nothing_nothing 1nothing2"), (5, "🙂nothing日本nothing\x00nothing"),
    ]
    rows += [(i, f"Text number {i} of " + "communication comunication " * 5) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(i).alias(c) for i, c in enumerate(("word", "n", "key", "run", "id", "size", "path", "group"))))
    assert found(spelling.variants(docs)) == brute(rows)
    assert spelling.variants(docs.limit(0)).count() == 0
    assert spelling.variants(docs.where("doc_id = 2")).count() == 0


def test_words_in_one_group_hold_a_third(spark):
    """One beginning with very many words: groups are cut until they are within the bound, and lose nobody."""
    rng = random.Random(3)
    words = {"national" + "".join(rng.choices("abcd", k=rng.randrange(3, 6))): 2 for _ in range(600)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    tables, rows = spelling.grouped(table, 20, spelling.GROUP_LETTERS)
    kept = tables[0]
    for other in tables[1:]:
        kept = kept.unionByName(other)
    paths = {r.path for r in kept.select("path").distinct().collect()}
    assert max(map(len, paths)) > 2
    counted = kept.groupBy("group", "path", "size").count().collect()
    assert all(r["count"] <= 20 for r in counted if spelling.bounds(r["size"], r["path"])[0] + spelling.bounds(r["size"], r["path"])[1] < r["size"] - 1)
    pairs = [tuple(r) for r in spelling.near_words(table, 20).select("word", "near").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_apart(a, b)}


@pytest.mark.parametrize("seed", range(8))
def test_index_finds_all_three_errors(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(300)}, key=lambda w: rng.random())
    index = spelling.PositionIndex(words)
    for length in range(1, 7):
        rows = np.flatnonzero(index.lengths == length)
        if len(rows):
            low, high = rng.randrange(0, 50), rng.randrange(60, len(words) + 1)
            left, right = index.near(rows, low, high)
            pairs = list(zip(left.tolist(), right.tolist(), strict=True))
            assert len(set(pairs)) == len(pairs)
            assert set(pairs) == {(int(i), j) for i in rows for j in range(low, high) if one_apart(words[i], words[j])}
