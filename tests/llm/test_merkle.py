"""The Merkle manifest against a plain walk over lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle
from threadloom.llm.common import prepare


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    prepare(spark)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree_of(digests):
    """Root, and for each place its siblings (before, after) a level, from below."""
    proofs, places, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for proof, at in zip(proofs, places, strict=True):
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            proof.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        places = [at // 16 for at in places]
    return level[0], proofs


def brute(rows):
    """Rows of checked_documents for (doc_id, source, lang, n_chars, text)."""
    lower = {c: c + 32 for c in range(65, 91)}
    trees = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        changed = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            changed = leaf_of(doc_id, source, lang, n_chars, text.translate(lower))
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: (sorted(trees[s]), *tree_of([r[2] for r in sorted(trees[s])])) for s in names}
    root, above = tree_of([made[s][1] for s in names])
    out = []
    for source, top in zip(names, above, strict=True):
        leaves, subroot, proofs = made[source]
        for (_, _, leaf, changed, doc_id), proof in zip(leaves, proofs, strict=True):
            folded, path = changed, proof + top
            for before, after in path:
                folded = sha(before + folded + after)
            out.append((doc_id, leaf, subroot, root, sha("".join(b + a for b, a in path)), folded, folded == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [
    (1, "a", "en", 5, "Hello"), (1, "a", "en", 5, "Hello"), (2, "b", None, None, None), (3, None, "de", 0, ""),
    (None, None, None, None, None), (None, "a", "fr", 3, "ABC"), (4, "", "en", 7, "Ünï 🙂日本"), (5, "é", "en", 1, "\x00"),
    (6, "z\U0001f642", "en", 1, "X" * 100_000), (7, "z￿", "en", 1, "Q"), (8, "a", "en", 2, "- 1:"),
]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("many", [0, 1, 16, 17, 257])
def test_documents_equal_a_plain_walk(spark, many):
    rows = ODD + [(100 + i * 7 % many, "hot", "en", i, f"Text {i % 5}") for i in range(many)]
    rows += [(1_000 + i, f"host{i}", "en", i, "ONE") for i in range(many // 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = rows_of(merkle.checked_documents(docs))
    assert found == brute(rows)
    assert any(not row[-1] for row in found) and any(row[-1] for row in found)


def test_trees_of_several_units(spark, monkeypatch):
    """Units of 16 nodes give several bands; one tree has most of the rows."""
    monkeypatch.setattr(merkle, "BAND", 1)
    monkeypatch.setattr(merkle, "UNIT", 16)
    monkeypatch.setattr(merkle, "TASK_ROWS", 100)
    rows = [(i, "hot" if i % 3 else f"s{i % 30}", "en", i, f"T{i}") for i in range(700)]
    assert rows_of(merkle.checked_documents(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_trees_with_hot_groups_joined_by_salt(spark, skewed):
    rows = [(i, "hot" if i % 3 else None, "en", i, f"T{i}") for i in range(90)]
    assert rows_of(merkle.checked_documents(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_whole_unit_in_one_sweep():
    digests = [sha(str(i)) for i in range(4_096)]
    root, proofs = tree_of(digests)
    children = merkle.sweep_up(digests, 3)
    assert sha("".join(children[4_096, 3])) == root
    top = (("x", "y"),)
    assert merkle.sweep_down(children, 4_096, 3, top) == [tuple(p) + top for p in proofs]


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    assert merkle.checked_documents(docs.limit(0)).count() == 0
    clash = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("tree", "at", "digest", "n", "row", "proof", "root", "unit", "key"))))
    assert rows_of(merkle.checked_documents(clash)) == brute(ODD)
    made = merkle.manifest(clash.withColumn("leaf", F.sha2("text", 256)).where("text is not null"), "tree", "lang", "leaf")
    assert {"row", "subroot", "proof"} == set(made.proofs().columns) and made.proofs().count() == 9
    assert merkle.manifest(clash.limit(0), "doc_id", "source", "text").root is None


def test_documents_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(merkle.checked_documents(docs)) == brute(rows)
