"""NFKC is worked out once a text, for texts that may change only."""

import re
import sys
import unicodedata

from pyspark.sql import functions as F

from threadloom.functions.text import SETTLED, normalized
from threadloom.operators.clean import kept_rows, with_clean_text


def evaluations(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"ArrowEvalPython \[", plan.split("== Initial Plan ==")[-1]))


def test_a_filter_does_not_normalise_again(spark):
    rows = [(1, "the ﬁrst"), (2, "  \u2003 "), (3, None), (4, ""), (5, "won’t"), (6, "\u3000")]
    df = spark.createDataFrame(rows, "tweet_id int, text string").repartition(2)
    kept = kept_rows(with_clean_text(df))
    assert evaluations(kept) == 1
    assert {r.tweet_id: r.text_clean for r in kept.collect()} == {1: "the first", 5: "won’t"}
    assert evaluations(with_clean_text(df).select("tweet_id")) == 0


def test_settled_texts_stay_in_the_jvm(spark):
    texts = ["won’t — né ’", "Київ", "e\u0301", "か\u3099", "№ ５", "가\u11a8", "a\nb", "\U0001f600 ok", None, "½ é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: r.t for r in df.select("id", normalized(F.col("text")).alias("t")).collect()}
    wanted = {i: t and " ".join(unicodedata.normalize("NFKC", t).split()) for i, t in enumerate(texts)}
    assert found == wanted
    plan = df.select(normalized(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan[plan.index("ArrowEvalPython") :]


def test_settled_characters():
    """Each is its own NFKC form, starts a character and composes with none before it."""
    kind = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), SETTLED) + "]")
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    settled = {c for c in every if kind.match(c)}
    assert len(settled) > 30_000
    seconds = {chr(int(d[1], 16)) for c in every if len(d := unicodedata.decomposition(c).split()) == 2 and "<" not in d[0]}
    vowels = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    assert not settled & (seconds | vowels)
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in settled)
