"""Quality rules on documents and on their hosts, in built-in expressions alone.

Every text is measured once. Rule failures are counted per host, map-side, and
the failure rate of a host is shrunk towards the rate of all hosts with a beta
prior whose mean and weight are fitted to the hosts themselves (method of
moments). A host fails when more than ``HOST_LIMIT`` of its documents may be
expected to break one of the rules, and its verdict goes back to its documents.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import BLANKS
from threadloom.operators.joins import sized_join
from threadloom.sources.tables import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
# Share of a host's documents that may break a rule.
HOST_LIMIT = 0.5
# Weight of the prior, in documents: at least, and where hosts do not differ.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1_000.0

# Rules on a document: true where it breaks the rule.
RULES = {
    "base": f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_starts(words: Column) -> Column:
    """Sorted places of the 3-word windows that come twice or more in the text.

    Windows are compared by 64-bit hash: sorted by hash, equal ones are
    neighbours. Cost is n log n in the words of one text, with no shuffle.
    """
    hashed = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda at: F.struct(
                F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2)).alias("h"),
                at.alias("at"),
            ),
        )
    )

    def repeated(sorted_windows: Column) -> Column:
        def twice(window: Column, at: Column) -> Column:
            return (window["h"] == F.get(sorted_windows, at - 1)["h"]) | (
                window["h"] == F.get(sorted_windows, at + 1)["h"]
            )

        return F.array_sort(F.transform(F.filter(sorted_windows, twice), lambda window: window["at"]))

    return F.when(F.size(words) >= 3, _bind(hashed, repeated)).otherwise(F.array().cast("array<int>"))


def _covered(starts: Column) -> Column:
    """Words inside windows of three that start at the given places."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda seen, at: F.struct(
            (seen["n"] + F.least(F.lit(3), at - seen["last"])).alias("n"), at.alias("last")
        ),
        lambda seen: seen["n"],
    )


def measures(text: Column) -> Column:
    """Struct of the measures of a whole text; NULL counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANKS, -1), lambda word: word != "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        _bind(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                _covered(_repeated_starts(w)).cast("long").alias("n_repeat_words"),
            ),
        ).alias("words"),
        _bind(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("lines"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    )


def measured(docs: DataFrame, text: str = "text", host: str = "source", keep: Column | None = None) -> DataFrame:
    """One row per document: ``row`` (``keep``, or all its columns), host, measures and a flag per rule."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if keep is None else keep
    flat = docs.select(
        row.alias("row"), F.col(f"`{host}`").cast("string").alias("host"), measures(F.col(f"`{text}`")).alias("m")
    ).select("row", "host", "m.words.*", "m.lines.*", "m.word_chars", "m.n_symbols")
    return flat.select("*", *(F.expr(rule).alias(f"fails_{name}") for name, rule in RULES.items()))


def failing_hosts(rows: DataFrame) -> DataFrame:
    """Hosts whose shrunk failure rate is over the limit for one rule: ``bad_host``."""
    hosts = (
        rows.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *(F.sum(F.col(f"fails_{name}").cast("long")).alias(name) for name in RULES),
        )
    )
    total = F.sum("n")
    prior = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        total.alias("n"),
        *(F.sum(name).alias(name) for name in RULES),
        # Second moment of the hosts' rates, each host by its documents.
        *(F.sum(F.col(name) * F.col(name) / F.col("n")).alias(f"{name}_square") for name in RULES),
    )
    fitted = prior.select(
        F.struct(
            *(
                column
                for name in RULES
                for column in (
                    (F.col(name) / F.col("n")).alias(f"{name}_mean"),
                    _weight(name).alias(f"{name}_weight"),
                )
            )
        ).alias("prior")
    ).scalar()
    judged = hosts.withColumn("prior", fitted)
    over = [
        (F.col(name) + F.col(f"prior.{name}_mean") * F.col(f"prior.{name}_weight"))
        / (F.col("n") + F.col(f"prior.{name}_weight"))
        > HOST_LIMIT
        for name in RULES
    ]
    any_over = over[0]
    for test in over[1:]:
        any_over = any_over | test
    return judged.where(any_over).select(F.col("host").alias("bad_host"))


def _weight(name: str) -> Column:
    """Documents that the beta prior counts for: m (1 - m) / variance - 1, where
    the variance of the hosts' rates is taken without their sampling noise."""
    mean = F.col(name) / F.col("n")
    noise = mean * (1 - mean)
    variance = F.col(f"{name}_square") / F.col("n") - mean * mean - noise * F.col("hosts") / F.col("n")
    fitted = noise / variance - 1
    return (
        F.when(variance <= 0, F.lit(MOST_WEIGHT))
        .when(fitted < LEAST_WEIGHT, F.lit(LEAST_WEIGHT))
        .when(fitted > MOST_WEIGHT, F.lit(MOST_WEIGHT))
        .otherwise(fitted)
    )


def judged(docs: DataFrame, text: str = "text", host: str = "source", keep: Column | None = None) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document.

    NULL and empty texts have no words and fail. A NULL host has no verdict,
    its documents stand by themselves. Repeated rows are judged each. Columns
    of the input are inside ``row``, so none of their names can clash.
    The measures are written once; failing hosts are broadcast if they are few, and
    joined by salted key if not.
    """
    rows = materialize(measured(docs, text, host, keep), "measured")
    bad = failing_hosts(rows)
    spread = F.struct("n_words", "word_chars", "n_repeat_words", "n_symbols")
    return sized_join(rows, bad, "host", "bad_host", "left", spread).select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("fails_base").alias("base_failed"),
        (~F.col("fails_base") & F.col("bad_host").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judged(docs, text, host).where("kept").select("row.*")
