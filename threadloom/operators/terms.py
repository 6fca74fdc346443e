"""Terms of texts: word and word-pair counts, and TF-IDF weights.

A vocabulary is fitted with grouped counts and ends as at most a few thousand
rows. Vectors are then made by Spark ML transformers.
"""

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import WORD_CHARACTER
from threadloom.operators.joins import sized_join
from threadloom.sources.tables import materialize

# Steps of the histogram of counts to a doubling.
_STEPS = 8
WORD = WORD_CHARACTER + "{2,}"
_SQL_WORD = WORD.replace("\\", "\\\\")


_PAIRS = (
    "concat(_words, zip_with(slice(_words, 1, greatest(size(_words) - 1, 0)),"
    " slice(_words, 2, greatest(size(_words) - 1, 0)), (a, b) -> concat(a, ' ', b)))"
)


def _word_stages(text: str, stop_words: list[str] | None) -> list:
    words = "_words" if stop_words is None else "_all_words"
    stages = [
        SQLTransformer(
            statement=f"SELECT *, regexp_extract_all(lower(coalesce({text}, '')), '{_SQL_WORD}', 0) AS {words}"
            " FROM __THIS__"
        )
    ]
    if stop_words is not None:
        stages.append(StopWordsRemover(inputCol=words, outputCol="_words", stopWords=stop_words))
    return stages


def term_stages(text: str = "text", stop_words: list[str] | None = None) -> list:
    """Transformers from ``text`` to ``terms``: lower-case words of two or more
    characters, less stop words, then pairs of the words that are left."""
    return _word_stages(text, stop_words) + [SQLTransformer(statement=f"SELECT *, {_PAIRS} AS terms FROM __THIS__")]


def _scratch_columns(stop_words: list[str] | None) -> str:
    return "_words" + (", _all_words" if stop_words is not None else "")


def with_terms(df: DataFrame, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """Adds ``terms``. The stages learn nothing, so they are only chained."""
    drop = SQLTransformer(statement=f"SELECT * EXCEPT ({_scratch_columns(stop_words)}) FROM __THIS__")
    return PipelineModel(stages=term_stages(text, stop_words) + [drop]).transform(df)


def terms_without(df: DataFrame, key: str, stops: DataFrame, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """(key, terms) without the words of a table ``stops`` (word) as well.

    The table may be of any size. What is shuffled is one row per text and stop
    word in it; a text comes together with its own stop words only. ``key`` is unique.
    """
    worded = PipelineModel(stages=_word_stages(text, stop_words)).transform(df.select(key, text)).select(key, "_words")
    each = worded.select(key, F.explode(F.array_distinct("_words")).alias("_word"))
    listed = stops.select(F.col("word").alias("_stop")).where(F.col("_stop").isNotNull()).distinct()
    met = sized_join(each, listed, "_word", "_stop", "left_semi", F.struct(key, "_word"))
    by_text = met.groupBy(F.col(key).alias("_text")).agg(F.collect_set("_word").alias("_met"))
    joined = sized_join(worded, by_text, key, "_text", "left", F.col(key))
    kept = F.when(F.col("_met").isNull(), F.col("_words")).otherwise(
        F.filter("_words", lambda word: ~F.array_contains("_met", word))
    )
    return joined.select(key, kept.alias("_words")).select(key, F.expr(_PAIRS).alias("terms"))


def run_starts(ordered: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Where runs of ``same`` neighbours begin in an ordered array, from 1; NULL for an empty one.

    ``ordered`` has to be a column and no longer expression, which would be worked out for every element.
    """
    first = F.filter(
        F.sequence(F.lit(1), F.size(ordered)), lambda at: (at == 1) | ~same(F.get(ordered, at - 1), F.get(ordered, at - 2))
    )
    return F.when(F.size(ordered) > 0, first)


def run_length(ordered: Column, starts: Column, at: Column, place: Column) -> Column:
    """Length of the run that begins ``at`` and is the one at ``place``, from 0."""
    return F.coalesce(F.get(starts, place + 1), F.size(ordered) + 1) - at


def counted_terms(termed: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``counts``, the distinct terms of a text with their counts (term, n); NULL for a text without terms.

    A text is counted by itself: its terms are sorted and the runs measured, nothing is shuffled.
    """
    ordered = termed.select(*columns, F.sort_array("terms").alias("_sorted"))
    begun = ordered.select(*columns, "_sorted", run_starts(F.col("_sorted"), lambda a, b: a == b).alias("_starts"))
    counts = F.transform(
        "_starts",
        lambda at, place: F.struct(
            F.get("_sorted", at - 1).alias("term"),
            run_length(F.col("_sorted"), F.col("_starts"), at, place).cast("bigint").alias("n"),
        ),
    )
    return begun.select(*columns, counts.alias("counts"))


def entries(lists: DataFrame, counts: str, *columns: str) -> DataFrame:
    """A row for each struct in the array ``counts``.

    The outer form, since for the inner one Spark puts a filter before it that works the array out again.
    """
    rows = lists.select(*columns, F.inline_outer(counts))
    return rows.where(F.col(rows.columns[-1]).isNotNull())


def term_table(termed: DataFrame, size: int, min_df: int, max_df: float = 1.0) -> DataFrame:
    """Commonest terms with corpus count, document count and weight.

    Each document sends its distinct terms with their counts, so one
    grouping by term gives both counts. It combines map-side: what is shuffled
    is one row per task and distinct term, and a term in every document is not
    hot. Equal counts are ordered by term. The weight is
    ln((1 + documents) / (1 + df)) + 1.
    """
    documents = termed.agg(F.count(F.lit(1)).alias("documents")).scalar()
    counted = (
        entries(counted_terms(termed), "counts")
        .groupBy("term")
        .agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
        .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * documents))
        .withColumn("idf", F.log((documents + 1) / (F.col("df") + 1)) + 1)
        .withColumn("_step", F.floor(F.log2("tf") * _STEPS).cast("int"))
    )
    # Where the cut lies comes from a histogram of a few hundred steps. Only terms from that step on are
    # sorted, not the best ``size`` of every task.
    counted = materialize(counted, "terms")
    above = Window.orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = counted.groupBy("_step").agg(F.count(F.lit(1)).alias("n"))
    cut = steps.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("before") < size)
    least = cut.agg(F.coalesce(F.min("_step"), F.lit(0))).scalar()
    return counted.where(F.col("_step") >= least).drop("_step").orderBy(F.col("tf").desc(), F.col("term")).limit(size)


def fit_tfidf(
    df: DataFrame,
    text: str,
    size: int,
    min_df: int,
    max_df: float = 1.0,
    stop_words: list[str] | None = None,
    output: str = "features",
) -> PipelineModel:
    """Fitted pipeline from text to unit-length TF-IDF vectors.

    The driver holds the ``size`` vocabulary rows, and no more.
    """
    stages = weight_stages(with_terms(df.select(text), text, stop_words), size, min_df, max_df, output)
    drop = SQLTransformer(
        statement=f"SELECT * EXCEPT ({_scratch_columns(stop_words)}, terms, _counts, tfidf) FROM __THIS__"
    )
    # Every stage is fitted already; this only chains them.
    return PipelineModel(stages=term_stages(text, stop_words) + stages + [drop])


def weight_stages(termed: DataFrame, size: int, min_df: int, max_df: float = 1.0, output: str = "features") -> list:
    """Fitted transformers from ``terms`` to unit-length TF-IDF vectors."""
    vocabulary = term_table(termed.select("terms"), size, min_df, max_df).select("term", "idf").collect()
    if not vocabulary:
        raise ValueError(f"no term occurs in {min_df} texts or more")
    counts = CountVectorizerModel.from_vocabulary(
        [row.term for row in vocabulary], inputCol="terms", outputCol="_counts"
    )
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([row.idf for row in vocabulary]), inputCol="_counts", outputCol="tfidf"
    )
    return [counts, scale, Normalizer(p=2.0, inputCol="tfidf", outputCol=output)]


def vocabulary_of(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary
