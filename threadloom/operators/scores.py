"""TF-IDF weights and linear scores as tables.

A text is rows (key, term, weight), a model is one row per term with a
coefficient for every class, and scoring is a join by term and a sum by key.
Everything is visible to SQL, and works without a fitted pipeline at hand.
"""

import json
import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, IndexToString
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators.joins import sized_join
from threadloom.operators.terms import counted_terms, entries, term_table, vocabulary_of, with_terms
from threadloom.sources.tables import materialize, materialize_counted


def _by_repeats(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key comes once, and the others (None if there are none). Only ids are shuffled; a NULL key counts as repeated."""
    repeated = df.groupBy(F.col(key).alias("_again")).count().where((F.col("count") > 1) | F.col("_again").isNull()).select("_again")
    repeated, found = materialize_counted(repeated, "repeated-keys", rows=F.count(F.lit(1)))
    if not found["rows"]:
        return df, None
    marked = sized_join(df, repeated.where(F.col("_again").isNotNull()), key, "_again", "left")
    again = F.col(key).isNull() | F.col("_again").isNotNull()
    return marked.where(~again).drop("_again"), marked.where(again).drop("_again")


@dataclass
class TermCounts:
    """How often terms come in the texts of each key.

    ``lists`` (key, counts) has a row for each key of one text. Keys of several
    texts are in ``table`` (key, term, n), if there are any.
    """

    key: str
    lists: DataFrame
    table: DataFrame | None


def term_lists(df: DataFrame, key: str, text: str = "text", stop_words: list[str] | None = None) -> TermCounts:
    """Counts of every text; a text whose key comes once is counted in its row and not shuffled."""
    once, again = _by_repeats(df.select(key, text), key)
    lists = counted_terms(with_terms(once, text, stop_words), key)
    if again is None:
        return TermCounts(key, lists, None)
    each = entries(counted_terms(with_terms(again, text, stop_words), key), "counts", key)
    return TermCounts(key, lists, each.groupBy(key, "term").agg(F.sum("n").alias("n")))


def term_counts(df: DataFrame, key: str, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """(key, term, n) of every text; only texts of one key that come in several rows are shuffled."""
    found = term_lists(df, key, text, stop_words)
    rows = entries(found.lists, "counts", key)
    return rows if found.table is None else rows.unionByName(found.table)


@dataclass
class TermVectors:
    """Known terms of every key as one row: ``rows`` (key, places, counts, weights).

    Keys without known terms have empty lists and NULL weights. ``terms`` has the term of each place, at most the rows a model keeps. The weights have unit length.
    """

    key: str
    rows: DataFrame
    terms: list[str]

    def named(self, entries: DataFrame) -> DataFrame:
        """``entries`` with the term instead of its place."""
        words = F.split(F.lit("\n".join(self.terms)), "\n")
        return entries.withColumn("place", F.get(words, F.col("place"))).withColumnRenamed("place", "term")

    def triples(self) -> DataFrame:
        """(key, term, weight)."""
        each = F.arrays_zip(F.col("places").alias("place"), F.col("weights").alias("weight"))
        return self.named(entries(self.rows.select(self.key, each.alias("_each")), "_each", self.key))


def tfidf_vectors(df: DataFrame, vocabulary: DataFrame, key: str, text: str = "text") -> TermVectors:
    """Counts and weights of the terms of ``vocabulary`` in the texts of every key.

    A text whose key comes once is looked up and weighted in its row, without
    a shuffle. ``vocabulary`` has term and idf, and the driver holds it as it does when it fits a model.
    """
    known = sorted((row["term"], row["idf"]) for row in vocabulary.select("term", "idf").collect())
    terms, idf = [term for term, _ in known], F.from_json(F.lit(json.dumps([w for _, w in known])), "array<double>")
    once, again = _by_repeats(df.select(key, text), key)
    if not terms:
        none = once.select(key, *(F.array().cast(f"array<{t}>").alias(c) for c, t in (("places", "int"), ("counts", "double"), ("weights", "double"))))
        return TermVectors(key, none.where("false"), terms)
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="_found").transform(with_terms(once, text))
    rows = counted.select(key, F.unwrap_udt("_found").alias("_found")).select(
        key, F.col("_found.indices").alias("places"), F.col("_found.values").alias("counts")
    )
    if again is not None:
        places = vocabulary.sparkSession.createDataFrame(list(enumerate(terms)), "_place int, term string")
        each = entries(counted_terms(with_terms(again, text), key), "counts", key).join(F.broadcast(places), "term")
        # A key has at most as many places as there are terms.
        by_key = each.groupBy(key, "_place").agg(F.sum("n").cast("double").alias("_n")).groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("_place", "_n"))).alias("_all")
        )
        rows = rows.unionByName(by_key.select(key, F.col("_all._place").alias("places"), F.col("_all._n").alias("counts")))
    # No filter on what is worked out here: Spark would put it first and work that out twice.
    raw = rows.withColumn("_raw", F.zip_with("places", "counts", lambda at, n: n * F.get(idf, at)))
    measured = raw.withColumn("_length", F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda total, w: total + w * w)))
    # Two uses keep the length a column; it would else be worked out for every element.
    weights = F.when(F.col("_length") > 0, F.transform("_raw", lambda w: w / F.col("_length")))
    return TermVectors(key, measured.select(key, "places", "counts", weights.alias("weights")), terms)


def tfidf_triples(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) with unit length for each key.

    ``vocabulary`` has term and idf and is at most the rows a model keeps. A
    text has as many rows as it has known terms, so the window of one text is small;
    texts without known terms have none.
    """
    weighted = counts.join(F.broadcast(vocabulary.select("term", "idf")), "term").withColumn("_w", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("_w") / length).alias("weight"))


@dataclass
class LinearModel:
    """``coefficients`` (term, weights) with one weight for each of ``classes``, and their intercepts."""

    classes: list[str]
    intercepts: list[float]
    coefficients: DataFrame


def fitted_model(spark: SparkSession, model: PipelineModel) -> LinearModel:
    """The table form of a fitted text classifier: a row per term of its vocabulary."""
    regression = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    classes = next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()
    matrix = regression.coefficientMatrix.toArray()
    rows = [(term, matrix[:, at].tolist()) for at, term in enumerate(vocabulary_of(model))]
    return LinearModel(
        list(classes), regression.interceptVector.toArray().tolist(),
        spark.createDataFrame(rows, "term string, weights array<double>"),
    )


def word_odds(counts: DataFrame | TermVectors, labels: DataFrame, key: str, label: str) -> LinearModel:
    """Multinomial naive Bayes as a linear model: log chances of terms in a class, with one added to each count.

    ``counts`` is (key, term, n) over the terms to use, ``labels`` (key, label) without NULL labels.
    Vectors go to the labels as one short row a key.
    """
    # One row per class.
    shares = sorted((r[0], r[1]) for r in labels.groupBy(label).count().collect())
    classes = [name for name, _ in shares]
    total = sum(n for _, n in shares)
    if isinstance(counts, TermVectors):
        each = F.arrays_zip(F.col("places").alias("place"), F.col("counts").cast("array<bigint>").alias("n"))
        joined = counts.rows.select(key, "places", "counts").join(labels.select(key, label), key)
        labelled, term = entries(joined.select(label, each.alias("_each")), "_each", label), "place"
    else:
        labelled, term = counts.join(labels.select(key, label), key), "term"
    per_class = [F.sum(F.when(F.col(label) == name, F.col("n")).otherwise(0)) for name in classes]
    by_term = labelled.groupBy(term).agg(F.array(*per_class).alias("_counts"))
    by_term = materialize(counts.named(by_term) if isinstance(counts, TermVectors) else by_term, "class-terms")
    sums = by_term.agg(
        F.count(F.lit(1)).alias("terms"), *(F.sum(F.col("_counts")[i]).alias(f"n{i}") for i in range(len(classes)))
    ).first()
    whole = F.array(*(F.lit(float((sums[f"n{i}"] or 0) + sums["terms"])) for i in range(len(classes))))
    weights = F.transform("_counts", lambda n, i: F.log((n + 1) / F.get(whole, i)))
    return LinearModel(classes, [math.log(n / total) for _, n in shares], by_term.select("term", weights.alias("weights")))


def class_scores(triples: DataFrame, model: LinearModel, key: str) -> DataFrame:
    """(key, scores): the sum of weight times coefficient for every class, for keys with known terms."""
    known = triples.join(F.broadcast(model.coefficients), "term")
    sums = [F.sum(F.col("weight") * F.col("weights")[i]) for i in range(len(model.classes))]
    return known.groupBy(key).agg(F.array(*sums).alias("scores"))


def predicted(df: DataFrame, triples: DataFrame, model: LinearModel, key: str, output: str = "prediction") -> DataFrame:
    """``df`` with the class of the highest score, the first class among equals, and that score.

    A row without known terms goes by the intercepts alone.
    """
    scored = class_scores(triples, model, key).withColumnRenamed(key, "_key")
    intercepts = F.array(*map(F.lit, model.intercepts))
    full = F.when(F.col("scores").isNull(), intercepts).otherwise(F.zip_with("scores", intercepts, lambda s, b: s + b))
    joined = df.join(scored, F.col(key) == F.col("_key"), "left").withColumn("_scores", full)
    best = F.array_max("_scores")
    at = F.array_position(F.col("_scores"), best).cast("int")
    return joined.select(
        *df.columns, F.element_at(F.array(*map(F.lit, model.classes)), at).alias(output), best.alias(f"{output}_score")
    )


def hashed_vectors(counts: DataFrame, key: str, dimensions: int = 384) -> DataFrame:
    """(key, vector): counts of terms hashed to dimensions, as unit vectors of doubles.

    Place and sign come from the MD5 sum of the term, so any engine can
    recompute them: the first 7 hex digits modulo ``dimensions``, and plus where the eighth is even.
    A term counts 1 + ln(n). Texts without terms, and those whose terms cancel out, are left out.
    """
    digest = F.md5(F.col("term").cast("binary"))
    place = (F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % dimensions).cast("int")
    sign = F.when(F.conv(F.substring(digest, 8, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = (
        counts.select(key, place.alias("_at"), (sign * (1.0 + F.log("n"))).alias("_v"))
        .groupBy(key, "_at")
        .agg(F.sum("_v").alias("_v"))
    )
    by_key = sums.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_values"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_length")
    )

    def value(at: Column) -> Column:
        return F.coalesce(F.try_element_at("_values", at), F.lit(0.0)) / F.col("_length")

    return by_key.where("_length > 0").select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), value).alias("vector"))


def vocabulary(df: DataFrame, text: str, size: int, min_df: int, max_df: float = 1.0) -> DataFrame:
    """Terms that a model keeps, with their idf; at most ``size`` rows."""
    return materialize(term_table(with_terms(df.select(text), text), size, min_df, max_df).select("term", "idf"), "vocabulary")
