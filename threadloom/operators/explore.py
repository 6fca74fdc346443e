"""Exploratory clusters of ticket texts: what people write about.

Works on all tickets: terms are counted, the matrix is reduced and clusters are found
by Spark, and the driver holds the vocabulary. A fixed sample, exact and
distributed, is an option for a quick look; every ticket that takes part gets a cluster.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import constants as C
from threadloom.functions.text import without_ids
from threadloom.operators.split import fixed_sample
from threadloom.operators.terms import terms_without, vocabulary_of, weight_stages
from threadloom.sources.tables import materialize, materialize_counted


def brand_words(tickets: DataFrame) -> DataFrame:
    """The brand names, which say who is written to and not about what."""
    return tickets.where(F.col("brand_id").isNotNull()).select(F.lower("brand_id").alias("word")).distinct()


def reduced(vectors: DataFrame, components: int) -> tuple[DataFrame, float]:
    """Uncentred SVD: ``reduced`` of unit length, and the explained variance.

    The matrix of right singular vectors has one row per term (5,000 at most)
    and goes to the tasks with the function.
    """
    rows = MLUtils.convertVectorColumnsFromML(vectors.select("features"), "features")
    singular = RowMatrix(rows).computeSVD(components).V.toArray()

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [np.asarray(v) @ singular[np.asarray(i)] for i, v in zip(batch["indices"], batch["values"])]
            )

    projected = materialize(vectors.withColumn("_projected", project("features")), "explore-projected").withColumn(
        "_lsa", array_to_vector("_projected")
    )

    def total_variance(column: str) -> float:
        variance = projected.select(Summarizer.variance(F.col(column)).alias("v"))
        return variance.select(
            F.aggregate(vector_to_array("v"), F.lit(0.0), lambda total, x: total + x)
        ).first()[0]

    explained = total_variance("_lsa") / total_variance("features")
    unit = Normalizer(p=2.0, inputCol="_lsa", outputCol="reduced").transform(projected)
    return unit.drop("_projected", "_lsa"), explained


def cluster(vectors: DataFrame, clusters: int, restarts: int, seed: int = C.SEED) -> DataFrame:
    """Adds ``cluster_id`` from the best of several starts."""
    best = None
    for start in range(restarts):
        model = KMeans(
            k=clusters, seed=seed + start, featuresCol="reduced", predictionCol="cluster_id"
        ).fit(vectors)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(vectors)


def cluster_terms(clustered: DataFrame, vocabulary: list[str], top: int = C.EXPLORE_TOP_TERMS) -> DataFrame:
    """Size and the terms of highest mean weight of every cluster."""
    means = clustered.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), vector_to_array(Summarizer.mean(F.col("features"))).alias("_mean")
    )
    scored = F.transform("_mean", lambda w, i: F.struct((-w).alias("weight"), i.alias("at")))
    first = F.slice(F.array_sort(scored), 1, top)
    words = F.split(F.lit("\n".join(vocabulary)), "\n")
    return means.select(
        "cluster_id", "size", F.transform(first, lambda s: F.get(words, s["at"])).alias("top_terms")
    )


def explore(
    tickets: DataFrame,
    key: str = "ticket_id",
    sample_size: int | None = None,
    clusters: int = C.EXPLORE_CLUSTERS,
    terms: int = C.EXPLORE_TERMS,
    min_df: int = C.EXPLORE_MIN_DF,
    max_df: float = C.EXPLORE_MAX_DF,
    components: int = C.EXPLORE_COMPONENTS,
    restarts: int = C.EXPLORE_RESTARTS,
    seed: int = C.SEED,
) -> DataFrame:
    """One row: sample size, explained variance and the clusters with their terms.

    Reads ``key``, ``text`` and ``brand_id`` only.
    """
    columns = tickets.select(key, "text", "brand_id")
    taken = columns if sample_size is None else fixed_sample(columns, key, sample_size, seed)
    sample, found = materialize_counted(
        taken.select(key, without_ids(F.col("text")).alias("clean_text")), "explore-sample", rows=F.count(F.lit(1))
    )
    stops = StopWordsRemover.loadDefaultStopWords("english") + list(C.EXPLORE_EXTRA_STOPS)
    termed = materialize(terms_without(sample, key, brand_words(columns), "clean_text", stops), "explore-terms")
    model = PipelineModel(stages=weight_stages(termed, terms, min_df, max_df))
    vocabulary = vocabulary_of(model)
    vectors = materialize(model.transform(termed).select(key, "features"), "explore-vectors")
    lsa, explained = reduced(vectors, min(components, len(vocabulary) - 1))
    clustered = cluster_terms(cluster(lsa, clusters, restarts, seed), vocabulary)
    # One row per cluster.
    entries = clustered.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "size", "top_terms"))).alias("clusters"))
    return entries.select(
        F.lit(found["rows"]).alias("sample_size"),
        F.lit(clusters).alias("n_clusters"),
        F.lit(float(explained)).alias("explained_variance_ratio"),
        "clusters",
    )
