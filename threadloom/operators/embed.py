"""Text to dense vectors, with any encoder."""

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.terms import WORD


def fit_hashed_tfidf(df: DataFrame, text: str, dimensions: int = 384) -> PipelineModel:
    """Default encoder: hashed word counts, inverse document frequency, unit length.

    Fitting is one aggregation over the texts, held as one vector.
    """
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=WORD, gaps=False, minTokenLength=2)
    hashed = HashingTF(inputCol="_words", outputCol="_hashed", numFeatures=dimensions)
    counted = hashed.transform(words.transform(df.select(F.coalesce(text, F.lit("")).alias(text))))
    idf = IDF(inputCol="_hashed", outputCol="_weighted").fit(counted)
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit")
    return PipelineModel(stages=[words, hashed, idf, unit])


def embed(
    df: DataFrame, text: str, encoder: PipelineModel | Callable[[Column], Column], output: str = "embedding"
) -> DataFrame:
    """Adds the vector of ``text`` as array<float>.

    ``encoder`` is a fitted pipeline as above, or a function of a column, such
    as a pandas UDF around a sentence model: Arrow hands it batches, and
    spark.sql.execution.arrow.maxRecordsPerBatch sets their size.
    """
    if not isinstance(encoder, PipelineModel):
        return df.withColumn(output, encoder(F.col(text)))
    # The row travels as one column, so no name can clash with the pipeline's.
    given = df.select(
        F.struct("*").alias("_row"), F.coalesce(text, F.lit("")).alias(encoder.stages[0].getInputCol())
    )
    vector = vector_to_array(encoder.stages[-1].getOutputCol(), "float32")
    return encoder.transform(given).select("_row.*", vector.alias(output))


def index_report(knowledge: DataFrame, sampled: DataFrame, model_name: str) -> DataFrame:
    """One row: encoder name, table sizes and rows per category."""
    counts = sampled.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    per_category = counts.agg(
        F.struct(
            F.coalesce(F.sum("n"), F.lit(0)).alias("indexed"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"),
        )
    )
    return (
        knowledge.agg(F.count(F.lit(1)).alias("knowledge_base_size"))
        .withColumn("_index", per_category.scalar())
        .select(
            F.lit(model_name).alias("embedding_model"),
            "knowledge_base_size",
            F.col("_index.indexed").alias("indexed_size"),
            F.col("_index.counts").alias("category_counts"),
        )
    )
