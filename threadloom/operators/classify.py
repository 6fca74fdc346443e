"""Text classifiers: TF-IDF and multinomial logistic regression, on Spark ML."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from threadloom.constants import LOGREG_ITERATIONS, PARAM_GRID, TFIDF_MIN_DF, TFIDF_TERMS
from threadloom.operators import metrics
from threadloom.operators.registry import best_trial
from threadloom.operators.terms import fit_tfidf


def _weighted(df: DataFrame, target: str, class_weight: str | None) -> DataFrame:
    """Adds ``weight``: 1, or balanced over the classes."""
    if class_weight is None:
        return df.withColumn("weight", F.lit(1.0))
    # One row per class of the target; the labels are fitted into the model anyway.
    weights = metrics.class_weights(df, target).select(target, "weight").collect()
    choice = F.lit(1.0)
    for row in weights:
        choice = F.when(F.col(target) == row[0], row[1]).otherwise(choice)
    return df.withColumn("weight", choice)


def fit_classifier(
    train: DataFrame, target: str, c: float, class_weight: str | None, rows: int, iterations: int = LOGREG_ITERATIONS
) -> PipelineModel:
    """Stages from ``features`` to ``prediction_label``.

    The penalty C weighs the summed loss against half the squared norm; Spark
    averages the loss, hence 1 / (C * rows). Balanced weights sum to ``rows``.
    """
    indexer = StringIndexer(
        inputCol=target, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"
    ).fit(train)
    regression = LogisticRegression(
        featuresCol="features",
        labelCol="_label",
        weightCol="weight",
        predictionCol="_prediction",
        rawPredictionCol="_raw",
        probabilityCol="_probability",
        family="multinomial",
        maxIter=iterations,
        tol=1e-4,
        regParam=1.0 / (c * rows),
        elasticNetParam=0.0,
        standardization=False,
    ).fit(indexer.transform(_weighted(train, target, class_weight)))
    names = IndexToString(inputCol="_prediction", outputCol="prediction", labels=indexer.labels)
    return PipelineModel(stages=[regression, names])


def predict(model: PipelineModel, df: DataFrame, output: str = "prediction") -> DataFrame:
    """``df`` plus the predicted label."""
    result = model.transform(df)
    return result.select(*df.columns, F.col("prediction").alias(output))


def train_and_evaluate(
    parts: DataFrame, target: str, key: str = "ticket_id", text: str = "text", terms: int = TFIDF_TERMS,
    min_df: int = TFIDF_MIN_DF, iterations: int = LOGREG_ITERATIONS,
) -> tuple[PipelineModel, DataFrame]:
    """Majority baseline and a C=1 balanced model.

    ``parts`` has ``part`` (train, val, test). Gives the model and report rows
    (target, model, part, metrics).
    """
    train = parts.where("part = 'train'")
    test = parts.where("part = 'test'")
    vectors = fit_tfidf(train, text, terms, min_df)
    featured = vectors.transform(train.select(key, text, target)).persist(StorageLevel.MEMORY_AND_DISK)
    classifier = fit_classifier(featured, target, 1.0, "balanced", featured.count(), iterations)
    featured.unpersist()
    model = PipelineModel(stages=vectors.stages + classifier.stages)
    baseline = metrics.with_majority(train, test, target)

    def row(name: str, part: str, scored: DataFrame) -> DataFrame:
        return metrics.evaluate(scored, target, "prediction").select(
            F.lit(target).alias("target"), F.lit(name).alias("model"), F.lit(part).alias("part"), "*"
        )

    report = (
        row("majority-baseline", "test", baseline)
        .unionByName(row("tfidf+logreg", "val", predict(model, parts.where("part = 'val'"))))
        .unionByName(row("tfidf+logreg", "test", predict(model, test)))
    )
    return model, report


def tune(
    parts: DataFrame, target: str, key: str = "ticket_id", text: str = "text", grid=PARAM_GRID,
    terms: int = TFIDF_TERMS, min_df: int = TFIDF_MIN_DF, iterations: int = LOGREG_ITERATIONS,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Grid search with one vectoriser; the test part is scored once, at the end.

    Gives the best model, the trials and the test metrics.
    """
    spark = parts.sparkSession
    train = parts.where("part = 'train'")
    vectors = fit_tfidf(train, text, terms, min_df)

    def featured(part: str) -> DataFrame:
        return vectors.transform(parts.where(F.col("part") == part).select(key, text, target))

    # The grid reads both parts once per trial.
    train_rows = featured("train").persist(StorageLevel.MEMORY_AND_DISK)
    validation = featured("val").persist(StorageLevel.MEMORY_AND_DISK)
    rows = train_rows.count()
    fitted, scores = [], []
    for trial, (c, class_weight) in enumerate(grid):
        classifier = fit_classifier(train_rows, target, c, class_weight, rows, iterations)
        result = metrics.evaluate(predict(classifier, validation), target, "prediction").first()
        fitted.append(classifier)
        scores.append((trial, float(c), class_weight, result.macro_f1, result.accuracy))
    train_rows.unpersist()
    validation.unpersist()
    trials = spark.createDataFrame(
        scores, "trial int, c double, class_weight string, val_macro_f1 double, val_accuracy double"
    )
    best = best_trial(trials).first()
    model = PipelineModel(stages=vectors.stages + fitted[best.trial].stages)
    test = metrics.evaluate(predict(model, parts.where("part = 'test'")), target, "prediction")
    return model, trials, test


def report_json(report: DataFrame, name: str) -> DataFrame:
    """Report rows of one target as one struct column: baseline, val, test."""
    metrics_of = F.struct("accuracy", "macro_f1", "weighted_f1", "per_class")

    def pick(model: str, part: str):
        return F.first(F.when((F.col("model") == model) & (F.col("part") == part), metrics_of), ignorenulls=True)

    return report.agg(
        F.struct(
            pick("majority-baseline", "test").alias("baseline"),
            pick("tfidf+logreg", "val").alias("val"),
            pick("tfidf+logreg", "test").alias("test"),
        ).alias(name)
    )


def tuning_json(trials: DataFrame, test: DataFrame, name: str) -> DataFrame:
    """Trials, best parameters and test metrics as one struct column."""
    params = F.struct("c", "class_weight")
    # One row per grid point.
    listed = F.array_sort(F.collect_list(F.struct("trial", params.alias("params"), "val_macro_f1")))
    best = best_trial(trials).select(F.struct(params.alias("params"), "val_macro_f1"))
    return (
        trials.agg(listed.alias("_trials"))
        .withColumn("_best", best.scalar())
        .withColumn("_test", test.select(F.struct("*")).scalar())
        .select(
            F.struct(
                F.col("_trials").alias("trials"),
                F.col("_best.params").alias("best_params"),
                F.col("_best.val_macro_f1").alias("best_val_macro_f1"),
                F.col("_test").alias("test_metrics"),
            ).alias(name)
        )
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
