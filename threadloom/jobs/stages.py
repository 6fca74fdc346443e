"""One function per stage: read tables, write a table and a JSON report."""

from datetime import timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.constants import EVALUATION_QUERIES, MODEL_NAMES, TOP_K
from threadloom.operators import (
    classify,
    clean,
    drafts,
    embed,
    evaluate,
    explore,
    ingest,
    knowledge,
    label,
    nearest,
    registry,
    split,
    threads,
    tickets,
    triage,
    validate,
)
from threadloom.schemas import LANDING
from threadloom.sources.tables import materialize, read_report, read_table, write_report, write_table
from threadloom.streaming import arrivals


def run_ingest(spark: SparkSession, raw: str, landing: str, report: str) -> None:
    write_report(ingest.ingest(spark, raw, landing), report)


def run_validate(spark: SparkSession, landing: str, validated: str, quarantine: str, report: str) -> None:
    rows = read_table(spark, landing)
    problems = validate.schema_problems(rows)
    if problems:
        raise ValueError("; ".join(problems))
    # Checked once; the three outputs are read from that table.
    checked = materialize(validate.check_rows(rows.select(*LANDING.fieldNames())), "checked")
    write_table(validate.valid_rows(checked), validated)
    write_table(validate.quarantine(checked), quarantine)
    write_report(validate.validation_report(checked, read_table(spark, validated)), report)


def run_clean(spark: SparkSession, validated: str, processed: str, report: str) -> None:
    write_report(clean.clean(read_table(spark, validated), processed), report)


def run_features(spark: SparkSession, processed: str, features: str, roots: str, report: str) -> None:
    """Also keeps the thread roots, which the knowledge base needs again."""
    tweets = read_table(spark, processed)
    write_table(threads.reply_roots(tweets), roots)
    found = read_table(spark, roots)
    write_table(tickets.build_ticket_features(tweets, found), features)
    write_report(tickets.feature_report(tweets, found, read_table(spark, features)), report)


def run_label(spark: SparkSession, features: str, labeled: str, report: str) -> None:
    write_table(label.label_tickets(read_table(spark, features)), labeled)
    write_report(label.labeling_report(read_table(spark, labeled)), report)


def run_explore(spark: SparkSession, features: str, report: str, sample_size: int | None = None) -> None:
    """Over all tickets, or a fixed sample of them if its size is given."""
    write_report(explore.explore(read_table(spark, features), sample_size=sample_size), report)


def _parts(spark: SparkSession, labeled: str) -> DataFrame:
    rows = read_table(spark, labeled).select("ticket_id", "text", "category", "priority")
    return materialize(split.stratified_split(rows), "parts")


def _one_row(sizes: DataFrame, columns: list[DataFrame]) -> DataFrame:
    for column in columns:
        sizes = sizes.withColumn(column.columns[0], column.scalar())
    return sizes


def run_train(spark: SparkSession, labeled: str, models: str, runs: str, report: str) -> None:
    parts = _parts(spark, labeled)
    columns = []
    for target in MODEL_NAMES:
        model, rows = classify.train_and_evaluate(parts, target)
        classify.save_model(model, f"{models}/{target}")
        rows = materialize(rows, f"{target}-report")
        for row in rows.collect():  # three rows
            registry.log_run(
                spark, runs, f"{target}-{row.model}-{row.part}", target, {"model": row.model, "part": row.part},
                {"accuracy": row.accuracy, "macro_f1": row.macro_f1, "weighted_f1": row.weighted_f1},
            )
        columns.append(classify.report_json(rows, target))
    sizes = parts.agg(
        F.struct(*(F.count_if(F.col("part") == p).alias(p) for p in ("train", "val", "test"))).alias("split_sizes")
    )
    write_report(_one_row(sizes, columns), report)


def run_tune(spark: SparkSession, labeled: str, models: str, runs: str, report: str) -> None:
    """Overwrites the models that training saved."""
    parts = _parts(spark, labeled)
    columns = []
    for target in MODEL_NAMES:
        model, trials, test = classify.tune(parts, target)
        classify.save_model(model, f"{models}/{target}")
        test = materialize(test, f"{target}-test")
        for row in trials.collect():  # one row per grid point
            registry.log_run(
                spark, runs, f"{target}-tune-C{row.c}-{row.class_weight}", target,
                {"C": row.c, "class_weight": row.class_weight},
                {"val_macro_f1": row.val_macro_f1, "val_accuracy": row.val_accuracy},
            )
        registry.log_run(spark, runs, f"{target}-tuned-best", target, {}, {"test_macro_f1": test.first().macro_f1})
        columns.append(classify.tuning_json(trials, test, target))
    write_report(_one_row(spark.range(1).select(F.lit("tuning").alias("report")), columns), report)


def run_register(spark: SparkSession, tuning: str, evaluation: str, ledger: str, report: str) -> None:
    def column(path: str, field: str, name: str) -> DataFrame:
        row = read_report(spark, path)
        pairs = F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"{t}.{field}").alias(name)) for t in MODEL_NAMES))
        return row.select(F.inline(pairs))

    rows = registry.register_reports(
        spark,
        column(tuning, "test_metrics.macro_f1", "test_macro_f1"),
        column(evaluation, "baseline.macro_f1", "baseline_macro_f1"),
        ledger,
    )
    write_report(rows, report)


def run_knowledge(spark: SparkSession, processed: str, roots: str, labeled: str, knowledge_base: str, report: str) -> None:
    tickets_table = read_table(spark, labeled)
    built = knowledge.build_knowledge_base(read_table(spark, processed), tickets_table, read_table(spark, roots))
    write_table(built, knowledge_base)
    write_report(knowledge.knowledge_base_report(tickets_table, read_table(spark, knowledge_base)), report)


def run_index(
    spark: SparkSession, knowledge_base: str, index: str, encoder: str, report: str, cap: int | None = None
) -> None:
    """The whole knowledge base embedded, or at most ``cap`` tickets of a category if that is given."""
    table = read_table(spark, knowledge_base)
    sampled = table if cap is None else materialize(split.capped_sample(table, cap=cap), "kb-sample")
    model = embed.fit_hashed_tfidf(sampled, "customer_message")
    model.write().overwrite().save(encoder)
    rows = embed.embed(sampled, "customer_message", model).select(
        F.col("ticket_id").cast("string").alias("id"),
        "embedding",
        F.col("customer_message").alias("document"),
        F.struct("category", "priority", "resolution_text").alias("metadata"),
        "category",
    )
    write_table(rows, index, ("category",))
    write_report(embed.index_report(table, sampled, "hashed-tfidf"), report)


def _retrieved(
    spark: SparkSession, tickets_table: DataFrame, index: str, encoder: PipelineModel, k: int, recall: float | None
) -> DataFrame:
    rows = read_table(spark, index)
    queries = embed.embed(tickets_table, "text", encoder, "vector").select(F.col("ticket_id").alias("query_id"), "vector")
    vectors = rows.select("id", F.col("embedding").alias("vector"))
    if recall is None:
        hits = nearest.nearest_pruned(queries, vectors, k).hits
    else:
        hits = nearest.nearest_calibrated(queries, vectors, k, recall).drop("probes", "measured_recall")
    texts = rows.select(
        "id", "metadata.category", "metadata.priority", F.col("document").alias("customer_message"),
        "metadata.resolution_text",
    )
    return nearest.retrieve(materialize(hits, "hits"), texts)


def run_prompts(
    spark: SparkSession, tickets_path: str, index: str, encoder: str, retrieved: str, prompts: str,
    k: int = TOP_K, recall: float | None = None,
) -> None:
    """Nearest examples and prompt of every ticket (ticket_id, text).

    Examples are the exact nearest, or a share ``recall`` of them if that is given.
    """
    rows = triage.accepted_tickets(read_table(spark, tickets_path))
    write_table(_retrieved(spark, rows, index, PipelineModel.load(encoder), k, recall), retrieved)
    found = read_table(spark, retrieved)
    none = F.array().cast(found.schema["retrieved"].dataType)
    # A ticket with no hit gets a prompt without examples.
    joined = rows.select("ticket_id", F.col("text").alias("query")).join(found, "ticket_id", "left")
    joined = joined.withColumn("retrieved", F.coalesce("retrieved", none))
    write_table(drafts.with_prompt(joined).select("ticket_id", "prompt"), prompts)


def run_triage(
    spark: SparkSession, tickets_path: str, retrieved: str, drafts_path: str, models: str, ledger: str,
    responses: str, triaged: str, audit: str, refused: str, rejects: str,
) -> None:
    """Predict, check drafts (ticket_id, draft_json) and write rows and audit.

    Every accepted ticket has one triage row; ``rejects`` says why some have no response.
    """
    loaded = triage.production_models(
        registry.read_ledger(spark, ledger), {target: f"{models}/{target}" for target in MODEL_NAMES}
    )
    rows = read_table(spark, tickets_path)
    write_table(triage.refused_tickets(rows), refused)
    accepted = triage.accepted_tickets(rows)
    parsed = drafts.parse_drafts(read_table(spark, drafts_path))
    checked = drafts.check_drafts(
        accepted.select("ticket_id", F.col("text").alias("query")), read_table(spark, retrieved), parsed
    )
    write_table(checked, responses)
    write_table(drafts.draft_rejects(accepted, parsed), rejects)
    predicted = triage.predict_labels(accepted.select("ticket_id", "text"), loaded)
    write_table(triage.triage(predicted, read_table(spark, responses)), triaged)
    write_table(triage.audit(read_table(spark, triaged)), audit)


def run_evaluate(spark: SparkSession, responses: str, encoder: str, scores: str, report: str, per_query: str) -> None:
    """Scores, their summary, and beside it the rows of the fixed test queries."""
    rows = evaluate.with_vectors(read_table(spark, responses), PipelineModel.load(encoder))
    write_table(evaluate.score_responses(rows), scores)
    stored = read_table(spark, scores)
    write_report(evaluate.summarize(stored), report)
    queries = spark.createDataFrame([(query,) for query in EVALUATION_QUERIES], "query string")
    write_table(evaluate.per_query(stored, queries), per_query)


def run_ingest_stream(spark: SparkSession, raw: str, landing: str, counts: str, checkpoint: str) -> None:
    """Ingest the files that have arrived since the last run."""
    arrivals.ingest_stream(spark, raw, landing, counts, checkpoint).awaitTermination()


def run_triage_stream(
    spark: SparkSession, arriving: str, models: str, ledger: str, triaged: str, audit: str, refused: str, checkpoint: str
) -> None:
    """Triage the tickets (ticket_id, text, retrieved, draft) that have arrived since the last run."""
    loaded = triage.production_models(
        registry.read_ledger(spark, ledger), {target: f"{models}/{target}" for target in MODEL_NAMES}
    )
    rows = spark.readStream.schema(read_table(spark, arriving).schema).parquet(arriving)
    arrivals.triage_stream(rows, triaged, audit, refused, checkpoint, loaded).awaitTermination()


def run_late_drafts(
    spark: SparkSession, arriving: str, drafts_path: str, models: str, ledger: str, triaged: str, audit: str, refused: str,
    checkpoint: str, patience_minutes: int = 60, delay_minutes: int = 0, sweep: int = -1,
) -> None:
    """Triage the tickets (ticket_id, text, retrieved, arrived_at) whose drafts (ticket_id, draft_json, drafted_at)
    have come since the last run, and those that have waited too long for one.

    With a ``sweep`` number, tickets that came too late for the stream are triaged too.
    """
    loaded = triage.production_models(
        registry.read_ledger(spark, ledger), {target: f"{models}/{target}" for target in MODEL_NAMES}
    )
    patience = timedelta(minutes=patience_minutes)
    tickets = read_table(spark, arriving)
    written = spark.readStream.schema(read_table(spark, drafts_path).schema).parquet(drafts_path)
    rows = arrivals.with_late_drafts(
        spark.readStream.schema(tickets.schema).parquet(arriving), drafts.parse_drafts(written), patience,
        timedelta(minutes=delay_minutes),
    )
    run = arrivals.triage_stream(rows, triaged, audit, refused, checkpoint, loaded)
    run.awaitTermination()
    before = arrivals.released_before(run, patience)
    if sweep >= 0 and before is not None:
        arrivals.sweep_unanswered(tickets, sweep, triaged, audit, refused, before, loaded)
