"""Ingestion and triage of rows as they arrive.

Both are stateless per row, so each micro-batch runs the batch code. Every
micro-batch writes its own folder, named by batch id and overwritten when a
batch is retried: results are whole after a failure and never doubled.

Drafts that arrive on their own, after their tickets, are joined to them in the
state of the stream; see ``with_late_drafts``.
"""

from datetime import datetime, timedelta

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators import drafts as D
from threadloom.operators import triage as T
from threadloom.operators.ingest import accepted, ingest_summary, parse_rows
from threadloom.operators.label import label_tickets
from threadloom.schemas import DRAFT
from threadloom.sources.csv import parsed_batch, stream_raw_csv
from threadloom.sources.tables import materialize


def _batch_path(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def ingest_stream(
    spark: SparkSession, raw_path: str, landing_path: str, counts_path: str, checkpoint: str, files_per_trigger: int = 16
) -> StreamingQuery:
    """Parse arriving CSV files into the landing table, with counts per batch.

    Stops when the files present at the start are done.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        records = batch.persist()
        parsed = parse_rows(parsed_batch(records)).persist()
        accepted(parsed).write.mode("overwrite").parquet(_batch_path(landing_path, batch_id))
        ingest_summary(parsed).write.mode("overwrite").parquet(_batch_path(counts_path, batch_id))
        parsed.unpersist()
        records.unpersist()

    return (
        stream_raw_csv(spark, raw_path, files_per_trigger)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    """Totals over the batches so far."""
    return spark.read.parquet(counts_path).agg(
        *(F.sum(c).alias(c) for c in ("rows_read", "rows_written", "rows_rejected"))
    )


def with_rule_labels(tickets: DataFrame) -> DataFrame:
    """Rule labels in the place of predictions, where no model is in production."""
    return (
        label_tickets(tickets)
        .withColumnRenamed("category", "predicted_category")
        .withColumnRenamed("priority", "predicted_priority")
    )


def _write_triage(
    batch: DataFrame, batch_id: int, triage_path: str, audit_path: str, refused_path: str,
    models: dict[str, PipelineModel] | None,
) -> None:
    batch = batch.persist()
    rows = T.accepted_tickets(batch)
    refused = T.refused_tickets(batch).select("ticket_id", "error")
    refused.write.mode("overwrite").parquet(_batch_path(refused_path, batch_id))
    labeled = T.predict_labels(rows, models) if models else with_rule_labels(rows)
    checked = D.checked_reply(
        labeled.withColumn("query", F.col("text")).select(
            "ticket_id", "text", "predicted_category", "predicted_priority", "query", "retrieved", "draft"
        )
    )
    triaged = T.triage_columns(checked).persist()
    triaged.write.mode("overwrite").parquet(_batch_path(triage_path, batch_id))
    T.audit(triaged).write.mode("overwrite").parquet(_batch_path(audit_path, batch_id))
    triaged.unpersist()
    batch.unpersist()


def triage_stream(
    arriving: DataFrame,
    triage_path: str,
    audit_path: str,
    refused_path: str,
    checkpoint: str,
    models: dict[str, PipelineModel] | None = None,
) -> StreamingQuery:
    """Triage arriving rows (ticket_id, text, retrieved, draft).

    Writes the triage rows, beside them audit rows without any text, and the
    tickets refused for having no text.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_triage(batch, batch_id, triage_path, audit_path, refused_path, models)

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def with_late_drafts(
    tickets: DataFrame, drafts: DataFrame, patience: timedelta, delay: timedelta = timedelta(0)
) -> DataFrame:
    """Rows for ``triage_stream`` from a stream of tickets and a stream of their drafts.

    ``tickets`` has ticket_id, text, retrieved and arrived_at, ``drafts``
    ticket_id, draft and drafted_at. A ticket leaves as soon as its draft is
    there. One that has none ``patience`` after its arrival leaves without, and
    so goes to a person; later drafts of it count no more. Of several drafts of
    a ticket the first to arrive counts, any of them if they come together. A
    ticket that comes twice with one time is one. A draft is not older than its ticket.

    ``delay`` is how far the rows of a stream may arrive out of order. Both
    sides are forgotten once the watermark has passed them, so the state holds
    the rows of ``patience`` and ``delay`` only. Tickets beyond the delay are
    left out by the join: ``sweep_unanswered`` finds them. A row without an id or
    a time meets nothing; such tickets are for the sweep too.
    """
    came = (
        drafts.select(F.col("ticket_id").alias("_drafted"), "draft", "drafted_at")
        .where(F.col("_drafted").isNotNull() & F.col("drafted_at").isNotNull())
        .withWatermark("drafted_at", _seconds(delay))
    )
    waiting = (
        tickets.select("ticket_id", "text", "retrieved", "arrived_at")
        .where(F.col("ticket_id").isNotNull() & F.col("arrived_at").isNotNull())
        .withWatermark("arrived_at", _seconds(delay))
    )
    meets = (
        (F.col("ticket_id") == F.col("_drafted"))
        & (F.col("drafted_at") >= F.col("arrived_at"))
        & (F.col("drafted_at") <= F.col("arrived_at") + F.expr(f"INTERVAL '{patience.total_seconds()}' SECOND"))
    )
    # A second draft can come only while its ticket is in the state; so long is the first remembered.
    once = waiting.join(came, meets, "left").dropDuplicates(["ticket_id", "arrived_at"])
    return once.select("ticket_id", "text", "retrieved", "draft")


def _seconds(span: timedelta) -> str:
    return f"{span.total_seconds()} seconds"


def released_before(stream: StreamingQuery, patience: timedelta) -> datetime | None:
    """Tickets that arrived before this have left the join, or arrived too late for it."""
    progress = stream.lastProgress
    at = (progress.eventTime if progress else {}).get("watermark")
    return datetime.fromisoformat(at) - patience if at else None


def sweep_unanswered(
    tickets: DataFrame,
    sweep: int,
    triage_path: str,
    audit_path: str,
    refused_path: str,
    before: datetime | None = None,
    models: dict[str, PipelineModel] | None = None,
) -> None:
    """Send every ticket to a person that the stream has neither triaged nor refused.

    ``before`` (``released_before``) spares the tickets still waiting in the
    stream; without it the stream must have ended. Sweeps are numbered from 0; each
    has its own folder beside the batches, replaced when it is run again.
    A ticket without a time is swept at once, one without an id, which cannot be found again, in the last sweep.
    """
    spark, batch_id = tickets.sparkSession, -1 - sweep
    done = None
    for path in (triage_path, refused_path):
        ids = spark.read.parquet(path).where(F.col("batch") != batch_id).select("ticket_id")
        done = ids if done is None else done.unionByName(ids)
    due = tickets
    if before is not None:
        passed = F.col("arrived_at").isNull() | (F.col("arrived_at") < F.lit(before))
        due = tickets.where(F.col("ticket_id").isNotNull() & passed)
    left = due.join(done, "ticket_id", "left_anti").select(
        "ticket_id", "text", "retrieved", F.lit(None).cast(DRAFT).alias("draft")
    )
    _write_triage(materialize(left, "unanswered"), batch_id, triage_path, audit_path, refused_path, models)
