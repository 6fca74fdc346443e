"""The batch flow from landing rows to labelled tickets and knowledge base."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import clean, knowledge, label, threads, tickets, validate
from threadloom.operators.joins import salted_join
from threadloom.plans import derive
from threadloom.sources.tables import materialize


class Flow:
    """Stages over one set of tables, each built once and only when asked for.

    Stages that later ones read more than once are written to shared storage,
    as the stage jobs write theirs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def landing(self) -> DataFrame:
        return derive.landing(self.spark, self.sf_dir)

    @cached_property
    def checked(self) -> DataFrame:
        return validate.check_rows(self.landing)

    @cached_property
    def valid(self) -> DataFrame:
        return validate.valid_rows(self.checked)

    @cached_property
    def normalised(self) -> DataFrame:
        return clean.with_clean_text(self.valid)

    @cached_property
    def tweets(self) -> DataFrame:
        return materialize(clean.kept_rows(self.normalised), "tweets")

    @cached_property
    def roots(self) -> DataFrame:
        return threads.reply_roots(self.tweets)

    @cached_property
    def tickets(self) -> DataFrame:
        return tickets.build_ticket_features(self.tweets, self.roots)

    @cached_property
    def labeled(self) -> DataFrame:
        return label.label_tickets(self.tickets)

    @cached_property
    def stored_labeled(self) -> DataFrame:
        return materialize(self.labeled, "labeled-tickets")

    @cached_property
    def knowledge(self) -> DataFrame:
        return knowledge.build_knowledge_base(self.tweets, self.stored_labeled, self.roots)

    @cached_property
    def stored_knowledge(self) -> DataFrame:
        return materialize(self.knowledge, "knowledge-base")

    @cached_property
    def drafted(self) -> DataFrame:
        """A draft per brand message of a resolved ticket, with its own thread
        as the retrieved example: draft_id, text, query, retrieved, draft.

        A thread may hold many brand messages, so the join to it is salted.
        """
        messages = (
            threads.with_roots(self.tweets.select("tweet_id", "inbound", "text"), self.roots)
            .where(~F.col("inbound"))
            .select(F.col("tweet_id").alias("draft_id"), "text", "thread_root_id")
        )
        example = F.struct(
            F.col("ticket_id").cast("string").alias("ticket_id"),
            "category", "priority", "customer_message", "resolution_text",
            F.lit(0.0).alias("distance"),
        )
        root = F.col("ticket_id").cast("string")
        drafts = salted_join(
            messages, self.stored_knowledge, "thread_root_id", "ticket_id", spread=F.col("draft_id")
        ).select(
            "draft_id",
            "text",
            F.col("customer_message").alias("query"),
            F.array(example).alias("retrieved"),
            F.struct(
                F.col("text").alias("reply"),
                F.array(root, F.concat(F.lit("x"), root), root).alias("cited_ticket_ids"),
                (F.col("draft_id") % 5 == 0).alias("needs_human_escalation"),
            ).alias("draft"),
        )
        return materialize(drafts, "drafts")
