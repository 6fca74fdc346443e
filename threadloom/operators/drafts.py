"""Prompts for tickets and checks on the replies drafted from them.

Drafts are written elsewhere and arrive as a table. A ticket, what was
retrieved for it and its draft share one key, so checking is row work.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.constants import GENERATION_MODEL, PROMPT_INSTRUCTIONS, PROMPT_REQUEST
from threadloom.functions import safety
from threadloom.schemas import DRAFT

# Spellings of a flag that count as a truth value.
_YES = ("true", "t", "yes", "y", "on", "1", "1.0")
_NO = ("false", "f", "no", "n", "off", "0", "0.0")


def prompt_text(query: Column, retrieved: Column) -> Column:
    """Instructions, the retrieved examples numbered from 1, then the ticket."""
    examples = F.transform(
        retrieved,
        lambda r, i: F.concat(
            F.lit("Example "), (i + 1).cast("string"),
            F.lit(" (ticket "), r["ticket_id"], F.lit(", category: "), r["category"], F.lit("):\n"),
            F.lit("Customer: "), r["customer_message"],
            F.lit("\nSupport reply: "), r["resolution_text"],
        ),
    )
    return F.concat(
        F.lit(PROMPT_INSTRUCTIONS), F.lit("\n\n"),
        F.array_join(examples, "\n\n"),
        F.lit("\n\nNew ticket:\n"), query,
        F.lit("\n\n"), F.lit(PROMPT_REQUEST),
    )


def with_prompt(df: DataFrame) -> DataFrame:
    """Adds ``prompt`` to rows with ``query`` and ``retrieved``."""
    return df.withColumn("prompt", prompt_text(F.col("query"), F.col("retrieved")))


def parse_drafts(df: DataFrame, column: str = "draft_json") -> DataFrame:
    """Adds the typed ``draft`` and ``draft_error``, NULL where the JSON fits.

    A reply and an escalation flag are required; citations default to none. A
    number where a string belongs is an error and is not converted.
    """
    json = F.try_parse_json(F.col(column))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(json, path, "variant"))

    flag = F.lower(F.try_variant_get(json, "$.needs_human_escalation", "string"))
    cited_kind = kind("$.cited_ticket_ids")
    error = (
        F.when(json.isNull() | ~kind("$").startswith("OBJECT"), "not a JSON object")
        .when(F.coalesce(kind("$.reply"), F.lit("")) != "STRING", "reply is not a string")
        .when(
            cited_kind.isNotNull() & ~cited_kind.isin("ARRAY<STRING>", "ARRAY<VOID>"),
            "cited_ticket_ids is not a list of strings",
        )
        .when(~F.coalesce(flag, F.lit("")).isin(*_YES, *_NO), "needs_human_escalation is not a flag")
    )
    # A list of nulls has the same kind as an empty list.
    cited = F.coalesce(
        F.try_variant_get(json, "$.cited_ticket_ids", "array<string>"), F.array().cast("array<string>")
    )
    error = F.coalesce(
        error, F.when(F.exists(cited, lambda c: c.isNull()), "cited_ticket_ids is not a list of strings")
    )
    draft = F.struct(
        F.try_variant_get(json, "$.reply", "string").alias("reply"),
        cited.alias("cited_ticket_ids"),
        flag.isin(*_YES).alias("needs_human_escalation"),
    ).cast(DRAFT)
    with_error = df.withColumn("draft_error", error)
    return with_error.withColumn("draft", F.when(F.col("draft_error").isNull(), draft))


def checked_reply(df: DataFrame) -> DataFrame:
    """Response columns from rows (query, retrieved, draft).

    Links go first, so a link holding a handle leaves one mark only. Claims are
    looked for in the reply as it will be sent, severity in the ticket. A
    made-up citation is reported but does not escalate by itself. A row without
    a draft has no reply, raises no flag of its own and goes to a person.
    """
    retrieved_ids = F.transform("retrieved", lambda r: r["ticket_id"])
    redacted = (
        df.withColumn("_no_links", safety.without_links(F.col("draft.reply")))
        .withColumn("_reply", safety.without_handles(F.col("_no_links")))
        .withColumn("_retrieved_ids", retrieved_ids)
        .withColumn("link_redacted", F.col("_no_links") != F.col("draft.reply"))
        .withColumn("mention_redacted", F.col("_reply") != F.col("_no_links"))
        .withColumn("completed_action_claimed", safety.claims_completed_action(F.col("_reply")))
        .withColumn("ticket_severity_signaled", safety.signals_severity(F.col("query")))
    )
    came = F.col("draft").isNotNull()
    flags = ("completed_action_claimed", "link_redacted", "mention_redacted", "ticket_severity_signaled")
    redacted = redacted.withColumns({flag: came & F.coalesce(flag, F.lit(False)) for flag in flags})
    escalate = ~came | F.coalesce(F.col("draft.needs_human_escalation"), F.lit(False))
    for flag in flags:
        escalate = escalate | F.col(flag)
    cited = F.coalesce("draft.cited_ticket_ids", F.array().cast("array<string>"))
    keys = [c for c in df.columns if c not in ("query", "retrieved", "draft", "generation_model")]
    # Drafts come from outside and may say which model wrote them.
    model = F.col("generation_model") if "generation_model" in df.columns else F.lit(GENERATION_MODEL)
    return redacted.select(
        *keys,
        "query",
        F.col("_reply").alias("reply"),
        safety.verified_citations(cited, F.col("_retrieved_ids")).alias("cited_ticket_ids"),
        safety.unverified_citations(cited, F.col("_retrieved_ids")).alias("hallucinated_citations"),
        "link_redacted",
        "mention_redacted",
        "completed_action_claimed",
        "ticket_severity_signaled",
        escalate.alias("needs_human_escalation"),
        F.col("retrieved").alias("retrieved_examples"),
        model.alias("generation_model"),
    )


def check_drafts(tickets: DataFrame, retrieved: DataFrame, drafts: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Responses from three tables with one row per ticket each.

    ``tickets`` has ``query``, ``retrieved`` the array ``retrieved`` and
    ``drafts`` the struct ``draft``. Tickets without retrieved examples have
    none; tickets without a draft get no response.
    """
    none = F.array().cast(retrieved.schema["retrieved"].dataType)
    given = [c for c in (key, "draft", "generation_model") if c in drafts.columns]
    rows = (
        tickets.select(key, "query")
        .join(drafts.select(*given).where(F.col("draft").isNotNull()), key)
        .join(retrieved.select(key, "retrieved"), key, "left")
        .withColumn("retrieved", F.coalesce("retrieved", none))
    )
    return checked_reply(rows)


def draft_rejects(tickets: DataFrame, drafts: DataFrame, key: str = "ticket_id") -> DataFrame:
    """What comes to no response: drafts that do not fit (their error), and
    tickets that have no draft at all."""
    failed = drafts.where(F.col("draft").isNull()).select(key, F.col("draft_error").alias("error"))
    without = tickets.join(drafts.select(key), key, "left_anti").select(key, F.lit("no draft").alias("error"))
    return failed.unionByName(without)
