import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import safety
from threadloom.functions.vectors import cosine
from threadloom.operators import drafts, evaluate, triage
from threadloom.schemas import DRAFT, RETRIEVED


def apply(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def example(ticket="71", resolution="That came out wrong, we will look."):
    return (ticket, "Product Complaint", "Low", "The kettle leaks at the lid.", resolution, 0.2)


def rows(spark, query="q", retrieved=(), reply="fine", cited=(), flag=False, ticket=1):
    schema = f"ticket_id bigint, query string, retrieved array<{RETRIEVED.simpleString()}>, draft {DRAFT.simpleString()}"
    return spark.createDataFrame([(ticket, query, list(retrieved), (reply, list(cited), flag))], schema)


def test_prompt(spark):
    examples = [example("4"), example("5"), example("88", "A new lid is on its way.")]
    prompt = drafts.with_prompt(rows(spark, "The mug has a crack.", examples)).first().prompt
    assert "New ticket:\nThe mug has a crack.\n\nRespond with a JSON object" in prompt
    assert (
        "Example 3 (ticket 88, category: Product Complaint):\n"
        "Customer: The kettle leaks at the lid.\nSupport reply: A new lid is on its way.\n\nNew ticket:" in prompt
    )
    for part in ("do not invent", "do not copy", "already been completed", "cited_ticket_ids", "Example 1", "Example 2"):
        assert part in prompt


@pytest.mark.parametrize(
    "cited, verified, made_up",
    [(["1"], ["1"], []), (["1", "999"], ["1"], ["999"]), ([], [], []), (["2", "9", "2", "9"], ["2", "2"], ["9", "9"])],
)
def test_citations(spark, cited, verified, made_up):
    row = drafts.checked_reply(rows(spark, retrieved=[example("1"), example("2")], cited=cited)).first()
    assert (row.cited_ticket_ids, row.hallucinated_citations) == (verified, made_up)
    assert row.needs_human_escalation is False


@pytest.mark.parametrize(
    "reply, expected",
    [
        ("Read http://help.example.net/faq first", "Read [link removed] first"),
        ("https://one.example or http://two.example/x", "[link removed] or [link removed]"),
        ("Thanks for the photo", "Thanks for the photo"),
        ("@shopfan77 yes\n\n@other_1 no", "[handle removed] yes\n\n[handle removed] no"),
        ("go to https://x.com/@me now", "go to [link removed] now"),
        ("mail bob@example.com", "mail bob[handle removed].com"),
    ],
)
def test_redaction(spark, reply, expected):
    row = drafts.checked_reply(rows(spark, reply=reply)).first()
    assert row.reply == expected
    assert row.needs_human_escalation == (reply != expected)
    assert (row.link_redacted, row.mention_redacted) == ("[link" in expected, "[handle" in expected)


@pytest.mark.parametrize(
    "reply, claims",
    [
        ("We have already refunded the fee, please look.", True),
        ("The refund has been processed since Friday.", True),
        ("WE HAVE ALREADY FIXED it", True),
        ("We’ve responded", False),  # a curly apostrophe is missed
        ("Could you send us a photo of the lid?", False),
    ],
)
def test_claims(spark, reply, claims):
    assert apply(spark, safety.claims_completed_action, reply) is claims


@pytest.mark.parametrize(
    "text, severe",
    [
        ("My lawyer will hear of this emergency", True),
        ("The charger is unsafe, it sparks", True),
        ("SCAM", True),
        ("an issue I pursue", False),
        ("Which colours does the jacket come in?", False),
    ],
)
def test_severity(spark, text, severe):
    assert apply(spark, safety.signals_severity, text) is severe


@pytest.mark.parametrize("flag, query, expected", [(False, "hello", False), (True, "hello", True), (False, "lawyer", True)])
def test_escalation(spark, flag, query, expected):
    assert drafts.checked_reply(rows(spark, query=query, flag=flag)).first().needs_human_escalation is expected


@pytest.mark.parametrize(
    "json, error",
    [
        ('{"reply":"a","cited_ticket_ids":["1"],"needs_human_escalation":true}', None),
        ('{"reply":"a","needs_human_escalation":"yes"}', None),
        ('{"reply":"a","cited_ticket_ids":[],"needs_human_escalation":0,"more":1}', None),
        ('{"reply":"","needs_human_escalation":false}', None),
        ('{"needs_human_escalation":true}', "reply is not a string"),
        ('{"reply":null,"needs_human_escalation":true}', "reply is not a string"),
        ('{"reply":5,"needs_human_escalation":true}', "reply is not a string"),
        ('{"reply":"a"}', "needs_human_escalation is not a flag"),
        ('{"reply":"a","needs_human_escalation":"maybe"}', "needs_human_escalation is not a flag"),
        ('{"reply":"a","cited_ticket_ids":[1],"needs_human_escalation":true}', "cited_ticket_ids is not a list of strings"),
        ('{"reply":"a","cited_ticket_ids":[null],"needs_human_escalation":true}', "cited_ticket_ids is not a list of strings"),
        ('{"reply":"a","cited_ticket_ids":null,"needs_human_escalation":true}', "cited_ticket_ids is not a list of strings"),
        ('["a"]', "not a JSON object"),
        ("Sure! {}", "not a JSON object"),
        (None, "not a JSON object"),
    ],
)
def test_draft_json(spark, json, error):
    row = drafts.parse_drafts(spark.createDataFrame([(json,)], "draft_json string")).first()
    assert row.draft_error == error
    assert (row.draft is None) == (error is not None)


def test_draft_values(spark):
    json = '{"reply":"a \\"b\\"","cited_ticket_ids":["1","2"],"needs_human_escalation":true}'
    draft = drafts.parse_drafts(spark.createDataFrame([(json,)], "draft_json string")).first().draft
    assert draft.asDict() == {"reply": 'a "b"', "cited_ticket_ids": ["1", "2"], "needs_human_escalation": True}


def test_check_drafts_joins_three_tables(spark):
    both = rows(spark, retrieved=[example("7")], cited=["7"], ticket=1).unionByName(rows(spark, cited=["7"], ticket=2))
    found = {
        r.ticket_id: r
        for r in drafts.check_drafts(
            both.select("ticket_id", "query"), both.where("ticket_id = 1").select("ticket_id", "retrieved"),
            both.select("ticket_id", "draft"),
        ).collect()
    }
    assert found[1].cited_ticket_ids == ["7"] and found[2].hallucinated_citations == ["7"]
    assert found[2].retrieved_examples == []


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-2.0, 0.0]), ([1.0, 0.0], [0.0, 0.0])],
        "a array<float>, b array<float>",
    )
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, None]


def scores(spark, *flags):
    base = dict(
        num_hallucinated_citations=0, link_redacted=False, mention_redacted=False, completed_action_claimed=False,
        ticket_severity_signaled=False, needs_human_escalation=False, mean_groundedness_similarity=0.5,
        reply_nonempty=True,
    )
    schema = ", ".join(
        f"{k} {'int' if type(v) is int else 'double' if type(v) is float else 'boolean'}" for k, v in base.items()
    )
    return spark.createDataFrame([tuple({**base, **f}.values()) for f in flags], schema)


def test_summary(spark):
    summary = evaluate.summarize(
        scores(spark, {"num_hallucinated_citations": 2, "link_redacted": True}, {"reply_nonempty": False},
               {"needs_human_escalation": True, "mention_redacted": True}, {"ticket_severity_signaled": True})
    ).first()
    assert summary.num_queries == 4 and summary.empty_or_short_replies == 1
    for rate in ("hallucination_rate", "link_redaction_rate", "mention_redaction_rate", "escalation_rate",
                 "ticket_severity_signal_rate"):
        assert summary[rate] == 0.25
    assert summary.completed_action_claim_rate == 0.0 and summary.mean_groundedness_similarity == 0.5


def test_summary_of_nothing(spark):
    summary = evaluate.summarize(scores(spark, {}).limit(0)).first()
    assert summary.num_queries == 0 and summary.hallucination_rate is None


def test_scores(spark):
    df = drafts.checked_reply(
        rows(spark, reply="  short  ", cited=["1", "2"], retrieved=[example("1")])
        .withColumn("reply_vector", F.array(F.lit(1.0), F.lit(0.0)))
        .withColumn("resolution_vectors", F.array(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))))
    )
    row = evaluate.score_responses(df).first()
    assert (row.reply_length, row.reply_nonempty) == (9, False)
    assert (row.num_citations, row.num_hallucinated_citations) == (1, 1)
    assert (row.max_groundedness_similarity, row.mean_groundedness_similarity) == (1.0, 0.5)
    fixed = spark.createDataFrame([("q",), ("other",)], "query string")
    assert evaluate.per_query(evaluate.score_responses(df), fixed).count() == 1


def test_flag_rates(spark):
    runs = spark.createDataFrame(
        [("a", "v1", True), ("a", "v1", False), ("a", "v2", True)], "query string, variant string, flag boolean"
    )
    found = {r.variant: (r.raised, r.runs, r.rate) for r in evaluate.flag_rates(runs, "flag", "query", "variant").collect()}
    assert found == {"v1": (1, 2, 0.5), "v2": (1, 1, 1.0)}


def test_triage_input_and_audit(spark):
    df = spark.createDataFrame([(1, ""), (2, " "), (3, None), (4, "hi")], "ticket_id bigint, text string")
    assert {r.ticket_id for r in triage.accepted_tickets(df).collect()} == {2, 4}
    assert {r.ticket_id: r.error for r in triage.refused_tickets(df).collect()} == {
        1: "text is empty", 3: "text is missing",
    }
    predicted = df.where("ticket_id = 4").select(
        "ticket_id", "text", F.lit("c").alias("predicted_category"), F.lit("p").alias("predicted_priority")
    )
    triaged = triage.triage(predicted, drafts.checked_reply(rows(spark, ticket=4)))
    assert len(triaged.columns) == 11
    # Without a response the ticket stays and goes to a person.
    alone = triage.triage(predicted, drafts.checked_reply(rows(spark, ticket=5))).first()
    assert alone.draft_reply is None and alone.needs_human_escalation and alone.cited_ticket_ids == []
    audit = triage.audit(triaged).first().asDict()
    assert audit["text_length"] == 2 and "hi" not in audit.values()
