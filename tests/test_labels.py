import pytest
from pyspark.sql import functions as F

from threadloom.constants import FINANCIAL_HARM_KEYWORDS, URGENCY_KEYWORDS
from threadloom.functions import rules
from threadloom.operators import label

CATEGORIES = {
    "Locked out since Monday, the login page refuses my pin": "Account Access",
    "The courier lost my parcel and the tracking shows nothing": "Order / Delivery / Refund",
    "You double charged me, look at the invoice": "Billing & Payments",
    "Screen is frozen and lagging since the patch": "Technical Support",
    "There is a glitch in the map view": "Technical Support",
    "This page won’t load on my laptop": "Technical Support",
    "My tablet wont boot today": "Technical Support",
    "the menu went down again with an error": "Technical Support",
    "Poor quality fabric and the wrong size too": "Product Complaint",
    "Been on hold for an hour, terrible service": "Customer Service Complaint",
    "Do you sell gift cards in the shop?": "General Inquiry",
    "Crossing the border with my new phone": "General Inquiry",
    "Trying to sign in ends with an error": "Account Access",  # a tie
    "un bugé étrange": "General Inquiry",  # an accented letter is part of the word
    "": "General Inquiry",
}
PRIORITIES = {
    "Which colours does the jacket come in?": "Low",
    "Please answer asap.": "Medium",
    "NEVER AGAIN!!! This is a SCAM": "High",
    "You double charged me, look at the invoice": "Medium",
    "ANSWER me, it is STILL dark": "Medium",
    "no! no! no!": "High",
}


def column(spark, texts, labelled):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r[0]: r[1] for r in labelled(df).collect()}


def test_categories(spark):
    assert column(spark, CATEGORIES, label.with_category) == CATEGORIES


def test_priorities(spark):
    assert column(spark, PRIORITIES, label.with_priority) == PRIORITIES


def test_scores_count_hits_in_list_order(spark):
    df = spark.createDataFrame([("double charged, and now reset my password for the parcel",)], "text string")
    scores = label.with_scores(df).first().scores
    assert scores["Billing & Payments"] == 1  # "charged" is not counted again
    assert scores["Account Access"] == 1
    assert scores["Technical Support"] == 1


def test_labels_stay_in_the_jvm(spark):
    df = label.label_tickets(spark.range(3).select(F.col("id").cast("string").alias("text")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    # Each of the six patterns is looked for once, and three for urgency.
    assert plan.count("regexp_count") <= 9


def test_reports(spark):
    df = label.label_tickets(spark.createDataFrame([(t,) for t in CATEGORIES], "text string"))
    report = label.labeling_report(df).first()
    assert report.tickets_labeled == len(CATEGORIES)
    assert report.category_distribution["Technical Support"] == 5
    assert sum(report.priority_distribution.values()) == len(CATEGORIES)


def test_label_changes(spark):
    df = spark.createDataFrame(
        [(1, "an unauthorized charge"), (2, "asap"), (3, "fine")], "ticket_id bigint, text string"
    )
    earlier = [w for w in URGENCY_KEYWORDS if w not in FINANCIAL_HARM_KEYWORDS]
    moved = label.label_changes(label.with_priority(df, earlier), label.with_priority(df), "priority")
    assert {tuple(r) for r in moved.collect()} == {("Low", "Medium", 1), ("Medium", "Medium", 1), ("Low", "Low", 1)}


def test_miss_rate(spark):
    battery = spark.createDataFrame(
        [("which login", "Account Access"), ("it came torn", "Product Complaint")], "text string, expected string"
    )
    assert label.miss_rate(battery).first().asDict() == {"cases": 2, "misses": 1, "miss_rate": 0.5}


@pytest.mark.parametrize("score, priority", [(0, "Low"), (1, "Medium"), (2, "Medium"), (3, "High"), (9, "High")])
def test_priority_floors(spark, score, priority):
    assert spark.range(1).select(rules.priority_of(F.lit(score))).first()[0] == priority
