"""Only texts that are not ASCII go to Python."""

from pyspark.sql import functions as F

from threadloom.functions.text import normalized


def test_ascii_texts_are_not_sent_to_python(spark):
    df = spark.createDataFrame([(1, "plain  text"), (2, "\ufb01rst \u2116"), (3, None), (4, ""), (5, "caf\u00e9"), (6, "e\u0301")], "id int, text string")
    rows = df.select("id", normalized(F.col("text")).alias("t"))
    assert {r.id: r.t for r in rows.collect()} == {1: "plain text", 2: "first No", 3: None, 4: "", 5: "caf\u00e9", 6: "\u00e9"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "octet_length" in plan[plan.index("ArrowEvalPython") :]
