"""All stages in order, from a CSV file to triage rows."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.jobs import __main__ as jobs
from threadloom.plans import derive
from threadloom.sources.csv import write_raw_csv

SF_DIR = "/root/testdata/sf0.01"


def report(folder, name):
    files = list(Path(folder, name).glob("part-*.json"))
    assert len(files) == 1
    return json.loads(files[0].read_text())


def run(stage, root, **options):
    arguments = [stage]
    for key, value in options.items():
        arguments += ["--" + key.replace("_", "-"), f"{root}/{value}"]
    jobs.main(arguments)


def test_stages_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("threadloom.operators.classify.tune.__defaults__",
                        ("ticket_id", "text", ((1.0, None), (1.0, "balanced")), 500, 3, 10))
    monkeypatch.setattr("threadloom.operators.classify.train_and_evaluate.__defaults__",
                        ("ticket_id", "text", 500, 3, 10))
    root = str(tmp_path)
    raw = spark.sql(
        """SELECT CAST(tweet_id AS STRING) AS tweet_id, author_id, CAST(inbound AS STRING) AS inbound,
          'Fri Mar 11 06:25:03 +0000 2016' AS created_at, text, '' AS response_tweet_id,
          coalesce(CAST(in_response_to_tweet_id AS STRING), '') AS in_response_to_tweet_id FROM {t}""",
        t=derive.tweets(spark, SF_DIR),
    )
    write_raw_csv(raw, f"{root}/raw")
    run("ingest", root, raw="raw", landing="landing", report="r1")
    assert report(root, "r1") == {"rows_read": 536, "rows_written": 536, "rows_rejected": 0}
    run("validate", root, landing="landing", validated="validated", quarantine="bad", report="r2")
    checked = report(root, "r2")
    assert checked["rows_in"] == checked["rows_valid"] + checked["rows_rejected"] == 536
    run("clean", root, validated="validated", processed="processed", report="r3")
    assert report(root, "r3")["rows_in"] == checked["rows_valid"]
    run("features", root, processed="processed", features="features", roots="roots", report="r4")
    tickets = report(root, "r4")["tickets_extracted"]
    run("label", root, features="features", labeled="labeled", report="r5")
    assert sum(report(root, "r5")["category_distribution"].values()) == tickets
    jobs.main(["explore", "--features", f"{root}/features", "--report", f"{root}/r6", "--sample-size", "60"])
    assert len(report(root, "r6")["clusters"]) == 12
    run("train", root, labeled="labeled", models="models", runs="runs", report="r7")
    logged = sorted(map(tuple, spark.read.parquet(f"{root}/runs").select("run_name", "target", "kind", "key").collect()))
    run("train", root, labeled="labeled", models="models", runs="runs", report="r7")
    assert sorted(map(tuple, spark.read.parquet(f"{root}/runs").select("run_name", "target", "kind", "key").collect())) == logged
    assert len(logged) == len(set(logged)) == 2 * 3 * 5
    assert sum(report(root, "r7")["split_sizes"].values()) == tickets
    run("tune", root, labeled="labeled", models="models", runs="runs", report="r8")
    assert len(report(root, "r8")["priority"]["trials"]) == 2
    run("register", root, tuning="r8", evaluation="r7", ledger="ledger", report="r9")
    assert spark.read.parquet(f"{root}/ledger").count() == 2
    run("knowledge", root, processed="processed", roots="roots", labeled="labeled", knowledge_base="kb", report="r10")
    assert report(root, "r10")["tickets_in"] == tickets
    run("index", root, knowledge_base="kb", index="index", encoder="encoder", report="r11")
    assert report(root, "r11")["indexed_size"] == report(root, "r10")["resolutions_found"]

    asked = spark.createDataFrame([(1, "The parcel came late"), (2, "My lawyer will call"), (3, ""), (4, "no draft for this")], "ticket_id bigint, text string")
    asked.write.parquet(f"{root}/asked")
    run("prompts", root, tickets_path="asked", index="index", encoder="encoder", retrieved="retrieved", prompts="prompts")
    prompts = spark.read.parquet(f"{root}/prompts")
    assert prompts.count() == 3 and prompts.where(F.col("prompt").contains("Example 3")).count() == 3
    first = F.col("retrieved")[0]["ticket_id"]
    spark.read.parquet(f"{root}/retrieved").where("ticket_id < 4").select(
        "ticket_id",
        F.to_json(F.struct(
            F.lit("See https://x.com").alias("reply"), F.array(first).alias("cited_ticket_ids"),
            F.lit(False).alias("needs_human_escalation"),
        )).alias("draft_json"),
    ).write.parquet(f"{root}/drafts")
    options = dict(
        tickets_path="asked", retrieved="retrieved", drafts_path="drafts", models="models", ledger="ledger",
        responses="responses", triaged="triaged", audit="audit", refused="refused", rejects="rejects",
    )
    ledger = spark.read.parquet(f"{root}/ledger").collect()
    if any(r.outcome == "rejected" for r in ledger):
        with pytest.raises(LookupError):
            run("triage", root, **options)
        spark.createDataFrame(
            [(r.model_name, r.version + 1, 1.0, 0.1, "promoted-to-production", "") for r in ledger],
            "model_name string, version bigint, test_macro_f1 double, baseline_macro_f1 double, outcome string, reason string",
        ).write.mode("append").parquet(f"{root}/ledger")
    run("triage", root, **options)
    rows = {r.ticket_id: r for r in spark.read.parquet(f"{root}/triaged").collect()}
    assert set(rows) == {1, 2, 4} and rows[4].needs_human_escalation and rows[4].draft_reply is None
    assert rows[1].draft_reply == "See [link removed]" and rows[2].ticket_severity_signaled
    assert spark.read.parquet(f"{root}/refused").count() == 1
    assert [tuple(r) for r in spark.read.parquet(f"{root}/rejects").collect()] == [(4, "no draft")]
    assert "ticket_text" not in spark.read.parquet(f"{root}/audit").columns
    came = spark.read.parquet(f"{root}/drafts").withColumn("drafted_at", F.expr("TIMESTAMP '2017-10-31 12:10:00'"))
    came.write.parquet(f"{root}/late")
    times = F.expr("TIMESTAMP '2017-10-31 12:00:00' + make_interval(0, 0, 0, 0, ticket_id - 1)")
    waiting = asked.join(spark.read.parquet(f"{root}/retrieved"), "ticket_id", "left").withColumn("arrived_at", times)
    waiting.write.parquet(f"{root}/waiting")
    jobs.main([
        "late_drafts", "--arriving", f"{root}/waiting", "--drafts-path", f"{root}/late", "--models", f"{root}/models",
        "--ledger", f"{root}/ledger", "--triaged", f"{root}/late-rows", "--audit", f"{root}/late-audit",
        "--refused", f"{root}/late-refused", "--checkpoint", f"{root}/late-state", "--sweep", "0",
    ])
    # The drafts are older than tickets 2 and 3; all but the first wait on.
    assert [(r.ticket_id, r.draft_reply) for r in spark.read.parquet(f"{root}/late-rows").collect()] == [(1, "See [link removed]")]
    run("evaluate", root, responses="responses", encoder="encoder", scores="scores", report="r12", per_query="per_query")
    assert report(root, "r12")["num_queries"] == 2 and report(root, "r12")["link_redaction_rate"] == 1.0
