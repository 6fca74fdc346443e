import random
import statistics

import pytest
from pyspark.sql import functions as F

from threadloom.operators import metrics, ranks, registry, split


def classes(spark, **sizes):
    rows, ticket = [], 0
    for name, size in sizes.items():
        for _ in range(size):
            rows.append((ticket, name, f"text {ticket}"))
            ticket += 1
    return spark.createDataFrame(rows, "ticket_id bigint, category string, text string")


def parts_of(df):
    return {r.ticket_id: (r.category, r.part) for r in split.stratified_split(df).collect()}


def test_split_is_exact_disjoint_and_whole(spark):
    parts = parts_of(classes(spark, A=200, B=200, C=200))
    assert len(parts) == 600
    sizes = {name: sum(part == name for _, part in parts.values()) for name in ("train", "val", "test")}
    assert sizes == {"train": 420, "val": 90 - 1, "test": 91}  # floor(0.4999... * 180) rows go to val
    for category in "ABC":
        assert sum(c == category and p == "train" for c, p in parts.values()) == 140


def test_published_split_sizes(spark):
    sizes = {
        "General Inquiry": 607146, "Order / Delivery / Refund": 67604, "Technical Support": 42804,
        "Customer Service Complaint": 25516, "Billing & Payments": 25002, "Account Access": 12039,
        "Product Complaint": 9436,
    }
    rows = spark.createDataFrame(list(sizes.items()), "category string, n bigint")
    df = rows.select("category", F.explode(F.sequence(F.lit(1), "n")).alias("ticket_id"))
    total = split.split_sizes(df).agg(F.sum("train"), F.sum("val"), F.sum("test")).first()
    assert tuple(total) == (552682, 118432, 118433)


def test_split_does_not_depend_on_partitions(spark):
    df = classes(spark, A=97, B=13, C=5)
    assert parts_of(df.repartition(7)) == parts_of(df.coalesce(1))


def test_split_with_a_hot_class(spark, skewed):
    parts = parts_of(classes(spark, A=90, B=10))
    assert sum(p == "train" for _, p in parts.values()) == 70


def test_capped_sample(spark):
    df = classes(spark, A=1000, B=50, C=5).unionByName(
        spark.createDataFrame([(-1, None, "x")], "ticket_id bigint, category string, text string")
    )
    picked = split.capped_sample(df, cap=100)
    counts = {r.category: r["count"] for r in picked.groupBy("category").count().collect()}
    assert counts == {"A": 100, "B": 50, "C": 5}
    ids = {r.ticket_id for r in picked.collect()}
    assert len(ids) == 155
    assert ids == {r.ticket_id for r in split.capped_sample(df.repartition(5), cap=100).collect()}


def test_capped_sample_is_the_lowest_in_hash_order(spark):
    df = classes(spark, A=300).withColumn("o", ranks.hash_order("ticket_id", 42))
    lowest = {r.ticket_id for r in df.orderBy("o", "ticket_id").limit(37).collect()}
    assert {r.ticket_id for r in split.capped_sample(df, cap=37).collect()} == lowest


def test_fixed_sample(spark):
    df = classes(spark, A=100)
    assert split.fixed_sample(df, "ticket_id", 40).count() == 40
    with pytest.raises(ValueError):
        split.fixed_sample(df, "ticket_id", 101)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50 + [1.0, 90000.0], list(range(0, 200000, 977)),
                                    [-70000.0, -1.5, 2.25, 1e6], [1.0, 1.0, 99999.0, 99999.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert ranks.exact_median(df, "v").first()[0] == statistics.median(values)


def evaluated(spark, truth, guess):
    df = spark.createDataFrame(list(zip(truth, guess)), "truth string, guess string")
    return metrics.evaluate(df, "truth", "guess").first()


def test_metrics(spark):
    perfect = evaluated(spark, "ABAB", "ABAB")
    assert (perfect.accuracy, perfect.macro_f1, perfect.weighted_f1) == (1.0, 1.0, 1.0)
    wrong = evaluated(spark, "AABB", "BBAA")
    assert (wrong.accuracy, wrong.macro_f1) == (0.0, 0.0)
    mixed = evaluated(spark, "AAB", "ABB")
    assert mixed.per_class["A"].support == 2 and mixed.per_class["B"].support == 1
    assert mixed.per_class["A"].precision == 1.0 and mixed.per_class["A"].recall == 0.5
    assert mixed.accuracy == pytest.approx(2 / 3)
    unseen = evaluated(spark, "AA", "AC")
    assert unseen.per_class["C"].f1 == 0.0 and unseen.macro_f1 == pytest.approx(1 / 3)


def test_majority_and_weights(spark):
    train = classes(spark, B=3, A=3, C=1)
    assert metrics.majority_label(train, "category").first()[0] == "A"
    scored = metrics.with_majority(train, classes(spark, C=2), "category")
    assert {r.prediction for r in scored.collect()} == {"A"}
    weights = {r.category: r.weight for r in metrics.class_weights(train, "category").collect()}
    assert weights == pytest.approx({"A": 7 / 9, "B": 7 / 9, "C": 7 / 3})


def decide(spark, test, baseline, production):
    outcome, reason = registry.decide(F.lit(test), F.lit(baseline), F.lit(production).cast("double"))
    return tuple(spark.range(1).select(outcome, reason).first())


def test_promotion_rule(spark):
    assert decide(spark, 0.30, 0.28, None) == (
        "rejected", "gains 0.0200 over the majority class, 0.05 is asked for",
    )
    assert decide(spark, 0.90, 0.10, None)[0] == "promoted-to-production"
    assert decide(spark, 0.95, 0.10, 0.90) == (
        "promoted-to-production", "at least as good as production, which has 0.9000",
    )
    assert decide(spark, 0.85, 0.10, 0.90) == (
        "staged-only", "worse than production, which has 0.9000; waits in staging",
    )
    assert decide(spark, 0.90, 0.10, 0.90)[0] == "promoted-to-production"
    assert decide(spark, 0.351, 0.30, None)[0] == "promoted-to-production"
    assert decide(spark, 0.349, 0.30, None)[0] == "rejected"


def test_ledger_step_by_step_equals_replay(spark, tmp_path):
    path = str(tmp_path / "ledger")
    scores = [(0.30, 0.28), (0.90, 0.10), (0.85, 0.10), (0.90, 0.10)]
    name = "ticket-category-classifier"
    with pytest.raises(LookupError):
        registry.require_production(registry.read_ledger(spark, path), name)
    for test, baseline in scores:
        tuning = spark.createDataFrame([("category", test)], "target string, test_macro_f1 double")
        evaluation = spark.createDataFrame([("category", baseline)], "target string, baseline_macro_f1 double")
        registry.register_reports(spark, tuning, evaluation, path)
    ledger = registry.read_ledger(spark, path)
    outcomes = [r.outcome for r in ledger.orderBy("version").collect()]
    assert outcomes == ["rejected", "promoted-to-production", "staged-only", "promoted-to-production"]
    versions = spark.createDataFrame(
        [(name, i + 1, *s) for i, s in enumerate(scores)],
        "model_name string, version bigint, test_macro_f1 double, baseline_macro_f1 double",
    )
    assert sorted(registry.replay(versions).collect()) == sorted(ledger.collect())
    assert registry.require_production(ledger, name) == 4
    third = ledger.where("version <= 3")
    assert tuple(registry.aliases(third).first()) == (name, 3, 3, 2)
    assert registry.incumbent_f1(third, name).first()[0] == 0.90
    assert registry.incumbent_f1(third, "other").first()[0] is None


def test_best_trial(spark):
    rows = [(0, 0.1, 0.40), (1, 1.0, 0.55), (2, 10.0, 0.50), (3, 20.0, 0.55)]
    trials = spark.createDataFrame(rows, "trial int, c double, val_macro_f1 double")
    assert registry.best_trial(trials).first().trial == 1


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    registry.log_run(spark, path, "category-tune", "category", {"c": 1.0}, {"val_macro_f1": 0.5})
    registry.log_run(spark, path, "category-best", "category", {}, {"test_macro_f1": 0.6})
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("cell_rows", [1, 3, 20, 10_000])
def test_ranks_through_several_levels(spark, cell_rows, monkeypatch):
    """Two bits a level and few rows a bucket: the hash is taken down as far as it has to be."""
    written = []
    counted = ranks.materialize_counted
    monkeypatch.setattr(ranks, "materialize_counted", lambda df, name, **more: written.append(name) or counted(df, name, **more))
    df = classes(spark, A=300, B=40, C=1).withColumn("o", ranks.hash_order("ticket_id", 42))
    wanted = [(c, f"{c}{r}", r) for c, n in (("A", 300), ("B", 40), ("C", 1)) for r in (1, 2, n // 2, n, n + 1)]
    found = ranks.rank_cuts(
        df, "category", "ticket_id", F.col("o"), spark.createDataFrame(wanted, "category string, name string, rank bigint"),
        bits=2, cell_rows=cell_rows,
    )
    rows = {(r.category, r.name): (r.cut_order, r.cut_key) for r in found.collect()}
    order = {c: sorted((r.o, r.ticket_id) for r in df.where(F.col("category") == c).collect()) for c in "ABC"}
    assert rows == {(c, name): order[c][r - 1] for c, name, r in wanted if 1 <= r <= len(order[c])}
    assert written.count("rank-cells") >= (3 if cell_rows <= 3 else 1)


@pytest.mark.parametrize("n", [1, 2, 999, 1_000])
def test_median_by_narrowing(spark, n, monkeypatch):
    """Fractions that all differ, values far out, and many equal ones, with few rows a range."""
    monkeypatch.setattr(ranks, "RANGES", 8)
    rng = random.Random(n)
    values = [rng.random() / 7 for _ in range(n)] + [1e300, -1e300][: n // 3] + [0.07] * (n // 10)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert ranks.exact_median(df, "v", most=10).first()[0] == statistics.median(values)


def test_median_of_nothing(spark):
    assert ranks.exact_median(spark.createDataFrame([(None,)], "v double"), "v").first()[0] is None
