import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from threadloom.operators import classify, embed, explore, nearest, scores, terms
from threadloom.operators.split import stratified_split


def vectors(spark, matrix, name="id", column="vector"):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, {column} array<float>")


def brute_force(queries, index, k):
    distance = ((queries[:, None, :].astype(np.float64) - index[None, :, :]) ** 2).sum(axis=2)
    return {
        (q, place + 1): int(i)
        for q in range(len(queries))
        for place, i in enumerate(np.lexsort((np.arange(len(index)), distance[q]))[:k])
    }


@pytest.mark.parametrize("tile", [1000, 40])
def test_nearest_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(nearest, "TILE_BYTES", tile * 8 * 8)
    monkeypatch.setattr(nearest, "PART_BYTES", 30 * 8 * 8)
    draw = np.random.default_rng(3)
    index = draw.normal(size=(120, 8)).astype(np.float32)
    index[50:90] = index[50]  # a third are copies
    queries = np.concatenate([draw.normal(size=(40, 8)).astype(np.float32), index[48:52]])
    hits = nearest.nearest(vectors(spark, queries, "query_id"), vectors(spark, index), 5).collect()
    assert {(r.query_id, r.place): r.id for r in hits} == brute_force(queries, index, 5)


@pytest.mark.parametrize(("tile", "cells"), [(1000, None), (20, 5), (20, 1)])
def test_all_cells_give_the_exact_rows(spark, monkeypatch, tile, cells):
    monkeypatch.setattr(nearest, "TILE_BYTES", tile * 8 * 8)
    monkeypatch.setattr(nearest, "PART_BYTES", 15 * 8 * 8)
    draw = np.random.default_rng(4)
    index = draw.normal(size=(120, 8)).astype(np.float32)
    index[50:90] = index[50]
    queries = np.concatenate([draw.normal(size=(40, 8)).astype(np.float32), index[48:52]])
    hits = nearest.nearest_cells(vectors(spark, queries, "query_id"), vectors(spark, index), 5, cells).collect()
    assert {(r.query_id, r.place): r.id for r in hits} == brute_force(queries, index, 5)


def test_cells_recall_and_one_shuffle_of_the_index(spark):
    draw = np.random.default_rng(5)
    around = draw.normal(size=(12, 16))
    index = (around[np.arange(600) % 12] + 0.2 * draw.normal(size=(600, 16))).astype(np.float32)
    queries = (around[np.arange(60) % 12] + 0.2 * draw.normal(size=(60, 16))).astype(np.float32)
    found = nearest.nearest_cells(vectors(spark, queries, "query_id"), vectors(spark, index), 5, cells=12, probes=3)
    hits = {(r.query_id, r.id) for r in found.collect()}
    wanted = {(q, i) for (q, _), i in brute_force(queries, index, 5).items()}
    assert len(hits & wanted) >= 0.95 * len(wanted)
    # Queries and index are dealt out once each; the third exchange has k rows per query and group.
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("AdaptiveSparkPlan") :].split("== Initial Plan ==")[-1]
    assert initial.count("Exchange hashpartitioning") == 3 and initial.count("BroadcastHashJoin") == 2


def test_cells_with_short_or_empty_sides(spark):
    queries = vectors(spark, np.eye(3), "query_id")
    nothing = vectors(spark, np.eye(3)).where("false")
    one = vectors(spark, np.eye(3)[:1])
    same = vectors(spark, np.ones((9, 3)))
    unknown = spark.createDataFrame([(7, None)], "id bigint, vector array<float>")
    assert nearest.nearest_cells(queries, nothing, 3).count() == 0
    assert nearest.nearest_cells(queries.where("false"), same, 3).count() == 0
    assert nearest.nearest_cells(queries, one.union(unknown), 3).count() == 3
    # Equal vectors make fewer cells than were asked for; ties go to lower ids.
    rows = nearest.nearest_cells(queries, same, 2, cells=4).collect()
    assert {(r.place, r.id) for r in rows} == {(1, 0), (2, 1)} and len(rows) == 6


def grouped(draw, rows, around):
    return (around[np.arange(rows) % len(around)] + 0.2 * draw.normal(size=(rows, around.shape[1]))).astype(np.float32)


@pytest.mark.parametrize(("tile", "cells", "rings"), [(1000, None, 4), (20, 12, 3), (20, 1, 1), (1000, 40, 2)])
def test_pruned_cells_give_the_exact_rows(spark, monkeypatch, tile, cells, rings):
    monkeypatch.setattr(nearest, "TILE_BYTES", tile * 8 * 8)
    monkeypatch.setattr(nearest, "PART_BYTES", 15 * 8 * 8)
    draw = np.random.default_rng(6)
    around = draw.normal(size=(12, 8))
    index = grouped(draw, 300, around)
    index[50:90] = index[50]
    queries = np.concatenate([grouped(draw, 40, around), index[48:52], 50 * draw.normal(size=(3, 8)).astype(np.float32)])
    found = nearest.nearest_pruned(vectors(spark, queries, "query_id"), vectors(spark, index), 5, cells, rings)
    rows = found.hits.collect()
    assert {(r.query_id, r.place): r.id for r in rows} == brute_force(queries, index, 5)
    assert len(rows) == 5 * len(queries)
    if cells != 1:
        assert found.visited < 0.6 * found.pairs


def test_pruned_cells_with_short_or_empty_sides(spark):
    queries = vectors(spark, np.eye(3), "query_id")
    same = vectors(spark, np.ones((9, 3)))
    unknown = spark.createDataFrame([(7, None)], "id bigint, vector array<float>")
    assert nearest.nearest_pruned(queries, same.where("false"), 3).hits.count() == 0
    assert nearest.nearest_pruned(queries.where("false"), same, 3).hits.count() == 0
    assert nearest.nearest_pruned(queries, vectors(spark, np.eye(3)[:1]).union(unknown), 3).hits.count() == 3
    rows = nearest.nearest_pruned(queries, same, 2, cells=4).hits.collect()
    assert {(r.place, r.id) for r in rows} == {(1, 0), (2, 1)} and len(rows) == 6


def test_probes_by_recall(spark):
    """Neighbours over the borders of many cells; the recall that was asked for is reached."""
    draw = np.random.default_rng(7)
    index = draw.normal(size=(2_000, 6)).astype(np.float32)
    queries = draw.normal(size=(300, 6)).astype(np.float32)
    wanted = {(q, i) for (q, _), i in brute_force(queries, index, 5).items()}
    probes = []
    for recall in (0.5, 0.9, 1.1):
        rows = nearest.nearest_calibrated(vectors(spark, queries, "query_id"), vectors(spark, index), 5, recall, cells=40, drawn=200).collect()
        hits = {(r.query_id, r.id) for r in rows}
        assert len(hits) == len(rows) and len({(r.query_id, r.place) for r in rows}) == len(rows)
        assert len(hits & wanted) >= min(1.0, recall) * len(wanted)
        (p,) = {r.probes for r in rows}
        (measured,) = {r.measured_recall for r in rows}
        assert measured >= min(1.0, recall)
        probes.append(p)
    assert probes[0] < probes[1] < probes[2] == 40


def test_nearest_with_a_short_or_empty_index(spark):
    queries = vectors(spark, np.eye(3), "query_id")
    assert nearest.nearest(queries, vectors(spark, np.eye(3)[:2]), 3).count() == 6
    assert nearest.nearest(queries, vectors(spark, np.eye(3)).where("false"), 3).count() == 0


def test_retrieve_orders_examples(spark, skewed):
    index = spark.createDataFrame(
        [(i, "c", "p", f"m{i}", f"r{i}") for i in range(3)],
        "id bigint, category string, priority string, customer_message string, resolution_text string",
    )
    hits = spark.createDataFrame(
        [(q, i, float(i), i + 1) for q in range(6) for i in range(3)],
        "query_id bigint, id bigint, distance double, place int",
    )
    rows = nearest.retrieve(hits, index).collect()
    assert len(rows) == 6
    assert all([e.ticket_id for e in r.retrieved] == ["0", "1", "2"] for r in rows)
    assert rows[0].retrieved[1].resolution_text == "r1"


def test_term_table(spark):
    df = spark.createDataFrame(
        [(1, "Red fish, red"), (2, "red fish a"), (3, "blue"), (4, None)], "id bigint, text string"
    )
    termed = terms.with_terms(df)
    assert termed.columns == ["id", "text", "terms"]
    assert [r.terms for r in termed.orderBy("id").collect()] == [
        ["red", "fish", "red", "red fish", "fish red"], ["red", "fish", "red fish"], ["blue"], [],
    ]
    rows = terms.term_table(termed, 10, 2).collect()
    assert [(r.term, r.tf, r.df) for r in rows] == [("red", 3, 2), ("fish", 2, 2), ("red fish", 2, 2)]
    assert rows[0].idf == pytest.approx(np.log(5 / 3) + 1)
    assert terms.term_table(termed, 10, 1, 0.25).where("term = 'red'").count() == 0


def test_tfidf_vectors_and_stop_words(spark):
    df = spark.createDataFrame([(1, "the red fish"), (2, "red dog")], "id bigint, text string")
    model = terms.fit_tfidf(df, "text", 10, 1, stop_words=["the"])
    assert set(terms.vocabulary_of(model)) == {"red", "fish", "dog", "red fish", "red dog"}
    out = model.transform(df)
    assert out.columns == ["id", "text", "features"]
    assert all(r.features.norm(2) == pytest.approx(1.0) for r in out.collect())


@pytest.fixture(params=["broadcast", "salted"])
def either_join(request):
    if request.param == "salted":
        request.getfixturevalue("skewed")


def test_terms_without_a_table_of_words(spark, either_join):
    texts = ["Acme lamp acme broke", "the lamp", "acme", "", None, "zen the acme lamp"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    stops = spark.createDataFrame([("acme",), ("acme",), ("zen",), (None,), ("unmet",)], "word string")
    found = {r.id: r.terms for r in terms.terms_without(df, "id", stops, stop_words=["the"]).collect()}
    # Pairs go over the words that are left.
    assert found == {0: ["lamp", "broke", "lamp broke"], 1: ["lamp"], 2: [], 3: [], 4: [], 5: ["lamp"]}
    none = {r.id: r.terms for r in terms.terms_without(df, "id", stops.where("false")).collect()}
    assert none == {r.id: r.terms for r in terms.with_terms(df).collect()}
    assert terms.terms_without(df.where("false"), "id", stops).count() == 0


def test_embed(spark):
    df = spark.createDataFrame([(1, "red fish"), (2, None), (3, "red fish")], "id bigint, text string")
    out = embed.embed(df, "text", embed.fit_hashed_tfidf(df, "text", 32)).orderBy("id").collect()
    assert len(out[0].embedding) == 32 and out[0].embedding == out[2].embedding
    assert out[1].text is None and set(out[1].embedding) == {0.0}
    lengths = embed.embed(df, "text", lambda c: F.array(F.length(c).cast("float")))
    assert lengths.first().embedding == [8.0]


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"Billing": "charged invoice payment", "Technical": "crash error frozen", "General": "hours weekend store"}
    rows = []
    for n, (name, text) in enumerate(words.items()):
        for i in range(30):
            parts = text.split()
            rows.append((n * 100 + i, f"{parts[i % 3]} {parts[(i + 1) % 3]} number {i % 7}", name))
    return spark.createDataFrame(rows, "ticket_id bigint, text string, category string")


def test_classifier_learns_and_reloads(spark, labelled, tmp_path):
    parts = stratified_split(labelled)
    model, report = classify.train_and_evaluate(parts, "category", iterations=30)
    f1 = {(r.model, r.part): r.macro_f1 for r in report.collect()}
    assert f1["tfidf+logreg", "test"] > 0.9 > 0.5 > f1["majority-baseline", "test"]
    classify.save_model(model, str(tmp_path / "model"))
    again = classify.load_model(str(tmp_path / "model"))
    rows = classify.predict(again, labelled.limit(5), "guess")
    assert rows.columns == ["ticket_id", "text", "category", "guess"]
    assert rows.where("guess = category").count() == 5


def test_tuning(spark, labelled):
    parts = stratified_split(labelled)
    model, trials, test = classify.tune(
        parts, "category", grid=((1.0, None), (1.0, "balanced")), iterations=20
    )
    assert [r.trial for r in trials.orderBy("trial").collect()] == [0, 1]
    assert test.first().macro_f1 > 0.9
    assert classify.predict(model, labelled).count() == 90


def test_explore(spark, labelled):
    tickets = labelled.withColumn("brand_id", F.lit("Store"))
    row = explore.explore(
        tickets, sample_size=90, clusters=3, terms=50, min_df=2, max_df=0.9, components=5, restarts=2
    ).first()
    assert row.sample_size == 90 and len(row.clusters) == 3
    assert sum(c["size"] for c in row.clusters) == 90
    assert 0.0 < row.explained_variance_ratio <= 1.0
    found = {t for c in row.clusters for t in c.top_terms}
    assert "charged" in found and "store" not in found  # the brand name is stopped


def labelled_texts(spark):
    words = {"a": ["parcel", "late", "courier"], "b": ["crash", "error", "screen"], "c": ["refund", "charged", "late"]}
    rows = [(i, " ".join(words["abc"[i % 3]][: 1 + i % 3] + [f"word{i % 7}"]), "abc"[i % 3]) for i in range(90)]
    return spark.createDataFrame(rows, "id bigint, text string, label string")


def test_scores_by_a_join_equal_the_fitted_pipeline(spark):
    df = labelled_texts(spark)
    vectors = terms.fit_tfidf(df, "text", 50, 2)
    fitted = classify.fit_classifier(vectors.transform(df), "label", 1.0, "balanced", 90, 20)
    pipeline = PipelineModel(stages=vectors.stages + fitted.stages)
    more = df.union(spark.createDataFrame([(900, "nothing known here", None), (901, "", None), (902, None, None)], df.schema))
    expected = {r.id: r.prediction for r in classify.predict(pipeline, more).collect()}
    kept = scores.vocabulary(df, "text", 50, 2)
    triples = scores.tfidf_triples(scores.term_counts(more, "id"), kept, "id")
    found = scores.predicted(more, triples, scores.fitted_model(spark, pipeline), "id").collect()
    assert {r.id: r.prediction for r in found} == expected and len(found) == 93
    row = triples.where("id = 5").agg(F.sum(F.col("weight") * F.col("weight"))).first()[0]
    assert abs(row - 1.0) < 1e-9


def test_hashed_vectors_are_of_unit_length(spark):
    df = labelled_texts(spark).union(spark.createDataFrame([(901, "", None), (902, None, None)], "id bigint, text string, label string"))
    rows = {r.id: r.vector for r in scores.hashed_vectors(scores.term_counts(df, "id"), "id", 16).collect()}
    assert set(rows) <= set(range(90)) and len(rows) > 80
    assert all(len(v) == 16 and abs(sum(x * x for x in v) - 1.0) < 1e-9 for v in rows.values())
    assert rows[0] == rows[21 * 3]
