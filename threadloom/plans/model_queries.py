"""Queries on splits, metrics, terms, classifiers, the ledger and clusters."""

from dataclasses import replace

from pyspark.sql import functions as F

from threadloom.constants import EXPLORE_CLUSTERS, SEED, TFIDF_MIN_DF, TFIDF_TERMS
from threadloom.operators import classify, explore, metrics, ranks, registry, scores, split, terms
from threadloom.plans import derive, oracle
from threadloom.plans.flow import Flow
from threadloom.plans.registered import query
from threadloom.plans.reply_queries import hash_order_sql
from threadloom.sources.tables import materialize, scratch_path


def _documents(flow: Flow):
    return derive.documents(flow.spark, flow.sf_dir)


# --- split ---------------------------------------------------------------


def _dealt_sql(source: str, size: str, total: str, share: str, name: str) -> str:
    """Largest-remainder shares, in whole numbers."""
    return f"""SELECT s.*, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= want - sum(base) OVER ()
        THEN 1 ELSE 0 END AS BIGINT) AS {name}
      FROM (SELECT *, (CAST({size} AS HUGEINT) * want) // total AS base, (CAST({size} AS HUGEINT) * want) % total AS rest
        FROM (SELECT *, {total} AS total, CAST(floor({share} * {total}) AS BIGINT) AS want FROM {source})) s"""


_SIZES_SQL = f"""counts AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang),
  trained AS (SELECT lang, n, train, n - train AS remaining FROM
    ({_dealt_sql('counts', 'n', 'CAST(sum(n) OVER () AS BIGINT)', 'CAST(0.7 AS DOUBLE)', 'train')})),
  sizes AS (SELECT lang, n, train, val, remaining - val AS test FROM
    ({_dealt_sql('trained', 'remaining', 'CAST(sum(remaining) OVER () AS BIGINT)',
                 '(CAST(0.15 AS DOUBLE) / (1 - CAST(0.7 AS DOUBLE)))', 'val')}))"""
_SPLIT_SQL = f"""{_SIZES_SQL},
  placed AS (SELECT doc_id, lang, row_number() OVER (
    PARTITION BY lang ORDER BY {hash_order_sql('doc_id')}, doc_id) AS place FROM documents),
  parts AS (SELECT doc_id, lang, CASE WHEN place <= train THEN 'train' WHEN place <= train + val THEN 'val'
    ELSE 'test' END AS part FROM placed JOIN sizes USING (lang))"""


@query(f"WITH {_SIZES_SQL} SELECT lang, n, train, val, test FROM sizes")
def split_sizes(flow: Flow):
    """Documents per language in each part."""
    return split.split_sizes(_documents(flow), "lang")


@query(f"WITH {_SPLIT_SQL} SELECT doc_id, lang, part FROM parts")
def stratified_split(flow: Flow):
    """70/15/15 split of the documents with the same share of every language."""
    return split.stratified_split(_documents(flow).select("doc_id", "lang"), "lang", "doc_id")


@query(
    """WITH counts AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
    SELECT lang, CAST(n AS BIGINT) AS n,
      round((SELECT sum(n) FROM counts) / ((SELECT count(*) FROM counts) * CAST(n AS DOUBLE)), 6) AS weight
    FROM counts"""
)
def class_weights(flow: Flow):
    """Balanced weight of every language."""
    return metrics.class_weights(_documents(flow), "lang").withColumn("weight", F.round("weight", 6))


# --- metrics -------------------------------------------------------------


def _metrics_sql(source: str) -> str:
    return f"""labels_used AS (SELECT truth AS label FROM {source} UNION SELECT prediction FROM {source}),
  scored AS (SELECT label,
      CAST((SELECT count(*) FROM {source} WHERE truth = label) AS BIGINT) AS support,
      CAST((SELECT count(*) FROM {source} WHERE prediction = label) AS BIGINT) AS called,
      CAST((SELECT count(*) FROM {source} WHERE prediction = label AND truth = label) AS BIGINT) AS hits
    FROM labels_used),
  classes AS (SELECT label, CASE WHEN called = 0 THEN 0.0 ELSE hits / called END AS p,
    CASE WHEN support = 0 THEN 0.0 ELSE hits / support END AS r,
    CASE WHEN support + called = 0 THEN 0.0 ELSE 2 * hits / (support + called) END AS f1, support, hits
    FROM scored)"""


_SUMMARY_SQL = """SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM classes"""
_GUESSES_SQL = """guesses AS (SELECT lang AS truth, CASE WHEN doc_id % 7 = 0 THEN 'xx'
    WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS prediction FROM documents)"""


def _guesses(flow: Flow):
    guess = (
        F.when(F.col("doc_id") % 7 == 0, "xx").when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang"))
    )
    return _documents(flow).select(F.col("lang").alias("truth"), guess.alias("prediction"))


def _rounded(df, *columns: str):
    return df.select(*(F.round(c, 6).alias(c) if c in columns else c for c in df.columns))


_RATES = ("accuracy", "macro_f1", "weighted_f1")


@query(
    f"""WITH {_GUESSES_SQL}, {_metrics_sql('guesses')}
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM classes"""
)
def metrics_per_class(flow: Flow):
    """Precision, recall and F1, with a class that is never true."""
    classes = metrics.per_class(metrics.confusion(_guesses(flow), "truth", "prediction"))
    return _rounded(classes.drop("hits"), "precision", "recall", "f1")


@query(f"WITH {_GUESSES_SQL}, {_metrics_sql('guesses')} {_SUMMARY_SQL}")
def metrics_summary(flow: Flow):
    """Accuracy and averaged F1."""
    return _rounded(metrics.evaluate(_guesses(flow), "truth", "prediction").drop("per_class"), *_RATES)


@query(
    f"""WITH {_SPLIT_SQL},
    winner AS (SELECT lang AS best FROM parts WHERE part = 'train' GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
    guesses AS (SELECT lang AS truth, best AS prediction FROM parts, winner WHERE part = 'test'),
    {_metrics_sql('guesses')} {_SUMMARY_SQL}"""
)
def majority_baseline(flow: Flow):
    """The commonest training label scored on the test part."""
    parts = materialize(
        split.stratified_split(_documents(flow).select("doc_id", "lang"), "lang", "doc_id"), "parts"
    )
    guessed = metrics.with_majority(parts.where("part = 'train'"), parts.where("part = 'test'"), "lang")
    return _rounded(metrics.evaluate(guessed, "lang", "prediction").drop("per_class"), *_RATES)


@query("SELECT median(CAST(l_extendedprice AS DOUBLE) / 7) AS median FROM lineitem")
def narrowed_median(flow: Flow):
    """Median of values that nearly all differ, found by narrowing ranges of them."""
    prices = derive.read(flow.spark, flow.sf_dir, "lineitem").select((F.col("l_extendedprice").cast("double") / 7).alias("v"))
    return ranks.exact_median(prices, "v", most=500)


# --- terms ---------------------------------------------------------------


@query(
    f"""WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '{oracle.WORD}{{2,}}') AS w FROM documents),
    grams AS (SELECT doc_id, unnest(w) AS term FROM words
      UNION ALL SELECT doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))
      FROM words WHERE len(w) > 1),
    counted AS (SELECT term, CAST(count(*) AS BIGINT) AS tf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df
      FROM grams GROUP BY term)
    SELECT term, tf, df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 6) AS idf
    FROM counted WHERE df >= {TFIDF_MIN_DF} ORDER BY tf DESC, term LIMIT {TFIDF_TERMS}"""
)
def tfidf_terms(flow: Flow):
    """Commonest words and word pairs of the documents with their weights."""
    termed = terms.with_terms(_documents(flow).select("doc_id", "text"))
    return _rounded(terms.term_table(termed, TFIDF_TERMS, TFIDF_MIN_DF), "idf")


_TFIDF_PARTS = oracle.tfidf_parts("documents", "doc_id", "text", TFIDF_TERMS, TFIDF_MIN_DF)


def _weighted_terms(flow: Flow):
    """Counts of the kept terms of every document and its unit weights, in one row."""
    texts = _documents(flow).select("doc_id", "text")
    kept = scores.vocabulary(texts, "text", TFIDF_TERMS, TFIDF_MIN_DF)
    return scores.tfidf_vectors(texts, kept, "doc_id")


@query(oracle.with_parts(_TFIDF_PARTS, "SELECT key AS doc_id, term, round(weight, 6) AS weight FROM unit"))
def tfidf_vectors(flow: Flow):
    """The TF-IDF vector of every document, a row for each of its terms."""
    return _weighted_terms(flow).triples().select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    oracle.with_parts(
        _TFIDF_PARTS | oracle.odds_parts("documents", "doc_id", "lang"),
        "SELECT key AS doc_id, prediction, round(score, 6) AS prediction_score FROM best_lang",
    )
)
def linear_scores(flow: Flow):
    """Language of every document by a linear model over its terms, scored by a join."""
    vectors = _weighted_terms(flow)
    vectors = replace(vectors, rows=materialize(vectors.rows, "term-vectors"))
    labels = _documents(flow).select("doc_id", "lang")
    model = scores.word_odds(vectors, labels, "doc_id", "lang")
    found = scores.predicted(labels.select("doc_id"), vectors.triples(), model, "doc_id")
    return found.withColumn("prediction_score", F.round("prediction_score", 6))


@query(
    oracle.with_parts(
        {k: v for k, v in _TFIDF_PARTS.items() if k in ("words", "counts")}
        | {
            "hashed": """SELECT key, CAST(CAST('0x' || substr(md5(term), 1, 7) AS BIGINT) % 384 AS INTEGER) AS dimension,
              sum(CASE WHEN CAST('0x' || substr(md5(term), 8, 1) AS INTEGER) % 2 = 0 THEN 1 + ln(n) ELSE -1 - ln(n) END) AS v
              FROM counts GROUP BY ALL""",
            "unit": "SELECT key, dimension, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS value FROM hashed",
        },
        "SELECT key AS doc_id, dimension, round(value, 6) AS value FROM unit WHERE abs(value) > 1e-9",
    )
)
def hashed_vectors(flow: Flow):
    """Every document as a vector of 384 numbers hashed from its terms, a row for each that is not zero."""
    counts = scores.term_counts(_documents(flow).select("doc_id", "text"), "doc_id")
    rows = scores.hashed_vectors(counts, "doc_id").select("doc_id", F.posexplode("vector").alias("dimension", "value"))
    return rows.where(F.abs("value") > 1e-9).withColumn("value", F.round("value", 6))


# --- ledger --------------------------------------------------------------

# One version per event type and hour, scored by the events of that hour.
_VERSIONS_SQL = """SELECT event_type AS model_name,
    CAST(row_number() OVER (PARTITION BY event_type ORDER BY hour) AS BIGINT) AS version,
    test_macro_f1, baseline_macro_f1
  FROM (SELECT event_type, date_trunc('hour', ts) AS hour,
      CAST((sum(user_id) % 97) AS DOUBLE) / 100 AS test_macro_f1,
      CAST((count(*) % 5) AS DOUBLE) / 10 AS baseline_macro_f1
    FROM {events} GROUP BY event_type, date_trunc('hour', ts)) AS scores"""
_LEDGER_SQL = f"""WITH versions AS ({_VERSIONS_SQL.format(events='events')}),
  known AS (SELECT *, max(CASE WHEN test_macro_f1 - baseline_macro_f1 >= 0.05 THEN test_macro_f1 END) OVER (
      PARTITION BY model_name ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
    FROM versions),
  ledger AS (SELECT model_name, version, test_macro_f1, baseline_macro_f1,
    CASE WHEN test_macro_f1 - baseline_macro_f1 < CAST(0.05 AS DOUBLE) THEN 'rejected'
      WHEN best IS NULL OR test_macro_f1 >= best THEN 'promoted-to-production' ELSE 'staged-only' END AS outcome,
    CASE WHEN test_macro_f1 - baseline_macro_f1 < CAST(0.05 AS DOUBLE)
        THEN printf('gains %.4f over the majority class, 0.05 is asked for',
          test_macro_f1 - baseline_macro_f1)
      WHEN best IS NULL THEN 'first version that gains enough; nothing is in production yet'
      WHEN test_macro_f1 >= best THEN printf('at least as good as production, which has %.4f', best)
      ELSE printf('worse than production, which has %.4f; waits in staging', best) END AS reason FROM known)"""


def _versions(flow: Flow):
    return flow.spark.sql(_VERSIONS_SQL, events=derive.read(flow.spark, flow.sf_dir, "events"))


@query(f"{_LEDGER_SQL} SELECT * FROM ledger")
def promotion(flow: Flow):
    """Outcome and reason of every registered version, in order."""
    return registry.replay(_versions(flow))


@query(
    f"""{_LEDGER_SQL} SELECT model_name, max(version) AS latest_version,
      max(version) FILTER (WHERE outcome <> 'rejected') AS staging_version,
      max(version) FILTER (WHERE outcome = 'promoted-to-production') AS production_version
    FROM ledger GROUP BY model_name"""
)
def registry_alias(flow: Flow):
    """Latest, staging and production version of every model."""
    return registry.aliases(registry.replay(_versions(flow)))


@query(
    f"""{_LEDGER_SQL}, incumbent AS (SELECT model_name, max(version) AS latest,
        max_by(test_macro_f1, version) FILTER (WHERE outcome = 'promoted-to-production') AS best
      FROM ledger GROUP BY model_name)
    SELECT model_name, latest + 1 AS version, CAST(0.5 AS DOUBLE) AS test_macro_f1,
      CAST(0.25 AS DOUBLE) AS baseline_macro_f1,
      CASE WHEN best IS NULL OR 0.5 >= best THEN 'promoted-to-production' ELSE 'staged-only' END AS outcome
    FROM incumbent"""
)
def register_version(flow: Flow):
    """A further version of every model against its incumbent."""
    ledger = registry.replay(_versions(flow))
    candidates = ledger.select("model_name").distinct().select(
        "model_name", F.lit(0.5).alias("test_macro_f1"), F.lit(0.25).alias("baseline_macro_f1")
    )
    return registry.register(ledger, candidates).drop("reason")


@query(
    """WITH trials AS (SELECT event_type, CAST(user_id AS INTEGER) AS trial,
        round(CAST(count(*) AS DOUBLE) / 100, 2) AS val_macro_f1 FROM events GROUP BY event_type, user_id)
    SELECT event_type, trial, val_macro_f1 FROM (SELECT *, row_number() OVER (
      PARTITION BY event_type ORDER BY val_macro_f1 DESC, trial) AS place FROM trials) WHERE place = 1"""
)
def best_trial(flow: Flow):
    """Best trial per group; the first wins a tie."""
    trials = (
        derive.read(flow.spark, flow.sf_dir, "events")
        .groupBy("event_type", F.col("user_id").cast("int").alias("trial"))
        .agg(F.round(F.count(F.lit(1)).cast("double") / 100, 2).alias("val_macro_f1"))
    )
    return registry.best_trial(trials, "event_type")


# --- classifiers and clusters: no SQL form -------------------------------


def _parts(flow: Flow):
    return materialize(
        split.stratified_split(flow.stored_labeled.select("ticket_id", "text", "category", "priority")), "parts"
    )


@query()
def text_classifier(flow: Flow):
    """Majority baseline and trained model for the ticket category."""
    model, report = classify.train_and_evaluate(_parts(flow), "category")
    path = scratch_path(flow.spark, "category-model")
    classify.save_model(model, path)
    classify.load_model(path)
    return report.drop("per_class")


@query()
def tune_classifier(flow: Flow):
    """The six trials for the ticket priority."""
    _, trials, _ = classify.tune(_parts(flow), "priority")
    return trials


@query()
def predict_labels(flow: Flow):
    """Predicted category of every ticket."""
    parts = _parts(flow)
    model, _ = classify.train_and_evaluate(parts, "category")
    return classify.predict(model, parts.select("ticket_id", "text"), "predicted_category")


@query(
    oracle.flow_sql(
        "tickets",
        f"""SELECT CAST(count(*) AS BIGINT) AS sample_size, CAST({EXPLORE_CLUSTERS} AS BIGINT) AS clusters,
          CAST(count(*) AS BIGINT) AS clustered FROM tickets""",
    )
)
def cluster_totals(flow: Flow):
    """Every ticket is in one cluster."""
    return explore_clusters(flow).agg(
        F.first("sample_size").alias("sample_size"), F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("clustered")
    )


@query()
def explore_clusters(flow: Flow):
    """Clusters of the ticket texts with their commonest terms."""
    tickets = materialize(flow.tickets.select("ticket_id", "text", "brand_id"), "tickets")
    report = explore.explore(tickets, min_df=2)
    return report.select(
        "sample_size", "n_clusters", F.round("explained_variance_ratio", 4).alias("explained_variance_ratio"),
        F.explode("clusters").alias("c"),
    ).select(
        "sample_size", "n_clusters", "explained_variance_ratio", "c.cluster_id", "c.size",
        F.array_join("c.top_terms", ", ").alias("top_terms"),
    )


@query(
    oracle.flow_sql(
        "tickets",
        """SELECT term, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT ticket_id) AS BIGINT) AS df
        FROM (SELECT ticket_id, unnest(w || list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS term
          FROM kept WHERE len(w) > 1 UNION ALL SELECT ticket_id, w[1] FROM kept WHERE len(w) = 1) GROUP BY term""",
        stops=f"SELECT list(DISTINCT regexp_extract(lower(text), '{oracle.WORD}{{2,}}')) AS b FROM tickets WHERE text_length % 2 = 0",
        kept=f"""SELECT ticket_id, list_filter(regexp_extract_all(lower(text), '{oracle.WORD}{{2,}}'),
          lambda x: NOT list_contains(b, x)) AS w FROM tickets, stops""",
    )
)
def opening_free_terms(flow: Flow):
    """Terms of the ticket texts without the words that open a text of even length, and in how many texts they are."""
    tickets = materialize(flow.tickets.select("ticket_id", "text", "text_length"), "tickets")
    stops = terms.with_terms(tickets.where(F.col("text_length") % 2 == 0)).select(F.get("terms", F.lit(0)).alias("word"))
    each = terms.terms_without(tickets, "ticket_id", stops).select("ticket_id", F.explode("terms").alias("term"))
    by_text = each.groupBy("ticket_id", "term").count()
    return by_text.groupBy("term").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("df"))


@query(
    f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {hash_order_sql('doc_id')}, doc_id) AS place
      FROM documents) WHERE place <= 150"""
)
def fixed_sample(flow: Flow):
    """Exactly 150 documents in hash order."""
    return split.fixed_sample(_documents(flow).select("doc_id"), "doc_id", 150, SEED)
