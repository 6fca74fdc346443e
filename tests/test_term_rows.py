"""Terms of a text are counted in its row."""

from pyspark.sql import functions as F

from threadloom.operators import scores, terms


def texts(spark, ids):
    rows = [(i, f"red fish red {'blue' if n % 2 else 'dog'} w{n % 3}" if n % 5 else None) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id bigint, text string")


def counted(rows):
    found = {}
    for row in rows.collect():
        words = (row.text or "").split()
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            found[row.id, term] = found.get((row.id, term), 0) + 1
    return found


def test_terms_of_texts_with_their_own_keys_are_not_shuffled(spark):
    df = texts(spark, range(20))
    rows = scores.term_counts(df, "id")
    assert {(r.id, r.term): r.n for r in rows.collect()} == counted(df)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_terms_of_repeated_and_missing_keys_are_summed(spark):
    df = texts(spark, [1, 2, 2, None, 3, None, 4, 2, 5, 6, 7])
    expected = counted(df)
    assert {(r.id, r.term): r.n for r in scores.term_counts(df, "id").collect()} == expected
    kept = scores.vocabulary(df, "text", 50, 2)
    old = scores.tfidf_triples(scores.term_counts(df, "id"), kept, "id")
    new = scores.tfidf_vectors(df, kept, "id").triples()
    assert {(r.id, r.term): round(r.weight, 9) for r in new.collect()} == {(r.id, r.term): round(r.weight, 9) for r in old.collect()}


def test_word_odds_of_vectors_equal_those_of_counts(spark):
    df = texts(spark, [1, 2, 2, 4, 5, 6, 7, 8]).withColumn("label", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    kept = scores.vocabulary(df, "text", 50, 2)
    counts = scores.term_counts(df, "id").join(kept.select("term"), "term")
    old = scores.word_odds(counts, df.select("id", "label"), "id", "label")
    new = scores.word_odds(scores.tfidf_vectors(df, kept, "id"), df.select("id", "label"), "id", "label")
    assert new.classes == old.classes and new.intercepts == old.intercepts
    assert {r.term: r.weights for r in new.coefficients.collect()} == {r.term: r.weights for r in old.coefficients.collect()}


def test_term_table_counts_a_text_by_itself(spark):
    termed = terms.with_terms(texts(spark, [1, 1, 2, 3, 4, 6]))
    rows = {r.term: (r.tf, r.df) for r in terms.term_table(termed, 100, 1).collect()}
    assert rows["red"] == (8, 4) and rows["red fish"] == (4, 4) and rows["dog"] == (2, 2)
