import random

import pytest
from rows import as_dict, at, links, tweets

from threadloom.operators import knowledge, threads, tickets
from threadloom.operators.threads import thread_roots


def walk(pairs):
    """Roots by following parents, lowest id for circles."""
    parent = dict(pairs)
    roots = {}
    for start in parent:
        seen, here = [], start
        while here not in seen:
            seen.append(here)
            up = parent[here]
            if up is None or up not in parent or up == here:
                break
            here = up
        else:
            here = min(seen[seen.index(here):])
        roots[start] = here
    return roots


CASES = {
    "chain": [(1, None), (2, 1), (3, 2)],
    "broken link": [(5, 999)],
    "self reply": [(1, 1), (2, 1)],
    "circle": [(1, 3), (2, 1), (3, 2), (4, 2), (5, 4), (6, None), (7, 6)],
    "two circles with tails": [(10, 11), (11, 10), (1, 10), (20, 22), (22, 21), (21, 20), (2, 1), (3, 2), (30, 20)],
    "long chain": [(1, None)] + [(i, i - 1) for i in range(2, 200)],
    "star": [(1, None)] + [(i, 1) for i in range(2, 100)],
    "star below a chain": [(1, None), (2, 1), (3, 2)] + [(i, 3) for i in range(4, 60)],
    "no replies": [(1, None), (2, None)],
}


@pytest.mark.parametrize("name", CASES)
def test_roots(spark, name):
    assert as_dict(thread_roots(links(spark, CASES[name]))) == walk(CASES[name])


@pytest.mark.parametrize("name", ["star", "star below a chain", "circle"])
def test_roots_with_hot_keys(spark, skewed, name):
    assert as_dict(thread_roots(links(spark, CASES[name]))) == walk(CASES[name])


@pytest.mark.parametrize("seed", [1, 2])
def test_roots_of_random_replies(spark, seed):
    pick = random.Random(seed)
    pairs = [(i, pick.choice([None, pick.randrange(0, 150), pick.randrange(0, i + 1)])) for i in range(120)]
    roots = thread_roots(links(spark, pairs).repartition(3))
    assert as_dict(roots) == walk(pairs)


@pytest.mark.parametrize(("length", "most"), [(2, 3), (3, 4), (40, 8)])
def test_circles_end_by_their_own_length(spark, monkeypatch, length, most):
    """Many circles take no more writes than one, which is about log2 of its length."""
    writes = []
    store = threads._store
    monkeypatch.setattr(threads, "_store", lambda step: writes.append(1) or store(step))
    rows = [(c * 100 + i, c * 100 + (i + 1) % length) for c in range(4_000 // length) for i in range(length)]
    assert as_dict(thread_roots(links(spark, rows))) == {i: i // 100 * 100 for i, _ in rows}
    assert len(writes) <= most


def test_long_tail_of_a_circle_with_lower_ids(spark):
    rows = [(500, 501), (501, 502), (502, 500)] + [(i, i + 1) for i in range(1, 60)] + [(60, 501)]
    assert as_dict(thread_roots(links(spark, rows))) == {i: 500 for i, _ in rows}


def test_resolved_ticket(spark):
    df = tweets(
        spark,
        {"tweet_id": 1, "text_clean": "two wo𝒳ds"},
        {"tweet_id": 2, "author_id": "slowmart", "inbound": False, "created_at": at(1), "in_response_to_tweet_id": 1},
        {"tweet_id": 3, "author_id": "quickmart", "inbound": False, "created_at": at(0, 7), "in_response_to_tweet_id": 2},
        {"tweet_id": 4, "author_id": "midmart", "inbound": False, "created_at": at(0, 7), "in_response_to_tweet_id": 1},
    )
    row = tickets.build_ticket_features(df).first()
    assert (row.ticket_id, row.customer_id, row.brand_id) == (1, "ana", "quickmart")
    assert (row.num_messages, row.num_customer_messages, row.num_brand_messages) == (4, 1, 3)
    assert row.first_response_seconds == 420.0 and row.resolved
    assert (row.text_length, row.word_count) == (9, 2)


def test_unresolved_ticket_and_early_reply(spark):
    df = tweets(
        spark,
        {"tweet_id": 1},
        {"tweet_id": 2, "created_at": at(1)},
        {"tweet_id": 3, "inbound": False, "created_at": at(0, 59), "in_response_to_tweet_id": 2},
    )
    rows = {r.ticket_id: r for r in tickets.build_ticket_features(df).collect()}
    assert rows[1].first_response_seconds is None and not rows[1].resolved and rows[1].brand_id is None
    assert rows[2].first_response_seconds == -60.0


def test_brand_opened_thread_is_no_ticket(spark):
    df = tweets(spark, {"tweet_id": 1, "inbound": False}, {"tweet_id": 2, "in_response_to_tweet_id": 1})
    assert tickets.build_ticket_features(df).count() == 0


def feature_report(df):
    from threadloom.operators.threads import reply_roots

    roots = reply_roots(df)
    return tickets.feature_report(df, roots, tickets.build_ticket_features(df, roots)).first().asDict()


def test_feature_report(spark):
    df = tweets(
        spark,
        {"tweet_id": 1},
        {"tweet_id": 2, "inbound": False, "created_at": at(0, 1), "in_response_to_tweet_id": 1},
        {"tweet_id": 3},
        {"tweet_id": 4, "inbound": False, "created_at": at(0, 4), "in_response_to_tweet_id": 3},
        {"tweet_id": 5},
        {"tweet_id": 6, "inbound": False},
        {"tweet_id": 7, "in_response_to_tweet_id": 8},
        {"tweet_id": 8, "in_response_to_tweet_id": 7},
    )
    assert feature_report(df) == {
        "total_tweets": 8, "total_threads": 5, "tickets_extracted": 4, "tickets_with_brand_response": 2,
        "median_first_response_seconds": 150.0, "max_first_response_seconds": 240.0,
    }
    empty = feature_report(tweets(spark, {"tweet_id": 1, "inbound": False}))
    assert empty["median_first_response_seconds"] is None and empty["tickets_extracted"] == 0


def test_knowledge_base_takes_the_earliest_reply_with_text(spark):
    df = tweets(
        spark,
        {"tweet_id": 1},
        {"tweet_id": 2, "inbound": False, "created_at": at(0, 10), "in_response_to_tweet_id": 1, "text_clean": "later"},
        {"tweet_id": 3, "inbound": False, "created_at": at(0, 5), "in_response_to_tweet_id": 1, "text_clean": "earlier"},
        {"tweet_id": 4, "inbound": False, "created_at": at(0, 1), "in_response_to_tweet_id": 1, "text_clean": None},
        {"tweet_id": 9},
    )
    labeled = spark.createDataFrame(
        [(1, "Technical Support", "Low", "root"), (9, "General Inquiry", "Low", "alone")],
        "ticket_id bigint, category string, priority string, text string",
    )
    kb = knowledge.build_knowledge_base(df, labeled)
    assert [r.asDict() for r in kb.collect()] == [
        {"ticket_id": 1, "category": "Technical Support", "priority": "Low", "customer_message": "root",
         "resolution_text": "earlier"}
    ]
    assert knowledge.knowledge_base_report(labeled, kb).first().asDict() == {
        "tickets_in": 2, "resolutions_found": 1, "resolutions_missing": 1,
    }
