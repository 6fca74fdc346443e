"""Tickets and drafts that arrive apart."""

from datetime import timedelta

import pytest
from rows import at

from threadloom.schemas import DRAFT, RETRIEVED
from threadloom.streaming import arrivals

TICKETS = f"ticket_id bigint, text string, retrieved array<{RETRIEVED.simpleString()}>, arrived_at timestamp"
DRAFTS = f"ticket_id bigint, draft {DRAFT.simpleString()}, drafted_at timestamp"
PATIENCE = timedelta(hours=2)


class Desk:
    """Two folders that files arrive in, and what the stream makes of them."""

    def __init__(self, spark, root):
        self.spark = spark
        self.tickets, self.drafts = f"{root}/tickets", f"{root}/drafts"
        self.paths = [f"{root}/{name}" for name in ("triaged", "audit", "refused")]
        self.checkpoint = f"{root}/checkpoint"

    def arrive(self, tickets=(), drafts=()):
        rows = [(key, text, [], time) for key, text, time in tickets]
        self.spark.createDataFrame(rows, TICKETS).write.mode("append").parquet(self.tickets)
        rows = [(key, (reply, [], False), time) for key, reply, time in drafts]
        self.spark.createDataFrame(rows, DRAFTS).write.mode("append").parquet(self.drafts)
        stream = self.spark.readStream
        rows = arrivals.with_late_drafts(
            stream.schema(TICKETS).parquet(self.tickets), stream.schema(DRAFTS).parquet(self.drafts), PATIENCE
        )
        run = arrivals.triage_stream(rows, *self.paths, self.checkpoint)
        run.awaitTermination()
        return run

    def sweep(self, number, before=None):
        arrivals.sweep_unanswered(self.spark.read.schema(TICKETS).parquet(self.tickets), number, *self.paths, before)

    def triaged(self):
        rows = self.spark.read.parquet(self.paths[0]).collect()
        found = {r.ticket_id: (r.draft_reply, r.needs_human_escalation) for r in rows}
        assert len(rows) == len(found)
        return found

    def refused(self):
        return sorted(r.ticket_id for r in self.spark.read.parquet(self.paths[2]).collect())


@pytest.fixture
def desk(spark, tmp_path):
    return Desk(spark, tmp_path)


def test_drafts_come_late_or_never(desk):
    first = [(1, "a drawer sticks", at(8)), (2, "where is my lamp", at(8)), (3, "it hums", at(8)), (4, "", at(8))]
    desk.arrive(first, [(1, "we will look", at(8, 30)), (1, "another look", at(8, 40))])
    # One of the two drafts counts, and the others wait.
    found = desk.triaged()
    assert set(found) == {1} and found[1][0] in ("we will look", "another look") and found[1][1] is False

    # A new run goes on from the state: the draft of 2 is in time, that of 3 is not.
    desk.arrive(
        [(5, "the bell is mute", at(11))],
        [(1, "a third look", at(9)), (2, "on its way", at(10)), (3, "sorry", at(10, 1)), (9, "whose", at(11))],
    )
    assert desk.triaged()[1] == found[1]
    assert desk.triaged()[2] == ("on its way", False)
    assert desk.triaged()[3] == (None, True)
    assert 5 not in desk.triaged() and desk.refused() == [4]


def test_sweep_finds_what_the_join_leaves_out(desk):
    desk.arrive([(1, "a drawer sticks", at(8)), (2, "it hums", at(14))], [(7, "whose", at(14))])
    # The watermark stands at 14: this ticket comes behind it.
    odd = [(3, "too old", at(7)), (4, "no time", None), (None, "no id", at(14)), (6, "", None)]
    run = desk.arrive(odd, [(8, "whose", at(14))])
    assert set(desk.triaged()) == {1}
    before = arrivals.released_before(run, PATIENCE)
    assert before == at(12)
    for _ in range(2):
        desk.sweep(0, before)
        assert desk.triaged() == {key: (None, True) for key in (1, 3, 4)}
        assert desk.refused() == [6]
    # The one that waits is the stream's.
    desk.arrive(drafts=[(2, "oil helps", at(15))])
    assert desk.triaged()[2] == ("oil helps", False)
    desk.sweep(1)
    desk.sweep(1)
    assert desk.triaged() == {1: (None, True), 2: ("oil helps", False), 3: (None, True), 4: (None, True), None: (None, True)}
