"""Queries over drafted replies: prompts, checks, scores, triage and streams."""

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from threadloom.constants import EVALUATION_QUERIES, PROMPT_INSTRUCTIONS, PROMPT_REQUEST, SEED, TFIDF_MIN_DF, TFIDF_TERMS
from threadloom.functions import safety
from threadloom.functions.vectors import cosine
from threadloom.operators import drafts, embed, evaluate, label, nearest, scores, triage
from threadloom.operators.split import capped_sample
from threadloom.plans import derive, oracle
from threadloom.plans.flow import Flow
from threadloom.plans.oracle import CLAIMS, SEVERE, flow_sql, text
from threadloom.plans.registered import query
from threadloom.plans.ticket_queries import _LANDING_VIEW_SQL, _PARSED_SQL, _landing_view
from threadloom.schemas import RETRIEVED
from threadloom.sources.csv import write_raw_csv
from threadloom.sources.tables import append_table, materialize, read_table, scratch_path, write_table
from threadloom.streaming import arrivals

RETRIEVED_LIST = ArrayType(RETRIEVED)
# How long a ticket waits for its draft in the stream of late drafts.
PATIENCE_HOURS = 4
LINK = f"'https?://{oracle.NOT_BLANK}+'"
HANDLE = f"'@{oracle.WORD}+'"


def no_links(column: str) -> str:
    return f"regexp_replace({column}, {LINK}, '[link removed]', 'g')"


def redacted(column: str) -> str:
    return f"regexp_replace({no_links(column)}, {HANDLE}, '[handle removed]', 'g')"


def hash_order_sql(key: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}:' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


def _documents(flow: Flow):
    return derive.documents(flow.spark, flow.sf_dir)


def _embeddings(flow: Flow):
    return derive.read(flow.spark, flow.sf_dir, "embeddings")


@query(
    flow_sql(
        "kb",
        f"""SELECT ticket_id, {text(PROMPT_INSTRUCTIONS)} || chr(10) || chr(10)
          || 'Example 1 (ticket ' || ticket_id || ', category: ' || category || '):' || chr(10)
          || 'Customer: ' || customer_message || chr(10) || 'Support reply: ' || resolution_text
          || chr(10) || chr(10)
          || 'Example 2 (ticket ' || (ticket_id + 1) || ', category: ' || category || '):' || chr(10)
          || 'Customer: ' || customer_message || chr(10) || 'Support reply: ' || resolution_text
          || chr(10) || chr(10) || 'New ticket:' || chr(10) || customer_message
          || chr(10) || chr(10) || {text(PROMPT_REQUEST)} AS prompt FROM kb""",
    )
)
def prompt_text(flow: Flow):
    """Prompts with two numbered examples per ticket."""
    examples = F.transform(
        F.array(F.lit(0), F.lit(1)),
        lambda i: F.struct(
            (F.col("ticket_id") + i).cast("string").alias("ticket_id"),
            F.col("category"), F.col("customer_message"), F.col("resolution_text"),
        ),
    )
    rows = flow.knowledge.withColumn("query", F.col("customer_message")).withColumn("retrieved", examples)
    return drafts.with_prompt(rows).select("ticket_id", "prompt")


@query(
    flow_sql(
        "clean",
        """SELECT tweet_id,
          CASE WHEN tweet_id % 7 IN (0, 1, 2, 3) THEN NULL ELSE text END AS reply,
          CASE WHEN tweet_id % 7 IN (0, 1, 2, 3) THEN NULL WHEN tweet_id % 7 = 4 THEN ''
            ELSE CAST(tweet_id AS VARCHAR) || ',7' END AS cited,
          CASE WHEN tweet_id % 7 IN (0, 1, 2, 3) THEN NULL ELSE tweet_id % 2 = 0 END AS escalate,
          CASE tweet_id % 7 WHEN 0 THEN 'not a JSON object' WHEN 1 THEN 'reply is not a string'
            WHEN 2 THEN 'needs_human_escalation is not a flag'
            WHEN 3 THEN 'cited_ticket_ids is not a list of strings' END AS error FROM clean""",
    )
)
def parse_drafts(flow: Flow):
    """Draft JSON to typed rows; five kinds of damage and a missing list."""
    kind = F.col("tweet_id") % 7
    reply = F.to_json(F.struct("text"))
    reply = F.concat(F.lit('"reply":'), F.expr("substr(to_json(struct(text)), 9, length(to_json(struct(text))) - 9)"))
    flag = F.concat(F.lit('"needs_human_escalation":'), (F.col("tweet_id") % 2 == 0).cast("string"))
    cited = F.concat(F.lit('"cited_ticket_ids":["'), F.col("tweet_id").cast("string"), F.lit('","7"]'))

    def whole(*parts):
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    json = (
        F.when(kind == 0, F.concat(F.lit("Sure! "), whole(reply, flag)))
        .when(kind == 1, whole(F.lit('"reply":5'), cited, flag))
        .when(kind == 2, whole(reply, cited))
        .when(kind == 3, whole(reply, F.lit('"cited_ticket_ids":[1]'), flag))
        .when(kind == 4, whole(reply, flag))
        .otherwise(whole(reply, cited, flag))
    )
    parsed = drafts.parse_drafts(flow.tweets.select("tweet_id", json.alias("draft_json")))
    return parsed.select(
        "tweet_id",
        F.col("draft.reply").alias("reply"),
        F.array_join("draft.cited_ticket_ids", ",").alias("cited"),
        F.col("draft.needs_human_escalation").alias("escalate"),
        F.col("draft_error").alias("error"),
    )


@query(
    flow_sql(
        "drafted",
        """SELECT draft_id, ticket_id || ',' || ticket_id AS verified, 'x' || ticket_id AS hallucinated
        FROM drafted""",
    )
)
def verify_citations(flow: Flow):
    """Cited ids split into retrieved and made up; order and repeats kept."""
    retrieved = F.transform("retrieved", lambda r: r["ticket_id"])
    cited = F.col("draft.cited_ticket_ids")
    return flow.drafted.select(
        "draft_id",
        F.array_join(safety.verified_citations(cited, retrieved), ",").alias("verified"),
        F.array_join(safety.unverified_citations(cited, retrieved), ",").alias("hallucinated"),
    )


@query(
    f"""SELECT doc_id, {no_links('text')} AS reply, {no_links('text')} <> text AS link_redacted
    FROM documents"""
)
def redact_links(flow: Flow):
    """Whole documents with links marked out."""
    reply = safety.without_links(F.col("text"))
    return _documents(flow).select("doc_id", "text", reply.alias("reply")).select(
        "doc_id", "reply", (F.col("reply") != F.col("text")).alias("link_redacted")
    )


@query(
    f"""SELECT doc_id, regexp_replace(text, {HANDLE}, '[handle removed]', 'g') AS reply,
      regexp_replace(text, {HANDLE}, '[handle removed]', 'g') <> text AS mention_redacted FROM documents"""
)
def redact_handles(flow: Flow):
    """Whole documents with handles marked out."""
    reply = safety.without_handles(F.col("text"))
    return _documents(flow).select("doc_id", "text", reply.alias("reply")).select(
        "doc_id", "reply", (F.col("reply") != F.col("text")).alias("mention_redacted")
    )


@query(
    flow_sql(
        "clean",
        f"""SELECT tweet_id, regexp_matches({redacted('text')}, {CLAIMS}) AS completed_action_claimed
        FROM clean""",
    )
)
def completed_claims(flow: Flow):
    """Which texts, once redacted, claim an action was taken."""
    reply = safety.without_handles(safety.without_links(F.col("text")))
    return flow.tweets.select(
        "tweet_id", safety.claims_completed_action(reply).alias("completed_action_claimed")
    )


@query(
    flow_sql(
        "clean", f"SELECT tweet_id, regexp_matches(text, {SEVERE}) AS ticket_severity_signaled FROM clean"
    )
)
def severity(flow: Flow):
    """Which texts speak of legal, safety or fraud matters."""
    return flow.tweets.select(
        "tweet_id", safety.signals_severity(F.col("text")).alias("ticket_severity_signaled")
    )


_CHECKED_SQL = f"""SELECT draft_id, text, query, category, priority, ticket_id,
    {redacted('text')} AS reply,
    {no_links('text')} <> text AS link_redacted,
    {redacted('text')} <> {no_links('text')} AS mention_redacted,
    regexp_matches({redacted('text')}, {CLAIMS}) AS completed_action_claimed,
    regexp_matches(query, {SEVERE}) AS ticket_severity_signaled
  FROM drafted"""
_ESCALATE_SQL = """draft_id % 5 = 0 OR link_redacted OR mention_redacted OR completed_action_claimed
  OR ticket_severity_signaled"""
_FLAG_NAMES = (
    "link_redacted", "mention_redacted", "completed_action_claimed", "ticket_severity_signaled",
    "needs_human_escalation",
)


@query(
    flow_sql(
        "drafted",
        f"""SELECT draft_id, query, reply, ticket_id || ',' || ticket_id AS cited_ticket_ids,
          'x' || ticket_id AS hallucinated_citations, link_redacted, mention_redacted,
          completed_action_claimed, ticket_severity_signaled, {_ESCALATE_SQL} AS needs_human_escalation,
          'llama3.2:3b' AS generation_model FROM responses""",
        responses=_CHECKED_SQL,
    )
)
def check_drafts(flow: Flow):
    """Response rows: redacted reply, citations, flags, escalation."""
    rows = flow.drafted.withColumnRenamed("draft_id", "key")
    checked = drafts.check_drafts(
        rows.select("key", "query"), rows.select("key", "retrieved"), rows.select("key", "draft"), "key"
    )
    return checked.select(
        F.col("key").alias("draft_id"), "query", "reply",
        F.array_join("cited_ticket_ids", ",").alias("cited_ticket_ids"),
        F.array_join("hallucinated_citations", ",").alias("hallucinated_citations"),
        *_FLAG_NAMES, "generation_model",
    )


@query(
    flow_sql(
        "drafted",
        f"""SELECT needs_human_escalation, link_redacted, mention_redacted, completed_action_claimed,
          ticket_severity_signaled, CAST(count(*) AS BIGINT) AS drafts
        FROM (SELECT *, {_ESCALATE_SQL} AS needs_human_escalation FROM responses) GROUP BY ALL""",
        responses=_CHECKED_SQL,
    )
)
def escalation(flow: Flow):
    """Drafts by the reasons that escalate them."""
    return drafts.checked_reply(flow.drafted).groupBy(*_FLAG_NAMES).agg(F.count(F.lit(1)).alias("drafts"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _cosine_sql(a: str, b: str) -> str:
    return (
        f"{_DOT.format(a=a, b=b)} / (sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)}))"
    )


@query(
    f"""SELECT e.vec_id, round({_cosine_sql('e.embedding', 'f.embedding')}, 6) AS similarity
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) f"""
)
def cosine_similarity(flow: Flow):
    """Cosine of the first vector against all vectors."""
    vectors = _embeddings(flow)
    first = vectors.agg(F.min_by("embedding", "vec_id")).scalar()
    return vectors.withColumn("_first", first).select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("_first")), 6).alias("similarity")
    )


def _scored(flow: Flow):
    """Every document as a reply, with the next two documents as its retrieved
    replies; all are embedded from their texts. Ids are unique on every side."""
    documents = _documents(flow).select("doc_id", "text")

    def example(by: int):
        ticket = (F.col("doc_id")).cast("string").alias("ticket_id")
        return documents.select(
            (F.col("doc_id") - by).alias("doc_id"), F.struct(ticket, F.col("text").alias("resolution_text")).alias(f"next_{by}")
        )

    rows = documents.join(example(1), "doc_id", "left").join(example(2), "doc_id", "left")
    own = F.col("doc_id").cast("string")
    cited = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("none"))).otherwise(
        F.array((F.col("doc_id") + 1).cast("string"))
    )
    responses = drafts.checked_reply(
        rows.select(
            "doc_id",
            F.col("text").alias("query"),
            F.array_compact(F.array("next_1", "next_2")).alias("retrieved"),
            F.struct(
                F.col("text").alias("reply"),
                F.when(F.col("doc_id") % 7 == 0, F.array(own)).otherwise(cited).alias("cited_ticket_ids"),
                (F.col("doc_id") % 4 == 0).alias("needs_human_escalation"),
            ).alias("draft"),
        )
    )
    return evaluate.score_responses(evaluate.with_vectors(responses, derive.letter_counts, "doc_id"))


# The last document has no next one: what it cites is made up, and it is like nothing.
_SCORED_SQL = f"""WITH base AS (
    SELECT d.doc_id, d.text AS query, b.doc_id AS b_id, {oracle.letter_counts(redacted('d.text'))} AS v, {oracle.letter_counts('b.text')} AS n1,
      {oracle.letter_counts('c.text')} AS n2
    FROM documents d LEFT JOIN documents b ON b.doc_id = d.doc_id + 1 LEFT JOIN documents c ON c.doc_id = d.doc_id + 2),
  likeness AS (
    SELECT *, {redacted('query')} AS reply, {no_links('query')} <> query AS link_redacted,
      {redacted('query')} <> {no_links('query')} AS mention_redacted,
      CASE WHEN n1[2] IS NOT NULL THEN {_cosine_sql('v', 'n1')} END AS s1,
      CASE WHEN n2[2] IS NOT NULL THEN {_cosine_sql('v', 'n2')} END AS s2
    FROM base),
  flagged AS (SELECT *, regexp_matches(reply, {CLAIMS}) AS completed_action_claimed,
    regexp_matches(query, {SEVERE}) AS ticket_severity_signaled,
    CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND b_id IS NOT NULL THEN 1 ELSE 0 END AS num_citations
    FROM likeness),
  scored AS (SELECT doc_id, CAST(length(reply) AS INTEGER) AS reply_length,
    length(trim(reply)) >= 10 AS reply_nonempty, num_citations,
    1 - num_citations AS num_hallucinated_citations,
    link_redacted, mention_redacted, completed_action_claimed, ticket_severity_signaled,
    doc_id % 4 = 0 OR link_redacted OR mention_redacted OR completed_action_claimed
      OR ticket_severity_signaled AS needs_human_escalation,
    greatest(s1, coalesce(s2, s1)) AS max_s,
    CASE WHEN s2 IS NULL THEN s1 ELSE (s1 + s2) / 2 END AS mean_s FROM flagged)"""


@query(
    f"""{_SCORED_SQL}
    SELECT doc_id, reply_length, reply_nonempty, num_citations, num_hallucinated_citations, link_redacted,
      mention_redacted, completed_action_claimed, ticket_severity_signaled, needs_human_escalation,
      round(max_s, 6) AS max_groundedness_similarity, round(mean_s, 6) AS mean_groundedness_similarity
    FROM scored"""
)
def score_response(flow: Flow):
    """Length, citations, flags and likeness of every reply."""
    return _scored(flow).select(
        "doc_id", "reply_length", "reply_nonempty", "num_citations", "num_hallucinated_citations",
        *_FLAG_NAMES,
        F.round("max_groundedness_similarity", 6).alias("max_groundedness_similarity"),
        F.round("mean_groundedness_similarity", 6).alias("mean_groundedness_similarity"),
    )


_FIXED_QUERY_SQL = (
    "CASE CAST(doc_id % 12 AS INTEGER) "
    + " ".join(f"WHEN {i} THEN {text(fixed)}" for i, fixed in enumerate(EVALUATION_QUERIES))
    + " END"
)


@query(
    f"""{_SCORED_SQL} SELECT doc_id, {_FIXED_QUERY_SQL} AS query, reply_length, num_hallucinated_citations,
      round(mean_s, 6) AS mean_groundedness_similarity FROM scored WHERE doc_id % 12 < {len(EVALUATION_QUERIES)}"""
)
def evaluation_rows(flow: Flow):
    """Scores of the replies to the fixed test queries; half of the replies answer one."""
    fixed = F.get(F.array(*map(F.lit, EVALUATION_QUERIES)), (F.col("doc_id") % 12).cast("int"))
    scores = _scored(flow).withColumn("query", F.coalesce(fixed, F.col("query")))
    queries = flow.spark.createDataFrame([(fixed,) for fixed in EVALUATION_QUERIES], "query string")
    return evaluate.per_query(scores, queries).select(
        "doc_id", "query", "reply_length", "num_hallucinated_citations",
        F.round("mean_groundedness_similarity", 6).alias("mean_groundedness_similarity"),
    )


def _rate_sql(test: str, name: str) -> str:
    return f"round(avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END), 6) AS {name}"


@query(
    f"""{_SCORED_SQL}
    SELECT CAST(count(*) AS BIGINT) AS num_queries,
      {_rate_sql('num_hallucinated_citations > 0', 'hallucination_rate')},
      {', '.join(_rate_sql(flag, name) for name, flag in evaluate.SUMMARY_FLAGS.items())},
      round(avg(mean_s), 6) AS mean_groundedness_similarity,
      CAST(count(*) FILTER (WHERE NOT reply_nonempty) AS BIGINT) AS empty_or_short_replies FROM scored"""
)
def safety_summary(flow: Flow):
    """Rates over all replies."""
    summary = evaluate.summarize(_scored(flow))
    rates = [c for c in summary.columns if c not in ("num_queries", "empty_or_short_replies")]
    return summary.select(
        "num_queries", *(F.round(c, 6).alias(c) for c in rates), "empty_or_short_replies"
    )


@query(
    f"""SELECT lang, source, CAST(count(*) FILTER (WHERE {no_links('text')} <> text) AS BIGINT) AS raised,
      CAST(count(*) AS BIGINT) AS runs,
      round(avg(CASE WHEN {no_links('text')} <> text THEN 1.0 ELSE 0.0 END), 6) AS rate
    FROM documents GROUP BY lang, source"""
)
def flag_rate(flow: Flow):
    """How often texts hold a link, by language and source."""
    linked = _documents(flow).select(
        "lang", "source", (safety.without_links(F.col("text")) != F.col("text")).alias("link_redacted")
    )
    return evaluate.flag_rates(linked, "link_redacted", "lang", "source").withColumn(
        "rate", F.round("rate", 6)
    )


KNN_SQL = """WITH ranked AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
  list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p:
    (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS d
  FROM embeddings a CROSS JOIN embeddings b),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS place FROM ranked)
SELECT query_id, id, round(d, 6) AS distance, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 3"""


@query(KNN_SQL)
def knn_exact(flow: Flow):
    """The three nearest vectors of every vector, itself included."""
    vectors = _embeddings(flow)
    hits = nearest.nearest(
        vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")),
    )
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), "place")


@query(KNN_SQL)
def knn_cells(flow: Flow):
    """The same through cells around centres, all of them probed."""
    vectors = _embeddings(flow)
    hits = nearest.nearest_cells(
        vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")),
    )
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), "place")


@query(KNN_SQL)
def knn_pruned(flow: Flow):
    """The same from the rings of cells that bounds do not rule out."""
    vectors = _embeddings(flow)
    hits = nearest.nearest_pruned(
        vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")),
    ).hits
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), "place")


@query(
    """WITH ranked AS (SELECT a.vec_id AS ticket_id, b.vec_id AS id,
      list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p:
        (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS d
      FROM embeddings a CROSS JOIN (SELECT e.* FROM embeddings e JOIN documents ON doc_id = vec_id) b),
    placed AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY d, id) AS place FROM ranked)
    SELECT ticket_id, string_agg(id || ':' || lang || ':' || n_chars, ',' ORDER BY place) AS examples
    FROM placed JOIN documents ON doc_id = id WHERE place <= 3 GROUP BY ticket_id"""
)
def retrieved_examples(flow: Flow):
    """The three nearest examples of every ticket with their texts, nearest first."""
    vectors = _embeddings(flow)
    texts = _documents(flow).select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("category"),
        F.col("source").alias("priority"),
        F.col("text").alias("customer_message"),
        F.col("n_chars").cast("string").alias("resolution_text"),
    )
    index = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    hits = nearest.nearest(
        index.withColumnRenamed("id", "query_id"), index.join(texts.select("id"), "id", "left_semi")
    )
    line = F.transform("retrieved", lambda r: F.concat_ws(":", r["ticket_id"], r["category"], r["resolution_text"]))
    return nearest.retrieve(hits, texts).select("ticket_id", F.array_join(line, ",").alias("examples"))


@query(
    f"""SELECT vec_id, label FROM (SELECT *, row_number() OVER (
      PARTITION BY label ORDER BY {hash_order_sql('vec_id')}, vec_id) AS place FROM embeddings)
    WHERE place <= 40"""
)
def sample_per_label(flow: Flow):
    """At most 40 vectors of each label, in hash order."""
    return capped_sample(_embeddings(flow).select("vec_id", "label"), "label", "vec_id", 40)


@query(
    flow_sql(
        "kb",
        """SELECT CAST(ticket_id AS VARCHAR) AS id, customer_message AS document, category, priority,
          resolution_text, 384 AS dimensions FROM kb""",
    )
)
def vector_index(flow: Flow):
    """The knowledge base embedded, stored by category, read back."""
    sampled = flow.stored_knowledge
    encoder = embed.fit_hashed_tfidf(sampled, "customer_message")
    path = scratch_path(flow.spark, "vector-index")
    write_table(
        embed.embed(sampled, "customer_message", encoder).select(
            F.col("ticket_id").cast("string").alias("id"), "embedding",
            F.col("customer_message").alias("document"),
            F.struct("category", "priority", "resolution_text").alias("metadata"), "category",
        ),
        path,
        ("category",),
    )
    return read_table(flow.spark, path).select(
        "id", "document", "metadata.category", "metadata.priority", "metadata.resolution_text",
        F.size("embedding").alias("dimensions"),
    )


@query(
    flow_sql(
        "kb",
        """SELECT (SELECT CAST(count(*) AS BIGINT) FROM kb) AS knowledge_base_size,
          (SELECT CAST(count(*) AS BIGINT) FROM kb) AS indexed_size,
          string_agg(category || '=' || n, ',' ORDER BY category) AS category_counts
        FROM (SELECT category, count(*) AS n FROM kb GROUP BY category)""",
    )
)
def index_report(flow: Flow):
    """Sizes of the knowledge base and of its index."""
    report = embed.index_report(flow.stored_knowledge, flow.stored_knowledge, "hashed-tfidf")
    counts = F.transform(F.map_entries("category_counts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return report.select(
        "knowledge_base_size", "indexed_size", F.array_join(counts, ",").alias("category_counts")
    )


@query(
    flow_sql(
        "landing",
        """SELECT tweet_id, author_id, CASE WHEN text IS NULL THEN 'text is missing' ELSE 'text is empty' END AS error
        FROM landing WHERE text IS NULL OR text = ''""",
    )
)
def triage_input(flow: Flow):
    """Tickets refused for having no text; blanks are let through."""
    return triage.refused_tickets(flow.landing).select("tweet_id", "author_id", "error")


def _triaged(flow: Flow):
    """Drafts triaged with the rule labels in place of a model, in one pass."""
    labels = label.label_tickets(flow.drafted.withColumn("text", F.col("query")))
    labels = labels.withColumnRenamed("category", "predicted_category").withColumnRenamed("priority", "predicted_priority")
    return triage.triage_columns(drafts.checked_reply(labels), "draft_id")


_TRIAGED_SQL = f"""SELECT *, {_ESCALATE_SQL} AS needs_human_escalation FROM responses"""


@query(
    flow_sql(
        "drafted",
        """SELECT draft_id, query AS ticket_text, category AS predicted_category,
          priority AS predicted_priority, reply AS draft_reply,
          ticket_id || ',' || ticket_id AS cited_ticket_ids, link_redacted, mention_redacted,
          completed_action_claimed, ticket_severity_signaled, needs_human_escalation FROM triaged""",
        responses=_CHECKED_SQL,
        triaged=_TRIAGED_SQL,
    )
)
def triage_rows(flow: Flow):
    """Labels and checked reply of every ticket."""
    return _triaged(flow).withColumn("cited_ticket_ids", F.array_join("cited_ticket_ids", ","))


@query(
    flow_sql(
        "drafted",
        """SELECT draft_id, CAST(length(query) AS INTEGER) AS text_length, category AS predicted_category,
          priority AS predicted_priority, link_redacted, mention_redacted, completed_action_claimed,
          ticket_severity_signaled, needs_human_escalation FROM triaged""",
        responses=_CHECKED_SQL,
        triaged=_TRIAGED_SQL,
    )
)
def triage_audit(flow: Flow):
    """Audit rows: text length and flags, no text."""
    return triage.audit(_triaged(flow), "draft_id")


def _partial(flow: Flow):
    """Tickets of the whole flow and the drafts that came for them: some do not
    parse, some tickets have none, and some tickets have no text."""
    kind = F.col("ticket_id") % 5
    tickets = flow.stored_labeled.select(
        "ticket_id", F.when(kind == 4, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.col("category").alias("predicted_category"), F.col("priority").alias("predicted_priority"),
    )
    json = F.when(kind == 1, F.lit('{"reply": 5}')).otherwise(
        F.to_json(F.struct(F.col("text").alias("reply"), F.lit(False).alias("needs_human_escalation")))
    )
    came = drafts.parse_drafts(
        flow.stored_labeled.where(kind != 2).select("ticket_id", json.alias("draft_json"), F.lit("test").alias("generation_model"))
    )
    return tickets, came


@query(
    flow_sql(
        "labeled",
        """SELECT ticket_id, CASE ticket_id % 5 WHEN 1 THEN 'reply is not a string' ELSE 'no draft' END AS error
        FROM labeled WHERE ticket_id % 5 IN (1, 2)""",
    )
)
def draft_rejects(flow: Flow):
    """Accepted tickets without a response, and why."""
    tickets, came = _partial(flow)
    return drafts.draft_rejects(triage.accepted_tickets(tickets), came)


_COMPLETE_SQL = f"""SELECT ticket_id, ticket_id % 5 IN (1, 2) AS lost, text, category, priority,
    {redacted('text')} AS reply, {no_links('text')} <> text AS link_redacted,
    {redacted('text')} <> {no_links('text')} AS mention_redacted,
    regexp_matches({redacted('text')}, {CLAIMS}) AS completed_action_claimed,
    regexp_matches(text, {SEVERE}) AS ticket_severity_signaled
  FROM labeled WHERE ticket_id % 5 <> 4"""


@query(
    flow_sql(
        "labeled",
        """SELECT ticket_id, text AS ticket_text, category AS predicted_category, priority AS predicted_priority,
          CASE WHEN NOT lost THEN reply END AS draft_reply, NOT lost AND link_redacted AS link_redacted,
          NOT lost AND mention_redacted AS mention_redacted,
          NOT lost AND completed_action_claimed AS completed_action_claimed,
          NOT lost AND ticket_severity_signaled AS ticket_severity_signaled,
          lost OR link_redacted OR mention_redacted OR completed_action_claimed OR ticket_severity_signaled
            AS needs_human_escalation FROM whole""",
        whole=_COMPLETE_SQL,
    )
)
def triage_complete(flow: Flow):
    """One row for every accepted ticket, whether its draft was of use or not."""
    tickets, came = _partial(flow)
    accepted = triage.accepted_tickets(tickets)
    none = F.array().cast(RETRIEVED_LIST)
    checked = drafts.check_drafts(
        accepted.select("ticket_id", F.col("text").alias("query")), accepted.select("ticket_id", none.alias("retrieved")), came
    )
    return triage.triage(accepted, checked).drop("cited_ticket_ids")


@query(
    flow_sql(
        "labeled",
        """SELECT ticket_id, CAST(length(text) AS INTEGER) AS text_length, c.prediction AS predicted_category,
          p.prediction AS predicted_priority, NOT lost AND link_redacted AS link_redacted,
          NOT lost AND mention_redacted AS mention_redacted,
          NOT lost AND completed_action_claimed AS completed_action_claimed,
          NOT lost AND ticket_severity_signaled AS ticket_severity_signaled,
          lost OR link_redacted OR mention_redacted OR completed_action_claimed OR ticket_severity_signaled
            AS needs_human_escalation
        FROM whole JOIN best_category c ON c.key = ticket_id JOIN best_priority p ON p.key = ticket_id""",
        whole=_COMPLETE_SQL,
        **oracle.tfidf_parts("labeled", "ticket_id", "text", TFIDF_TERMS, TFIDF_MIN_DF),
        **oracle.odds_parts("labeled", "ticket_id", "category"),
        **oracle.odds_parts("labeled", "ticket_id", "priority"),
    )
)
def triage_predicted(flow: Flow):
    """Audit rows of all accepted tickets, their labels predicted by linear models over their terms."""
    _, came = _partial(flow)
    labeled = flow.stored_labeled.select("ticket_id", "text", "category", "priority")
    kept = scores.vocabulary(labeled, "text", TFIDF_TERMS, TFIDF_MIN_DF)
    counts = materialize(scores.term_counts(labeled, "ticket_id").join(F.broadcast(kept), "term").drop("idf"), "term-counts")
    triples = materialize(scores.tfidf_triples(counts, kept, "ticket_id"), "term-weights")
    rows = labeled.select("ticket_id", F.when(F.col("ticket_id") % 5 == 4, F.lit("")).otherwise(F.col("text")).alias("text"))
    accepted = triage.accepted_tickets(rows)
    for target in ("category", "priority"):
        model = scores.word_odds(counts, labeled, "ticket_id", target)
        accepted = scores.predicted(accepted, triples, model, "ticket_id", f"predicted_{target}").drop(f"predicted_{target}_score")
    none = F.array().cast(RETRIEVED_LIST)
    checked = drafts.check_drafts(
        accepted.select("ticket_id", F.col("text").alias("query")), accepted.select("ticket_id", none.alias("retrieved")), came
    )
    return triage.audit(triage.triage(accepted, checked))


@query(
    flow_sql(
        "labeled",
        """SELECT (SELECT CAST(count(*) AS BIGINT) FROM labeled) AS tickets_in,
          CAST(count(*) FILTER (WHERE ticket_id % 5 <> 4) AS BIGINT) AS triaged,
          CAST(count(*) FILTER (WHERE ticket_id % 5 = 4) AS BIGINT) AS refused FROM labeled""",
    )
)
def triage_counts(flow: Flow):
    """Tickets in, triaged and refused: nothing is lost between."""
    tickets, _ = _partial(flow)
    refused = triage.refused_tickets(tickets).agg(F.count(F.lit(1))).scalar()
    rows = triage_complete(flow).agg(F.count(F.lit(1))).scalar()
    return tickets.agg(F.count(F.lit(1)).alias("tickets_in")).select(
        "tickets_in", rows.alias("triaged"), refused.alias("refused")
    )


@query(flow_sql("raw", _LANDING_VIEW_SQL, parsed=_PARSED_SQL))
def stream_ingest(flow: Flow):
    """The landing table by way of a stream of CSV files."""
    raw_path = scratch_path(flow.spark, "stream-raw")
    write_raw_csv(derive.raw(flow.spark, flow.sf_dir).repartition(4), raw_path)
    landing = scratch_path(flow.spark, "stream-landing")
    arrivals.ingest_stream(
        flow.spark, raw_path, landing, scratch_path(flow.spark, "stream-counts"),
        scratch_path(flow.spark, "stream-checkpoint"), files_per_trigger=2,
    ).awaitTermination()
    return _landing_view(read_table(flow.spark, landing))


def _streamed_sql(lost: str) -> str:
    """Triage rows of tickets some of which have no draft."""
    return flow_sql(
        "drafted",
        f"""SELECT draft_id AS ticket_id, query AS ticket_text, category AS predicted_category,
          priority AS predicted_priority, CASE WHEN NOT lost THEN reply END AS draft_reply,
          NOT lost AND link_redacted AS link_redacted, NOT lost AND mention_redacted AS mention_redacted,
          NOT lost AND completed_action_claimed AS completed_action_claimed,
          NOT lost AND ticket_severity_signaled AS ticket_severity_signaled,
          lost OR needs_human_escalation AS needs_human_escalation
        FROM (SELECT *, {lost} AS lost FROM triaged)""",
        responses=_CHECKED_SQL,
        triaged=_TRIAGED_SQL,
    )


@query(_streamed_sql("draft_id % 7 = 3"))
def stream_triage(flow: Flow):
    """The triage rows by way of a stream of arriving tickets, some of which come without a draft."""
    tickets = flow.drafted.select(
        F.col("draft_id").alias("ticket_id"), F.col("query").alias("text"), "retrieved",
        F.when(F.col("draft_id") % 7 != 3, F.col("draft")).alias("draft"),
    )
    folder = scratch_path(flow.spark, "stream-tickets")
    write_table(tickets, folder)
    arriving = flow.spark.readStream.schema(tickets.schema).parquet(folder)
    triaged = scratch_path(flow.spark, "stream-triage")
    arrivals.triage_stream(
        arriving, triaged, scratch_path(flow.spark, "stream-audit"), scratch_path(flow.spark, "stream-refused"),
        scratch_path(flow.spark, "stream-checkpoint"),
    ).awaitTermination()
    return read_table(flow.spark, triaged).drop("batch", "cited_ticket_ids")


@query(_streamed_sql(f"draft_id % 7 = 3 OR draft_id % 7 > {PATIENCE_HOURS}"))
def stream_late_drafts(flow: Flow):
    """Triage of tickets whose drafts come hours after them, too late, or never.

    Both streams come in two halves by time, and the stream is started anew for
    the second: what waits in the first is kept in the state.
    """
    patience = timedelta(hours=PATIENCE_HOURS)
    arrived = flow.tweets.select(F.col("tweet_id").alias("draft_id"), F.col("created_at").alias("arrived_at"))
    late = F.make_interval(hours=(F.col("draft_id") % 7).cast("int"))
    rows = materialize(
        flow.drafted.join(arrived, "draft_id").select(
            F.col("draft_id").alias("ticket_id"), F.col("query").alias("text"), "retrieved", "arrived_at",
            "draft", (F.col("arrived_at") + late).alias("drafted_at"),
        ),
        "late-drafts",
    )
    tickets = rows.select("ticket_id", "text", "retrieved", "arrived_at")
    came = rows.where(F.col("ticket_id") % 7 != 3).select("ticket_id", "draft", "drafted_at")
    ends = rows.agg(F.min("arrived_at").alias("first"), F.max("arrived_at").alias("last")).first()
    half = F.lit(ends["first"] + (ends["last"] - ends["first"]) / 2) if ends["first"] else F.current_timestamp()
    folders = [scratch_path(flow.spark, f"stream-{name}") for name in ("tickets", "drafts")]
    paths = [scratch_path(flow.spark, f"stream-{name}") for name in ("triage", "audit", "refused")]
    checkpoint = scratch_path(flow.spark, "stream-checkpoint")
    for part in (0, 1):
        for table, time, folder in ((tickets, "arrived_at", folders[0]), (came, "drafted_at", folders[1])):
            second = F.col(time) >= half
            append_table(table.where(second if part else ~second), folder)
        arriving = arrivals.with_late_drafts(
            flow.spark.readStream.schema(tickets.schema).parquet(folders[0]),
            flow.spark.readStream.schema(came.schema).parquet(folders[1]),
            patience,
        )
        arrivals.triage_stream(arriving, *paths, checkpoint).awaitTermination()
    arrivals.sweep_unanswered(tickets, 0, *paths)
    return read_table(flow.spark, paths[0]).drop("batch", "cited_ticket_ids")
