"""Queries from raw rows to labelled tickets and the knowledge base."""

from pyspark.sql import functions as F

from threadloom.constants import CATEGORY_KEYWORDS, FINANCIAL_HARM_KEYWORDS, URGENCY_KEYWORDS
from threadloom.functions.text import without_ids
from threadloom.operators import clean, ingest, knowledge, label, threads, tickets, validate
from threadloom.plans import derive, oracle
from threadloom.plans.flow import Flow
from threadloom.plans.oracle import flow_sql
from threadloom.plans.registered import query
from threadloom.sources.csv import read_raw_csv, write_csv, write_raw_csv
from threadloom.sources.tables import materialize, scratch_path

STAMP = "yyyy-MM-dd HH:mm:ss"
# Bytes of a range: a few rows.
SHORT_RANGE = 16_384

# What ingestion gives for the raw strings of ``derive.RAW_SQL``.
_PARSED_SQL = r"""
SELECT *,
  CASE WHEN regexp_matches(trim(tweet_id), '^[+-]?\d+(\.0+)?$')
       THEN CAST(CAST(trim(tweet_id) AS DECIMAL(20, 1)) AS BIGINT) END AS id,
  lower(trim(inbound)) = 'true' AS is_inbound,
  try_strptime(substr(created_at, 5), '%b %d %H:%M:%S %z %Y') AT TIME ZONE 'UTC' AS stamp,
  CASE WHEN response_tweet_id <> '' THEN list_transform(
       string_split(response_tweet_id, ','), lambda p: TRY_CAST(trim(p) AS BIGINT)) END AS replies,
  CASE WHEN regexp_matches(in_response_to_tweet_id, '^\d+$')
       THEN CAST(in_response_to_tweet_id AS BIGINT) END AS parent
FROM raw"""
_PARSED_OK = """id IS NOT NULL AND stamp IS NOT NULL AND (replies IS NULL OR NOT list_contains(
  list_transform(replies, lambda p: p IS NULL), true))
  AND (in_response_to_tweet_id = '' OR parent IS NOT NULL)"""


def _landing_view(df):
    return df.select(
        "tweet_id", "author_id", "inbound",
        F.date_format("created_at", STAMP).alias("created_at"),
        "text",
        F.array_join(F.col("response_tweet_id").cast("array<string>"), ",").alias("response_tweet_id"),
        "in_response_to_tweet_id",
    )


_LANDING_VIEW_SQL = f"""SELECT id AS tweet_id, author_id, is_inbound AS inbound,
  strftime(stamp, '%Y-%m-%d %H:%M:%S') AS created_at, text,
  array_to_string(replies, ',') AS response_tweet_id, parent AS in_response_to_tweet_id
  FROM parsed WHERE {_PARSED_OK}"""


@query(flow_sql("raw", _LANDING_VIEW_SQL, parsed=_PARSED_SQL))
def ingest_parse(flow: Flow):
    """Typed landing rows of the raw strings that parse."""
    return _landing_view(ingest.accepted(ingest.parse_rows(derive.raw(flow.spark, flow.sf_dir))))


@query(flow_sql("raw", _LANDING_VIEW_SQL, parsed=_PARSED_SQL))
def ingest_csv(flow: Flow):
    """The same through a CSV file with quoted line ends and quotes."""
    path = scratch_path(flow.spark, "raw-csv")
    write_raw_csv(derive.raw(flow.spark, flow.sf_dir), path)
    return _landing_view(ingest.accepted(ingest.parse_rows(read_raw_csv(flow.spark, path))))


@query(flow_sql("raw", _LANDING_VIEW_SQL, parsed=_PARSED_SQL))
def ingest_split_csv(flow: Flow):
    """The same from one file that many tasks read in short ranges, most of which begin or end within a record."""
    path = scratch_path(flow.spark, "raw-csv")
    write_raw_csv(derive.raw(flow.spark, flow.sf_dir).coalesce(1), path)
    return _landing_view(ingest.accepted(ingest.parse_rows(read_raw_csv(flow.spark, path, SHORT_RANGE))))


@query(flow_sql("raw", _LANDING_VIEW_SQL, parsed=_PARSED_SQL))
def ingest_mixed_headers(flow: Flow):
    """The same from files whose columns come in different orders, some with one more."""
    rows, path = derive.raw(flow.spark, flow.sf_dir), scratch_path(flow.spark, "raw-csv")
    half = F.xxhash64("tweet_id") % 2 == 0
    write_raw_csv(rows.where(half), f"{path}/one")
    turned = rows.where(~half).select(F.lit("more").alias("note"), *reversed(rows.columns))
    write_csv(turned, f"{path}/two")
    read = read_raw_csv(flow.spark, [f"{path}/one", f"{path}/two"])
    return _landing_view(ingest.accepted(ingest.parse_rows(read)))


@query(
    flow_sql(
        "raw",
        f"""SELECT CAST(count(*) AS BIGINT) AS rows_read,
          CAST(count(*) FILTER (WHERE {_PARSED_OK}) AS BIGINT) AS rows_written,
          CAST(count(*) FILTER (WHERE NOT ({_PARSED_OK})) AS BIGINT) AS rows_rejected FROM parsed""",
        parsed=_PARSED_SQL,
    )
)
def ingest_summary(flow: Flow):
    """Rows read, written and rejected."""
    return ingest.ingest_summary(ingest.parse_rows(derive.raw(flow.spark, flow.sf_dir)))


@query(
    flow_sql(
        "checked",
        """SELECT tweet_id, author_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, text,
          array_to_string(failures, '; ') AS failures FROM checked WHERE len(failures) > 0""",
    )
)
def validate_rejects(flow: Flow):
    """Quarantined rows with every hard check they fail."""
    return validate.quarantine(flow.checked).select(
        "tweet_id", "author_id", F.date_format("created_at", STAMP).alias("created_at"), "text",
        F.array_join("failures", "; ").alias("failures"),
    )


_LINKS_SQL = """SELECT CAST(count(in_response_to_tweet_id) AS BIGINT) AS links,
  CAST(count(*) FILTER (WHERE in_response_to_tweet_id IS NOT NULL AND in_response_to_tweet_id NOT IN
    (SELECT tweet_id FROM valid)) AS BIGINT) AS broken_response_links FROM valid"""


@query(
    flow_sql(
        "valid",
        """SELECT *, CASE WHEN links = 0 THEN 0.0 ELSE round(broken_response_links / links, 4) END
          AS broken_response_link_rate FROM link_counts""",
        link_counts=_LINKS_SQL,
    )
)
def broken_links(flow: Flow):
    """Reply links to rows that are not valid."""
    return validate.broken_links(flow.valid)


@query(
    """WITH pairs AS (SELECT source, text, count(*) AS n FROM documents GROUP BY source, text)
    SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_author_text_pairs FROM pairs"""
)
def duplicate_pairs(flow: Flow):
    """Repeated (source, text) pairs of the documents, which hold copies."""
    documents = derive.documents(flow.spark, flow.sf_dir).select(
        F.col("doc_id").alias("tweet_id"), F.col("source").alias("author_id"), "text"
    )
    return validate.duplicate_pairs(documents)


@query(
    flow_sql(
        "valid",
        """SELECT (SELECT CAST(count(*) AS BIGINT) FROM checked) AS rows_in,
          (SELECT CAST(count(*) AS BIGINT) FROM valid) AS rows_valid,
          (SELECT CAST(count(*) AS BIGINT) FROM checked WHERE len(failures) > 0) AS rows_rejected,
          broken_response_links,
          CASE WHEN links = 0 THEN 0.0 ELSE round(broken_response_links / links, 4) END
            AS broken_response_link_rate,
          (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM
            (SELECT count(*) AS n FROM valid GROUP BY author_id, text)) AS duplicate_author_text_pairs
        FROM link_counts""",
        link_counts=_LINKS_SQL,
    )
)
def validation_report(flow: Flow):
    """Sizes, broken links and repeated pairs after the hard checks."""
    return validate.validation_report(flow.checked)


@query(flow_sql("clean", "SELECT tweet_id, text, text_clean FROM clean"))
def clean_text(flow: Flow):
    """Normalised text of valid rows that are not blank."""
    return clean.kept_rows(flow.normalised).select("tweet_id", "text", "text_clean")


@query(
    flow_sql(
        "clean",
        """SELECT CAST(count(*) AS BIGINT) AS rows_in,
          CAST(count(*) FILTER (WHERE text_clean <> '') AS BIGINT) AS rows_out,
          CAST(count(*) FILTER (WHERE text_clean = '') AS BIGINT) AS rows_dropped_empty_after_cleaning,
          CAST(sum(CAST(tweet_id IS NULL AS INT) + CAST(author_id IS NULL AS INT) + CAST(inbound IS NULL AS INT)
            + CAST(created_at IS NULL AS INT) + CAST(text IS NULL AS INT)) AS BIGINT)
            AS unexpected_nulls_in_required_columns FROM normalised""",
    )
)
def clean_report(flow: Flow):
    """Cleaning counts."""
    return clean.cleaning_report(flow.normalised)


@query(
    """SELECT CAST(sum(CAST(quality IS NULL AS INTEGER) + CAST(toxic IS NULL AS INTEGER)) AS BIGINT)
      AS unexpected_nulls_in_required_columns
    FROM documents LEFT JOIN labels USING (doc_id)"""
)
def null_audit(flow: Flow):
    """NULL cells of the documents' labels; not every document is labelled."""
    documents = derive.documents(flow.spark, flow.sf_dir).select("doc_id")
    labels = derive.read(flow.spark, flow.sf_dir, "labels")
    return clean.null_cells(documents.join(labels, "doc_id", "left"))


@query(flow_sql("roots", "SELECT tweet_id, thread_root_id FROM roots"))
def thread_roots(flow: Flow):
    """The first row of the thread of every row."""
    return threads.thread_roots(flow.tweets)


@query(
    flow_sql(
        "sizes",
        """SELECT thread_root_id, num_messages, num_customer_messages,
          num_messages - num_customer_messages AS num_brand_messages FROM sizes""",
    )
)
def thread_sizes(flow: Flow):
    """Messages per thread by side."""
    table = tickets.thread_table(threads.with_roots(flow.tweets, flow.roots))
    return table.select(
        "thread_root_id", "num_messages", "num_customer_messages",
        (F.col("num_messages") - F.col("num_customer_messages")).alias("num_brand_messages"),
    )


@query(
    flow_sql(
        "brand_first",
        """SELECT thread_root_id, author_id AS brand_id,
          strftime(created_at, '%Y-%m-%d %H:%M:%S') AS first_brand_response_at FROM brand_first""",
    )
)
def first_brand_reply(flow: Flow):
    """Who answered a thread first, and when."""
    table = tickets.thread_table(threads.with_roots(flow.tweets, flow.roots))
    return table.where(F.col("brand_id").isNotNull()).select(
        "thread_root_id", "brand_id",
        F.date_format("first_brand_response_at", STAMP).alias("first_brand_response_at"),
    )


_TICKET_COLUMNS = """ticket_id, customer_id, brand_id,
  strftime(opened_at, '%Y-%m-%d %H:%M:%S') AS opened_at, text, text_length, word_count, num_messages,
  num_customer_messages, num_brand_messages, first_response_seconds, resolved"""


@query(flow_sql("tickets", f"SELECT {_TICKET_COLUMNS} FROM tickets"))
def ticket_features(flow: Flow):
    """One feature row per customer ticket."""
    return flow.tickets.withColumn("opened_at", F.date_format("opened_at", STAMP))


@query(
    flow_sql(
        "tickets",
        """SELECT (SELECT CAST(count(*) AS BIGINT) FROM clean) AS total_tweets,
          (SELECT CAST(count(DISTINCT thread_root_id) AS BIGINT) FROM roots) AS total_threads,
          CAST(count(*) AS BIGINT) AS tickets_extracted,
          CAST(count(*) FILTER (WHERE resolved) AS BIGINT) AS tickets_with_brand_response,
          median(first_response_seconds) AS median_first_response_seconds,
          max(first_response_seconds) AS max_first_response_seconds FROM tickets""",
    )
)
def feature_report(flow: Flow):
    """Thread and ticket counts and first-response times."""
    stored = materialize(flow.tickets.select("resolved", "first_response_seconds"), "tickets")
    return tickets.feature_report(flow.tweets, flow.roots, stored)


@query(
    flow_sql(
        "scored",
        "SELECT ticket_id, "
        + ", ".join(f"s{i} AS score_{i}" for i in range(len(CATEGORY_KEYWORDS)))
        + ", CAST(urgency AS INTEGER) AS urgency FROM scored",
    )
)
def category_scores(flow: Flow):
    """Keyword hits per category, and the urgency score."""
    return label.score_columns(flow.tickets.select("ticket_id", "text")).drop("text")


@query(flow_sql("labeled", "SELECT ticket_id, text, category FROM labeled"))
def label_category(flow: Flow):
    """Rule category of each ticket."""
    return label.with_category(flow.tickets.select("ticket_id", "text"))


@query(flow_sql("labeled", "SELECT ticket_id, text, priority FROM labeled"))
def label_priority(flow: Flow):
    """Rule priority of each ticket."""
    return label.with_priority(flow.tickets.select("ticket_id", "text"))


@query(
    flow_sql(
        "labeled",
        """SELECT 'category' AS kind, category AS label, CAST(count(*) AS BIGINT) AS tickets
          FROM labeled GROUP BY category
        UNION ALL SELECT 'priority', priority, CAST(count(*) AS BIGINT) FROM labeled GROUP BY priority""",
    )
)
def label_distribution(flow: Flow):
    """Tickets per category and per priority."""
    return label.label_distribution(flow.labeled)


@query(
    flow_sql(
        "labeled",
        """SELECT category, priority, CAST(count(*) AS BIGINT) AS tickets
        FROM labeled GROUP BY category, priority""",
    )
)
def ticket_overview(flow: Flow):
    """Landing rows to counts of tickets by category and priority."""
    return flow.labeled.groupBy("category", "priority").agg(F.count(F.lit(1)).alias("tickets"))


@query(
    flow_sql(
        "labeled",
        f"""SELECT {oracle.priority(oracle.urgency('text', oracle.EARLIER_URGENCY))} AS old_label,
          priority AS new_label, CAST(count(*) AS BIGINT) AS tickets FROM labeled GROUP BY ALL""",
    )
)
def label_change(flow: Flow):
    """Priority moves caused by the five financial phrases."""
    texts = materialize(flow.tickets.select("ticket_id", "text"), "ticket-texts")
    earlier = [w for w in URGENCY_KEYWORDS if w not in FINANCIAL_HARM_KEYWORDS]
    return label.label_changes(
        label.with_priority(texts, earlier), label.with_priority(texts), "priority"
    )


_PID_SQL = "((ticket_id - 1) // 100 * 5 + (ticket_id - 1) % 100 * 7) % 24"
_EXPECTED_SQL = (
    f"CASE CAST({_PID_SQL} AS INTEGER) "
    + " ".join(f"WHEN {i} THEN {oracle.text(meant)}" for i, (_, meant) in enumerate(derive.PHRASES))
    + " END"
)


@query(
    flow_sql(
        "labeled",
        f"""SELECT CAST(count(*) AS BIGINT) AS cases,
          CAST(count(*) FILTER (WHERE category <> {_EXPECTED_SQL}) AS BIGINT) AS misses,
          avg(CASE WHEN category <> {_EXPECTED_SQL} THEN 1.0 ELSE 0.0 END) AS miss_rate FROM labeled""",
    )
)
def label_misses(flow: Flow):
    """Rule misses against what a person makes of each ticket's phrase."""
    at = F.col("ticket_id") - 1
    phrase = (F.floor(at / 100) * 5 + at % 100 * 7) % 24
    meant = F.array(*(F.lit(meant) for _, meant in derive.PHRASES))
    cases = label.with_category(flow.tickets.select("ticket_id", "text"))
    return label.miss_rate(cases.withColumn("expected", F.get(meant, phrase.cast("int"))).select("text", "expected"))


@query(
    flow_sql(
        "kb", "SELECT ticket_id, category, priority, customer_message, resolution_text FROM kb"
    )
)
def knowledge_base(flow: Flow):
    """Tickets paired with the first brand reply."""
    return flow.knowledge


@query(
    flow_sql(
        "kb",
        """SELECT (SELECT CAST(count(*) AS BIGINT) FROM labeled) AS tickets_in,
          CAST(count(*) AS BIGINT) AS resolutions_found,
          (SELECT CAST(count(*) AS BIGINT) FROM labeled) - CAST(count(*) AS BIGINT) AS resolutions_missing
        FROM kb""",
    )
)
def kb_report(flow: Flow):
    """Tickets with and without a resolution."""
    return knowledge.knowledge_base_report(flow.stored_labeled, flow.knowledge)


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '@{oracle.WORD}+', ' ', 'g'), 'https?://{oracle.NOT_BLANK}+', ' ', 'g'), '\\b\\d{{4,}}\\b', ' ', 'g'),
      '&amp;?', ' ', 'g') AS clean_text FROM documents"""
)
def strip_tokens(flow: Flow):
    """Documents without mentions, links, long numbers and HTML ampersands."""
    documents = derive.documents(flow.spark, flow.sf_dir)
    return documents.select("doc_id", without_ids(F.col("text")).alias("clean_text"))
