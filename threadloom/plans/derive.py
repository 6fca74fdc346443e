"""Tweet-shaped tables derived from the conversation tables.

The SQL runs unchanged in Spark and in the oracle engine. One conversation
turn gives one tweet; phrases are added so that every labelling rule, draft
check and rejection has rows to act on.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.tables import read_spread

# Phrase by pid, and the category a person would give it.
PHRASES = (
    ("Locked out since Monday, the login page refuses my pin", "Account Access"),
    ("The courier lost my parcel and the tracking shows nothing", "Order / Delivery / Refund"),
    ("You double charged me, look at the invoice", "Billing & Payments"),
    ("Screen is frozen and lagging since the patch", "Technical Support"),
    ("There is a glitch in the map view", "Technical Support"),
    ("My tablet wont boot today", "Technical Support"),
    ("Poor quality fabric and the wrong size too", "Product Complaint"),
    ("Been on hold for an hour, terrible service", "Customer Service Complaint"),
    ("Do you sell gift cards in the shop?", "General Inquiry"),
    ("Crossing the border with my new phone", "General Inquiry"),
    ("This page won’t load on my laptop", "Technical Support"),
    ("Which colours does the jacket come in?", "General Inquiry"),
    ("Please answer asap.", "General Inquiry"),
    ("NEVER AGAIN!!! This is a SCAM", "Customer Service Complaint"),
    ("An unauthorized charge shows on my credit card", "Billing & Payments"),
    ("Trying to sign in ends with an error", "Technical Support"),
    ("The lid came broken off in its wrapping", "Product Complaint"),
    ("Had to reset the whole thing", "Technical Support"),
    ("The ﬁrst sum on my card № ５ looks odd", "Billing & Payments"),
    ("My lawyer will hear of this emergency", "Customer Service Complaint"),
    ("The charger is unsafe, it sparks", "Product Complaint"),
    ("We have already refunded the fee, please look.", "General Inquiry"),
    ("Read http://help.example.net/faq first", "General Inquiry"),
    ("Hello @shopfan77, which store was it?", "General Inquiry"),
)
# Compatibility characters of the phrases, and what NFKC makes of them.
COMPATIBLE = (("ﬁ", "fi"), ("№", "No"), ("５", "5"))


def phrase_values() -> str:
    return ", ".join("({}, '{}')".format(i, p.replace("'", "''")) for i, (p, _) in enumerate(PHRASES))


# Landing rows: early and late dates, NULLs, empty and blank texts, broken links,
# branches, circles, brand-opened threads.
TWEETS_SQL = f"""
SELECT b.tweet_id,
  CASE WHEN conv_id % 31 = 9 AND turn = 1 THEN NULL
       WHEN role = 'user' THEN 'cust' || CAST(conv_id % 50 AS VARCHAR(20))
       ELSE 'brand' || CAST(conv_id % 7 AS VARCHAR(20)) END AS author_id,
  role = 'user' AS inbound,
  CASE WHEN conv_id % 19 = 4 AND turn = 1 THEN TIMESTAMP '2999-01-01 00:00:00'
       WHEN conv_id % 19 = 8 AND turn = 1 THEN TIMESTAMP '2001-01-01 00:00:00'
       ELSE TIMESTAMP '2017-10-01 00:00:00' + (conv_id * 600 + turn * turn * 37) * INTERVAL '1' SECOND
  END AS created_at,
  CASE WHEN conv_id % 17 = 2 AND turn = 1 THEN ''
       WHEN conv_id % 23 = 6 AND turn = 1 THEN '   '
       WHEN conv_id % 37 = 11 AND turn = 2 THEN NULL
       ELSE phrase || '  ' || b.text END AS text,
  CASE WHEN turn = 0 AND conv_id % 29 = 12 THEN b.tweet_id + 1
       WHEN turn = 0 THEN NULL
       WHEN conv_id % 13 = 5 AND turn = 2 THEN 9000000000 + b.tweet_id
       WHEN (conv_id + turn) % 5 = 0 THEN conv_id * 100 + 1
       ELSE b.tweet_id - 1 END AS in_response_to_tweet_id
FROM (SELECT c.*, c.conv_id * 100 + c.turn + 1 AS tweet_id FROM {{conversations}} c) b
JOIN (SELECT * FROM (VALUES {phrase_values()}) AS v(pid, phrase)) p
  ON p.pid = (conv_id * 5 + turn * 7) % 24
"""

# Some ids come twice, and some are negative.
LANDING_SQL = """
SELECT * FROM {tweets}
UNION ALL
SELECT * FROM {tweets} WHERE CAST(floor(tweet_id / 100) AS BIGINT) % 29 = 7 AND tweet_id % 100 = 2
UNION ALL
SELECT -tweet_id, author_id, inbound, created_at, text, in_response_to_tweet_id FROM {tweets}
WHERE CAST(floor(tweet_id / 100) AS BIGINT) % 41 = 3 AND tweet_id % 100 = 1
"""

# The seven raw strings, with one kind of damage for each class of ids.
RAW_SQL = """
SELECT
  CASE WHEN tweet_id % 31 = 3 THEN CAST(tweet_id AS VARCHAR(20)) || '.0'
       WHEN tweet_id % 31 = 5 THEN ' ' || CAST(tweet_id AS VARCHAR(20)) || ' '
       WHEN tweet_id % 31 = 7 THEN CAST(tweet_id AS VARCHAR(20)) || '.5'
       ELSE CAST(tweet_id AS VARCHAR(20)) END AS tweet_id,
  coalesce(author_id, '') AS author_id,
  CASE WHEN tweet_id % 37 = 1 THEN 'yes'
       WHEN inbound THEN ' True' ELSE 'False' END AS inbound,
  CASE WHEN tweet_id % 41 = 2 THEN 'not-a-real-date'
       WHEN tweet_id % 41 = 4 THEN 'Fri Mar 11 06:25:03 +0530 2016'
       WHEN tweet_id % 41 = 6 THEN 'Tue Feb 30 06:25:03 +0000 2016'
       WHEN tweet_id % 41 = 8 THEN 'Mon Nov 6 02:01:07 -0800 2017'
       ELSE CASE CAST(tweet_id % 3 AS INTEGER) WHEN 0 THEN 'Tue Jan ' WHEN 1 THEN 'Sat Jun ' ELSE 'Fri Nov ' END
         || lpad(CAST(1 + tweet_id % 28 AS VARCHAR(2)), 2, '0') || ' ' || lpad(CAST(tweet_id % 24 AS VARCHAR(2)), 2, '0')
         || ':' || lpad(CAST(tweet_id % 60 AS VARCHAR(2)), 2, '0') || ':07 +0000 201' || CAST(5 + tweet_id % 4 AS VARCHAR(1))
  END AS created_at,
  coalesce(text, '') || CASE WHEN tweet_id % 5 = 0 THEN '
"quoted", and on a new line' ELSE '' END AS text,
  CASE WHEN tweet_id % 43 = 1 THEN '3,'
       WHEN tweet_id % 43 = 2 THEN CAST(tweet_id AS VARCHAR(20)) || ', 4'
       WHEN tweet_id % 2 = 0 THEN ''
       ELSE CAST(tweet_id + 1 AS VARCHAR(20)) END AS response_tweet_id,
  CASE WHEN tweet_id % 47 = 1 THEN '1.0'
       WHEN in_response_to_tweet_id IS NULL THEN ''
       ELSE CAST(in_response_to_tweet_id AS VARCHAR(20)) END AS in_response_to_tweet_id
FROM {tweets}
"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id")


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TWEETS_SQL, conversations=read(spark, sf_dir, "conversations"))


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing table with repeated ids, the input of validation."""
    rows = spark.sql(LANDING_SQL, tweets=tweets(spark, sf_dir))
    return rows.selectExpr(
        "tweet_id", "author_id", "inbound", "created_at", "text",
        "CAST(NULL AS ARRAY<BIGINT>) AS response_tweet_id", "in_response_to_tweet_id",
    )


LETTERS = "aeinorst"


def letter_counts(text: Column) -> Column:
    """A vector any SQL engine can recompute: one, and counts of some letters, in lower case."""
    lowered = F.lower(text)
    counts = (F.length(lowered) - F.length(F.replace(lowered, F.lit(letter), F.lit(""))) for letter in LETTERS)
    return F.array(F.lit(1), *counts).cast("array<float>")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw string rows, the input of ingestion."""
    return spark.sql(RAW_SQL, tweets=tweets(spark, sf_dir))
