"""SQL building blocks for checking: the flow again, as common table expressions."""

from threadloom.constants import (
    CATEGORY_KEYWORDS,
    CLAIM_PATTERNS,
    FINANCIAL_HARM_KEYWORDS,
    SEVERITY_PATTERNS,
    URGENCY_KEYWORDS,
)
from threadloom.plans.derive import COMPATIBLE, LANDING_SQL, LETTERS, RAW_SQL, TWEETS_SQL


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _hits(column: str, words) -> str:
    pattern = r"\b(?:" + "|".join(words) + r")\b"
    return f"CAST(len(regexp_extract_all({column}, {text(pattern)})) AS INTEGER)"


def lowered(column: str) -> str:
    return f"replace(replace(lower({column}), '’', ''''), '‘', '''')"


def urgency(column: str, words=URGENCY_KEYWORDS) -> str:
    return (
        f"({_hits(lowered(column), words)}"
        f" + (length({column}) - length(replace({column}, '!', '')))"
        f" + len(regexp_extract_all({column}, '\\b[A-Z]{{4,}}\\b')))"
    )


def priority(score: str) -> str:
    return f"CASE WHEN {score} >= 3 THEN 'High' WHEN {score} >= 1 THEN 'Medium' ELSE 'Low' END"


SCORES = ", ".join(
    f"{_hits(lowered('text'), words)} AS s{i}" for i, words in enumerate(CATEGORY_KEYWORDS.values())
)
CATEGORY = (
    "CASE WHEN greatest(s0, s1, s2, s3, s4, s5) = 0 THEN 'General Inquiry' "
    + " ".join(
        f"WHEN s{i} = greatest(s0, s1, s2, s3, s4, s5) THEN {text(name)}"
        for i, name in enumerate(CATEGORY_KEYWORDS)
    )
    + " END"
)
EARLIER_URGENCY = [w for w in URGENCY_KEYWORDS if w not in FINANCIAL_HARM_KEYWORDS]
CLAIMS = text("(?i)" + "|".join(CLAIM_PATTERNS))
SEVERE = text("(?i)" + "|".join(SEVERITY_PATTERNS))

# Python's and Spark's word and blank characters, in the oracle's regular expressions.
WORD = r"[\pL\pN_]"
NOT_BLANK = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\pZ]"
BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\pZ]+"


def _nfkc(column: str) -> str:
    for character, plain in COMPATIBLE:
        column = f"replace({column}, '{character}', '{plain}')"
    return column


def letter_counts(column: str) -> str:
    """The vector of ``derive.letter_counts``."""
    counts = ", ".join(f"length(lower({column})) - length(replace(lower({column}), '{x}', ''))" for x in LETTERS)
    return f"CAST([1, {counts}] AS FLOAT[])"


_FAILURES = """list_filter([
    CASE WHEN count(*) OVER (PARTITION BY tweet_id) > 1 THEN 'tweet_id is not unique' END,
    CASE WHEN author_id IS NULL THEN 'author_id is null' END,
    CASE WHEN text IS NULL THEN 'text is null' END,
    CASE WHEN tweet_id < 0 THEN 'tweet_id is negative' END,
    CASE WHEN author_id = '' THEN 'author_id is empty' END,
    CASE WHEN text = '' THEN 'text is empty' END,
    CASE WHEN created_at < TIMESTAMP '2006-03-21 00:00:00' THEN 'created_at is too early' END,
    CASE WHEN created_at > TIMESTAMP '2020-01-01 00:00:00' THEN 'created_at is too late' END
  ], lambda f: f IS NOT NULL)"""

PARTS = {
    "tweets": TWEETS_SQL.format(conversations="conversations"),
    "landing": LANDING_SQL.format(tweets="tweets"),
    "raw": RAW_SQL.format(tweets="tweets"),
    "checked": f"SELECT *, {_FAILURES} AS failures FROM landing",
    "valid": "SELECT * FROM checked WHERE len(failures) = 0",
    "normalised": f"SELECT *, trim(regexp_replace({_nfkc('text')}, '{BLANKS}', ' ', 'g')) AS text_clean FROM valid",
    "clean": "SELECT * FROM normalised WHERE text_clean <> ''",
    "parent": """SELECT c.tweet_id, p.tweet_id AS parent FROM clean c
      LEFT JOIN clean p ON p.tweet_id = c.in_response_to_tweet_id AND p.tweet_id <> c.tweet_id""",
    # All rows above a row; one that stands above itself is on a circle.
    "walk": """SELECT tweet_id, parent AS here FROM parent WHERE parent IS NOT NULL
      UNION SELECT w.tweet_id, p.parent FROM walk w JOIN parent p ON p.tweet_id = w.here
      WHERE p.parent IS NOT NULL""",
    "roots": """SELECT p.tweet_id, coalesce(min(top.tweet_id), min(ring.tweet_id), p.tweet_id) AS thread_root_id
      FROM parent p LEFT JOIN walk w ON w.tweet_id = p.tweet_id
      LEFT JOIN parent top ON top.tweet_id = w.here AND top.parent IS NULL
      LEFT JOIN walk ring ON ring.tweet_id = w.here AND ring.here = w.here GROUP BY p.tweet_id""",
    "rooted": "SELECT c.*, r.thread_root_id FROM clean c JOIN roots r USING (tweet_id)",
    "brand_first": """SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY thread_root_id ORDER BY created_at, tweet_id) AS place
      FROM rooted WHERE NOT inbound) WHERE place = 1""",
    "sizes": """SELECT thread_root_id, CAST(count(*) AS BIGINT) AS num_messages,
      CAST(count(*) FILTER (WHERE inbound) AS BIGINT) AS num_customer_messages
      FROM rooted GROUP BY thread_root_id""",
    "tickets": """SELECT o.tweet_id AS ticket_id, o.author_id AS customer_id, b.author_id AS brand_id,
        o.created_at AS opened_at, o.text_clean AS text,
        CAST(length(o.text_clean) AS INTEGER) AS text_length,
        CAST(len(string_split(o.text_clean, ' ')) AS INTEGER) AS word_count,
        s.num_messages, s.num_customer_messages,
        s.num_messages - s.num_customer_messages AS num_brand_messages,
        CAST(epoch(b.created_at) - epoch(o.created_at) AS DOUBLE) AS first_response_seconds,
        s.num_messages > s.num_customer_messages AS resolved
      FROM rooted o JOIN sizes s ON s.thread_root_id = o.tweet_id
      LEFT JOIN brand_first b ON b.thread_root_id = o.tweet_id
      WHERE o.inbound AND o.tweet_id = o.thread_root_id""",
    "scored": f"SELECT *, {SCORES}, {urgency('text')} AS urgency FROM tickets",
    "labeled": f"SELECT *, {CATEGORY} AS category, {priority('urgency')} AS priority FROM scored",
    "kb": """SELECT l.ticket_id, l.category, l.priority, l.text AS customer_message,
        b.text_clean AS resolution_text
      FROM labeled l JOIN brand_first b ON b.thread_root_id = l.ticket_id""",
    "drafted": """SELECT r.tweet_id AS draft_id, r.text, k.customer_message AS query, k.*
      FROM rooted r JOIN kb k ON k.ticket_id = r.thread_root_id WHERE NOT r.inbound""",
}
_NEEDS = {
    "tweets": (), "landing": ("tweets",), "raw": ("tweets",), "checked": ("landing",),
    "valid": ("checked",), "normalised": ("valid",), "clean": ("normalised",), "parent": ("clean",),
    "walk": ("parent",), "roots": ("walk",), "rooted": ("roots",), "brand_first": ("rooted",),
    "sizes": ("rooted",), "tickets": ("sizes", "brand_first"), "scored": ("tickets",),
    "labeled": ("scored",), "kb": ("labeled",),
    "drafted": ("kb",),
}
def flow_sql(stage: str, select: str, **more: str) -> str:
    """``select`` over the flow up to ``stage``, with further named parts."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    add(stage)
    parts = {name: PARTS[name] for name in wanted} | more
    return (
        "WITH RECURSIVE "
        + ",\n".join(
            f"{name} AS ({sql})" if name == "walk" else f"{name} AS MATERIALIZED ({sql})"
            for name, sql in parts.items()
        )
        + f"\n{select}"
    )


def tfidf_parts(source: str, key: str, text: str, size: int, min_df: int) -> dict[str, str]:
    """Unit TF-IDF weights of a text column as named parts; ``unit`` has key, term, n and weight."""
    return {
        "words": f"SELECT {key} AS key, regexp_extract_all(lower({text}), '{WORD}{{2,}}') AS w FROM {source}",
        "counts": """SELECT key, term, count(*) AS n FROM (SELECT key, unnest(w) AS term FROM words
          UNION ALL SELECT key, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))
          FROM words WHERE len(w) > 1) GROUP BY key, term""",
        "vocabulary": f"""SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf
          FROM counts GROUP BY term HAVING count(*) >= {min_df} ORDER BY sum(n) DESC, term LIMIT {size}""",
        "unit": """SELECT key, term, n, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY key)) AS weight
          FROM counts JOIN vocabulary USING (term)""",
    }


def odds_parts(source: str, key: str, label: str) -> dict[str, str]:
    """Naive Bayes over the terms of ``unit``; ``best_LABEL`` has key, prediction and score."""
    name = f"best_{label}"
    return {
        f"shares_{label}": f"SELECT {label} AS label, ln(count(*) / (SELECT count(*) FROM {source})) AS share FROM {source} GROUP BY {label}",
        f"cells_{label}": f"SELECT {label} AS label, term, sum(n) AS n FROM unit JOIN {source} ON key = {key} GROUP BY ALL",
        f"coefficients_{label}": f"""SELECT label, term, ln((coalesce(n, 0) + 1) / (total + (SELECT count(*) FROM vocabulary))) AS coefficient
          FROM shares_{label} CROSS JOIN vocabulary
          JOIN (SELECT label, coalesce(sum(n), 0) AS total FROM shares_{label} LEFT JOIN cells_{label} USING (label) GROUP BY label) USING (label)
          LEFT JOIN cells_{label} USING (label, term)""",
        name: f"""SELECT key, first(label ORDER BY score DESC, label) AS prediction, max(score) AS score FROM (
            SELECT k.{key} AS key, s.label, share + coalesce(sum(weight * coefficient), 0) AS score
            FROM {source} k CROSS JOIN shares_{label} s LEFT JOIN unit u ON u.key = k.{key}
            LEFT JOIN coefficients_{label} c ON c.term = u.term AND c.label = s.label
            GROUP BY k.{key}, s.label, share) GROUP BY key""",
    }


def with_parts(parts: dict[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts.items()) + f"\n{select}"
