"""Table schemas of the ticket flow."""

from pyspark.sql import types as T

from threadloom.constants import RAW_COLUMNS


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])

LANDING = _struct(
    tweet_id=T.LongType(),
    author_id=T.StringType(),
    inbound=T.BooleanType(),
    created_at=T.TimestampType(),
    text=T.StringType(),
    response_tweet_id=T.ArrayType(T.LongType()),
    in_response_to_tweet_id=T.LongType(),
)

TWEETS = T.StructType(LANDING.fields + [T.StructField("text_clean", T.StringType())])

TICKET_FEATURES = _struct(
    ticket_id=T.LongType(),
    customer_id=T.StringType(),
    brand_id=T.StringType(),
    opened_at=T.TimestampType(),
    text=T.StringType(),
    text_length=T.IntegerType(),
    word_count=T.IntegerType(),
    num_messages=T.LongType(),
    num_customer_messages=T.LongType(),
    num_brand_messages=T.LongType(),
    first_response_seconds=T.DoubleType(),
    resolved=T.BooleanType(),
)

LABELED_TICKETS = T.StructType(
    TICKET_FEATURES.fields
    + [T.StructField("category", T.StringType()), T.StructField("priority", T.StringType())]
)

KNOWLEDGE_BASE = _struct(
    ticket_id=T.LongType(),
    category=T.StringType(),
    priority=T.StringType(),
    customer_message=T.StringType(),
    resolution_text=T.StringType(),
)

RETRIEVED = _struct(
    ticket_id=T.StringType(),
    category=T.StringType(),
    priority=T.StringType(),
    customer_message=T.StringType(),
    resolution_text=T.StringType(),
    distance=T.DoubleType(),
)

DRAFT = _struct(
    reply=T.StringType(),
    cited_ticket_ids=T.ArrayType(T.StringType()),
    needs_human_escalation=T.BooleanType(),
)

LEDGER = _struct(
    model_name=T.StringType(),
    version=T.LongType(),
    test_macro_f1=T.DoubleType(),
    baseline_macro_f1=T.DoubleType(),
    outcome=T.StringType(),
    reason=T.StringType(),
)

RUNS = _struct(
    run_name=T.StringType(),
    target=T.StringType(),
    kind=T.StringType(),
    key=T.StringType(),
    value=T.StringType(),
)
