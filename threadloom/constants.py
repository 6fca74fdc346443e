"""Window ends, word lists, patterns, prompt text, model settings.

Everything here must stay exactly as it is for results to agree with published
labels and reports, so it is plain data with no logic.
"""

# --- fixed values: tweet validity window, both ends included (UTC) ---
MIN_VALID_DATE = "2006-03-21 00:00:00"
MAX_VALID_DATE = "2020-01-01 00:00:00"

# --- fixed values: raw and landing columns ---
RAW_COLUMNS = (
    "tweet_id",
    "author_id",
    "inbound",
    "created_at",
    "text",
    "response_tweet_id",
    "in_response_to_tweet_id",
)
NULLABLE_COLUMNS = ("response_tweet_id", "in_response_to_tweet_id")

# --- fixed values: category keywords; dictionary order is the tie-break order ---
CATEGORY_KEYWORDS = {
    "Account Access": (
        "password", "log in", "login", "logged out", "locked out",
        "can't access", "cannot access", "verify my account",
        "verification code", "reset my password", "hacked", "sign in",
        "authenticate", "account access",
    ),
    "Order / Delivery / Refund": (
        "order", "delivery", "delivered", "package", "shipment", "shipped",
        "tracking", "refund", "return my", "courier", "parcel",
        "missing package", "never arrived", "wrong item",
    ),
    "Billing & Payments": (
        "charged", "overcharged", "billing", "bill", "invoice",
        "subscription", "payment", "autopay", "credit card",
        "double charged", "wrong amount", "cancel my subscription",
    ),
    "Technical Support": (
        "not working", "broken", "glitch", "bug", "crash", "crashed",
        "crashing", "error", "won't load", "wont load", "won't boot",
        "wont boot", "outage", "down again", "reset", "reinstall",
        "freeze", "froze", "freezing", "frozen", "lagging",
        "connection issue", "wifi",
    ),
    "Product Complaint": (
        "defective", "damaged", "poor quality", "low quality",
        "disappointed", "doesn't work", "does not work", "arrived broken",
        "wrong size", "not as described",
    ),
    "Customer Service Complaint": (
        "customer service", "rude", "unhelpful", "worst service",
        "poor service", "terrible service", "no response", "ignored",
        "on hold", "still waiting", "worst experience",
    ),
}
DEFAULT_CATEGORY = "General Inquiry"

# --- fixed values: urgency phrases and score floors ---
URGENCY_KEYWORDS = (
    "urgent", "immediately", "asap", "emergency", "right now", "cancel my",
    "cancelling", "unacceptable", "furious", "never again", "scam",
    "fraud", "stolen", "lawsuit", "legal action", "final warning",
    "charged twice", "double charged", "unauthorized charge",
    "fraudulent charge", "overcharged",
)
# The five phrases the second rule version added to the first.
FINANCIAL_HARM_KEYWORDS = (
    "charged twice", "double charged", "unauthorized charge",
    "fraudulent charge", "overcharged",
)
SHOUTED_WORD = r"\b[A-Z]{4,}\b"
HIGH_FLOOR = 3
MEDIUM_FLOOR = 1

# --- fixed values: tokens stripped before exploring text, in this order ---
STRIP_PATTERNS = (r"@\w+", r"https?://\S+", r"\b\d{4,}\b", r"&amp;?")

# --- fixed values: draft checks ---
LINK_PATTERN = r"https?://\S+"
HANDLE_PATTERN = r"@\w+"
LINK_MARK = "[link removed]"
HANDLE_MARK = "[handle removed]"
CLAIM_PATTERNS = (
    r"\bwe(?:'ve| have) (?:already )?(?:responded|refunded|resolved|fixed|sent)\b",
    r"\balready (?:responded|refunded|resolved|fixed|sent|contacted)\b",
    r"\brefund has been (?:issued|processed)\b",
    r"\baccount has been (?:fixed|resolved)\b",
    r"\bresponded to you via dm\b",
)
SEVERITY_PATTERNS = (
    r"\b(?:sue|lawsuit|legal action|attorney|lawyer)\b",
    r"\b(?:injured|injury|hurt me|safety issue|unsafe|dangerous)\b",
    r"\b(?:fraud|scam|stolen|unauthorized)\b",
)

# --- fixed values: prompt wording ---
PROMPT_INSTRUCTIONS = (
    "You are a customer support agent drafting a reply to a new ticket. "
    "Use only the past examples below as grounding for tone and content — "
    "do not invent policies, refunds, or facts not present in the examples. "
    "The examples belong to other customers: do not copy their links, "
    "order numbers, case numbers, or usernames into your reply — write a "
    "new reply in the same style instead. Do not state that any action "
    "has already been completed for this new customer (a refund issued, "
    "a DM already sent, an account already fixed) — nothing has been "
    "done yet, so only offer to help or ask for more information."
)
PROMPT_REQUEST = (
    "Respond with a JSON object with these fields: "
    '"reply" (the drafted reply text), '
    '"cited_ticket_ids" (array of ticket numbers from the examples above '
    "that you drew on), and "
    '"needs_human_escalation" (true if this ticket is too complex, '
    "sensitive, or ambiguous for a templated reply, false otherwise)."
)

# --- fixed values: reply evaluation ---
MIN_REPLY_LENGTH = 10
EVALUATION_QUERIES = (
    "I was charged twice for my subscription this month, please refund me",
    "My order never arrived and it's been two weeks",
    "The app keeps crashing every time I try to open it after the update",
    "I can't log into my account, it says my password is wrong even though I just reset it",
    "This is the third time I've had this problem and nobody has helped me, I'm furious",
    "What are your customer service hours?",
)
GENERATION_MODEL = "llama3.2:3b"

# --- fixed values: split, models, tuning, promotion ---
TRAIN_SHARE = 0.7
VALIDATION_SHARE = 0.15
SEED = 42
TFIDF_TERMS = 20_000
TFIDF_MIN_DF = 3
LOGREG_ITERATIONS = 1_000
# (C, class weight) in trial order
PARAM_GRID = (
    (0.1, None), (0.1, "balanced"),
    (1.0, None), (1.0, "balanced"),
    (10.0, None), (10.0, "balanced"),
)
MIN_LIFT = 0.05
MODEL_NAMES = {
    "category": "ticket-category-classifier",
    "priority": "ticket-priority-classifier",
}

# --- fixed values: sampling and retrieval ---
MAX_PER_CATEGORY = 15_000
TOP_K = 3

# --- fixed values: text exploration ---
EXPLORE_SAMPLE = 15_000
EXPLORE_CLUSTERS = 12
EXPLORE_TERMS = 5_000
EXPLORE_MIN_DF = 5
EXPLORE_MAX_DF = 0.5
EXPLORE_COMPONENTS = 100
EXPLORE_RESTARTS = 5
EXPLORE_TOP_TERMS = 10
EXPLORE_EXTRA_STOPS = ("amp", "https")
