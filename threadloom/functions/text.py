"""Text normalisation as Spark columns."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadloom.constants import STRIP_PATTERNS

# Letters, numbers and the underscore; no combining marks.
# Blanks: Unicode white space plus the four ASCII separators U+001C to U+001F.
WORD_CHARACTER = r"[\p{L}\p{N}_]"
_BLANKS = r"(?U)[\s\x1C-\x1F]+"
# Characters that NFKC leaves as they are, whatever stands beside them, if nothing else is in the text: ASCII, most of
# Latin, Greek and Cyrillic, dashes and quotation marks, the euro sign, kana, Han, Hangul and pictographs.
SETTLED = (
    r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB\u00AC\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148"
    r"\u014A-\u017E\u0391-\u03A1\u03A3-\u03CE\u0400-\u0482\u048A-\u052F\u2010\u2012-\u2016\u2018-\u2023\u20AC"
    r"\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3\x{1F300}-\x{1FAFF}"
)


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode NFKC. Spark has no such expression, and Arrow's kernel leaves
    letters and their accents apart. One look at a whole batch finds nearly
    every time that there is nothing to do; only else is it gone through.
    """
    values = text.to_pylist()
    # A line end composes with nothing, so texts can be looked at in one piece.
    if unicodedata.is_normalized("NFKC", "\n".join(value for value in values if value)):
        return text
    return pa.array([value and unicodedata.normalize("NFKC", value) for value in values], pa.string())


def collapse_blanks(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


# Else the optimizer works a text out again for each filter on it, in one more Python worker of the task.
_nfkc_once = F.arrow_udf(nfkc.func, StringType()).asNondeterministic()


def normalized(text: Column) -> Column:
    """Texts of ASCII or other settled characters are normal already, so that only the others go to Python, once."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    normal = ascii_only | text.rlike(rf"\A[{SETTLED}]*+\z")
    return collapse_blanks(F.when(normal, text).otherwise(_nfkc_once(F.when(~normal, text))))


def regex(pattern: str) -> str:
    """A pattern with the Unicode meaning of word, digit and blank characters."""
    return "(?U)" + (
        pattern.replace(r"\w", WORD_CHARACTER)
        .replace(r"\s", r"[\s\x1C-\x1F]")
        .replace(r"\S", r"[^\s\x1C-\x1F]")
    )


def without_ids(text: Column) -> Column:
    """Mentions, links, long numbers and HTML ampersands each become a space."""
    for pattern in STRIP_PATTERNS:
        text = F.regexp_replace(text, regex(pattern), " ")
    return text


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")
