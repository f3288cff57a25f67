"""Tokens, keys and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKEN_BYTES, MAX_TOKEN_BYTES, MAX_EXACT_TAG_BYTES = 1, 100, 200
#: Blanks and ASCII punctuation that separate words. The underscore does not.
SEPARATORS = ".,;:!?()[]{}\"'`~@#$%^&*-+=<>/\\|"
_CLASS = "[ \\t\\n\\r" + "".join("\\" + c for c in SEPARATORS) + "]+"
KEY_PREFIX = "memory:"


def valid_length(token: Column, low: int = MIN_TOKEN_BYTES, high: int = MAX_TOKEN_BYTES) -> Column:
    return F.octet_length(token).between(low, high)


def normalize_tokens(tokens: Column, exact: bool = False) -> Column:
    """Lower-cased tokens of valid length; exact tags keep their case."""
    if exact:
        return F.filter(tokens, lambda t: valid_length(t, 1, MAX_EXACT_TAG_BYTES))
    return F.filter(F.transform(tokens, lambda t: F.lower(t)), lambda t: valid_length(t))


def tokenize(text: Column, low: int = MIN_TOKEN_BYTES, high: int = MAX_TOKEN_BYTES, separators: str | None = _CLASS) -> Column:
    """Words of a text; without separators the whole text is one token."""
    parts = F.split(F.lower(text), separators) if separators else F.array(F.lower(text))
    return F.filter(parts, lambda t: (t != "") & valid_length(t, low, high))


def query_tokens(query: str) -> list[str]:
    """Blank-separated words of a query, lower-cased; duplicates stay."""
    return query.lower().split()


def index_tags(memories_have_archived: bool = True) -> Column:
    """Lower-cased tags and the internal tags that the tag index holds for a record."""
    internal = F.array_compact(
        F.array(
            F.concat(F.lit("__type:"), F.col("memory_type")),
            F.when(F.col("flashbulb_until").isNotNull(), F.lit("__flashbulb__")),
            F.when(F.col("archived"), F.lit("__archived__")) if memories_have_archived else F.lit(None).cast("string"),
        )
    )
    return F.array_union(normalize_tokens(F.col("tags")), internal)


def matched_tokens(content: Column, tokens: list[str]) -> Column:
    """How many of the tokens, duplicates counted, occur in the lower-cased content."""
    total = F.lit(0)
    for t in tokens:
        total = total + F.contains(F.lower(content), F.lit(t)).cast("int")
    return total


def memory_key(id_: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), id_)


def memory_id(key: Column) -> Column:
    """The id in a key; null for keys of other kinds."""
    return F.when(key.startswith(KEY_PREFIX), F.substring(key, len(KEY_PREFIX) + 1, 1_000_000))


def is_memory_key(key: Column) -> Column:
    return key.startswith(KEY_PREFIX)


def parse_list(param: Column) -> Column:
    """Trimmed, non-empty parts of a comma-separated parameter."""
    return F.filter(F.transform(F.split(param, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_time_ms(param: Column) -> Column:
    """Milliseconds of an ISO time; without a zone it is UTC. Null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(param))


def entity_content(name: Column, kind: Column, description: Column) -> Column:
    """The text of an extracted entity; a null description is left out."""
    return F.concat_ws("\n", F.concat(F.lit("Entity: "), name), F.concat(F.lit("Type: "), kind), F.concat(F.lit("Description: "), description))
