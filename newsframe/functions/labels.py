"""Label maps."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Article types and the flag they stand for (True = fake).
ARTICLE_FLAGS = {
    "fake": True, "conspiracy": True, "junksci": True, "hate": True, "unreliable": True,
    "bias": True, "satire": True, "state": True,
    "reliable": False, "clickbait": False, "political": False,
}

# Article types that survive the row filter (`state` does not).
ARTICLE_TYPES = ["fake", "conspiracy", "junksci", "hate", "unreliable", "bias", "satire",
                 "reliable", "clickbait", "political"]

# Statement labels that count as fake; everything else is reliable.
FAKE_STATEMENTS = ["pants-fire", "false", "barely-true"]


def article_flag(kind: Column) -> Column:
    """True for fake types, False for reliable ones, True for unknown or missing types."""
    reliable = [name for name, fake in ARTICLE_FLAGS.items() if not fake]
    return ~F.coalesce(kind.isin(reliable), F.lit(False))


def statement_flag(label: Column) -> Column:
    """True for the fake labels, False for everything else including missing labels."""
    return F.coalesce(label.isin(FAKE_STATEMENTS), F.lit(False))


def statement_id(identifier: Column) -> Column:
    """Identifier up to its first dot."""
    return F.substring_index(identifier, ".", 1)
