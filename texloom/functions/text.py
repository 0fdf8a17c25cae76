"""Column functions on text: tokens, sentences, previews, identifiers, canonical headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script, as both Java and RE2 read it.
WORD = r"[\p{L}\p{N}_]+"

#: Heading class and the words that give it; the first class with a word in the heading wins (fixed values).
CANONICAL = (
    ("abstract", ("abstract", "summary")),
    ("introduction", ("introduction", "intro", "background", "motivation")),
    ("related_work", ("related work", "literature review", "prior work", "background")),
    ("methodology", ("method", "methods", "methodology", "approach", "techniques")),
    ("experiments", ("experiments", "experimental setup", "evaluation", "results")),
    ("results", ("results", "findings", "analysis", "empirical results")),
    ("discussion", ("discussion", "analysis", "interpretation")),
    ("conclusion", ("conclusion", "conclusions", "future work", "summary")),
    ("acknowledgments", ("acknowledgments", "acknowledgements", "thanks")),
    ("references", ("references", "bibliography", "citations")),
)


def blank_tokens(text: Column) -> Column:
    """Lower-case tokens between white space; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Runs of word characters of any script."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def contains_all(text: Column, keywords: list[str]) -> Column:
    """Every keyword is a substring, whatever the case; ``%`` and ``_`` are ordinary characters."""
    return reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(k.lower())) for k in keywords], F.lit(True))


def contains_any(columns: list[Column], terms: list[str]) -> Column:
    """Some term is a substring of some column."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(t.lower())) for c in columns for t in terms], F.lit(False))


def match_count(text: Column, keywords: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(F.lower(text), F.lit(k.lower())).cast("int") for k in keywords], F.lit(0))


def query_keywords(text: str, most: int = 5, least_chars: int = 3) -> list[str]:
    """The words of a keyword query: lower case, of at least three characters, five at most."""
    return [w for w in text.lower().split() if len(w) >= least_chars][:most]


def search_terms(text: Column, most: int = 10, least_chars: int = 3) -> Column:
    """The words of a full-text query, punctuation removed."""
    return F.slice(F.filter(words(F.lower(text)), lambda w: F.length(w) >= least_chars), 1, most)


def preview(text: Column, chars: int) -> Column:
    """The first characters, and dots if there are more."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def sentences(text: Column, least_chars: int = 11) -> Column:
    """Sentences that end with a full stop, exclamation or question mark before white space; short ones and those that end
    with an abbreviation are left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c")))
    return F.filter(parts, lambda s: (F.length(s) >= least_chars) & ~s.rlike(r"(et al\.|Fig\.|Tab\.|Eq\.)$"))


def canonical_section(title: Column) -> Column:
    low = F.lower(title)
    chain = F.lit("other")
    for name, keys in reversed(CANONICAL):
        chain = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys]), name).otherwise(chain)
    return F.when(title.isNull(), F.lit("other")).otherwise(chain)


def stable_id(title: Column, kind: str) -> Column:
    """A readable id: kind, the first letters and digits, and a hash of the whole."""
    slug = F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), 1, 20)
    return F.concat_ws("_", F.lit(kind), slug, F.substring(F.md5(title), 1, 8))


def safe_filename(title: Column, chars: int = 50) -> Column:
    """Letters, digits, blank, - and _ only; blanks joined to _; a hash if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""), r"[ _]+", "_")
    cut = F.substring(F.btrim(kept, F.lit("_-")), 1, chars)
    return F.when(F.length(cut) > 0, cut).otherwise(F.substring(F.md5(F.coalesce(title, F.lit(""))), 1, 12))


def fenced_json(text: Column, schema: str) -> Column:
    """The JSON object of a text that may put it in a code fence."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(inner != "", inner).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), schema)


def labelled_line(text: Column, label: str) -> Column:
    """What follows ``LABEL:`` on its line."""
    return F.btrim(F.regexp_extract(text, rf"(?im)^\s*\**{label}\**\s*:\s*(.*)$", 1))
