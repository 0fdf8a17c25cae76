"""Reference entries, citations in the text, and the links between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import located
from .phrases import held


def _first(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def parsed(entries: DataFrame, text: str = "citation_text", position: str = "position") -> DataFrame:
    """``entries`` with key, year, title, doi, arxiv id, venue and authors of each reference; null where not found."""
    t = F.col(text)
    return entries.withColumns({
        "citation_key": F.coalesce(_first(t, r"^\s*\[?([0-9]+)[\].]"), (F.col(position) + 1).cast("string")),
        "year": F.expr(f"try_cast(regexp_extract({text}, '((?:19|20)[0-9]{{2}})', 1) as int)"),
        "title": F.btrim(_first(t, "[\"“]([^\"”]+)[\"”]", r"\.\s+([A-Z][^.]{10,})\."), F.lit(" ,.")),
        "doi": _first(t, r"\b(10\.[0-9]{4,9}/[^\s,;]+)"),
        "cited_arxiv_id": _first(t, r"(?i)arxiv:\s*([0-9]{4}\.[0-9]{4,5})"),
        "venue": _first(t, r"((?:Journal of|Proceedings of)[^,.]+)", r"\b([A-Z]{3,})\s*(?:19|20)[0-9]{2}"),
        "authors": F.filter(F.transform(F.split(F.regexp_extract(F.regexp_replace(t, r"^\s*\[?[0-9]+[\].]\s*", ""), r"^([A-Z][^.\"“]*)", 1), r"\s+and\s+|,\s*(?=[A-Z])"), lambda a: F.btrim(a, F.lit(" ,"))), lambda a: a != ""),
    })


#: Kinds of citations in the text and their patterns.
IN_TEXT = {
    "numeric": r"\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\]",
    "author_year": r"\([A-Z][A-Za-z'-]+(?:\s+et al\.|\s+and\s+[A-Z][A-Za-z'-]+)?,\s*(?:19|20)[0-9]{2}[a-z]?\)",
    "named": r"[A-Z][A-Za-z'-]+(?:\s+et al\.|\s+and\s+[A-Z][A-Za-z'-]+)?\s+\((?:19|20)[0-9]{2}[a-z]?\)",
}


def in_text(paragraphs: DataFrame, key: str = "doc_id", text: str = "text", around: int = 100) -> DataFrame:
    """key, kind, position, citation, before, after: citations with their place and the characters on both sides.

    A row of ``paragraphs`` is told by its key. Texts without any citation are not looked at again.
    """
    some = paragraphs.where(F.col(text).rlike("|".join(IN_TEXT.values()))).select(key, text)
    found = reduce(DataFrame.unionByName, [located(some, p, key, text).withColumn("kind", F.lit(kind)) for kind, p in IN_TEXT.items()])
    low = F.greatest(F.col("start") - around, F.lit(0))
    return found.join(some, key).select(
        key, "kind", F.col("start").cast("int").alias("position"), F.col("match").alias("citation"),
        F.substring(text, low + 1, F.col("start") - low).alias("before"), F.substring(text, F.col("end") + 1, F.lit(around)).alias("after"),
    )


def cited_numbers(citation: Column) -> Column:
    """The numbers of ``[1, 3-5]``, ranges spelt out."""
    parts = F.split(F.regexp_replace(F.btrim(citation, F.lit("[]")), r"\s+", ""), ",")
    low = lambda p: F.regexp_extract(p, r"^([0-9]+)", 1).cast("int")
    high = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"[–-]([0-9]+)$", 1), F.lit("")), F.regexp_extract(p, r"^([0-9]+)", 1)).cast("int")
    return F.flatten(F.transform(parts, lambda p: F.when(high(p) >= low(p), F.sequence(low(p), high(p))).otherwise(F.array(low(p)))))


def linked(cited: DataFrame, references: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kind, position, citation, ref_id): numeric citations by number, the others by year and an author's name; the
    earliest fitting reference wins. An unlinked citation has null."""
    refs = references.select(key, F.col("ref_id"), F.col("position").alias("ref_position"), "citation_key", "authors", F.col("year").alias("ref_year"))
    numbers = cited.where("kind = 'numeric'").select(key, "kind", "position", "citation", F.explode(cited_numbers(F.col("citation"))).alias("number"))
    by_number = numbers.join(refs, (numbers[key] == refs[key]) & (F.col("number").cast("string") == F.col("citation_key")), "left").select(numbers[key], "kind", "position", "citation", "number", "ref_id", "ref_position")
    others = cited.where("kind <> 'numeric'").select(key, "kind", "position", "citation", F.regexp_extract("citation", r"\(?([A-Z][A-Za-z'-]+)", 1).alias("name"), F.regexp_extract("citation", r"((?:19|20)[0-9]{2})", 1).cast("int").alias("cited_year"))
    match = (others[key] == refs[key]) & (F.col("cited_year") == F.col("ref_year")) & F.exists(F.col("authors"), lambda a: F.contains(a, F.col("name")))
    by_year = others.join(refs, match, "left").select(others[key], "kind", "position", "citation", F.lit(None).cast("int").alias("number"), "ref_id", "ref_position")
    return by_number.unionByName(by_year).groupBy(key, "kind", "position", "citation", "number").agg(F.min_by("ref_id", "ref_position").alias("ref_id"))


def quoted(docs: DataFrame, items: DataFrame, window: int = 4) -> DataFrame:
    """(item_id, n, first_doc): how many documents hold the text of each item, and the least of them.

    The first and last word of an item may be parts of longer words in a document, so the key is a window of the words
    between them, of up to ``window`` words. Only ids and hashes meet; texts are fetched for the hits. Items of one or two
    words have no word between and are keyed by their rarest q-gram.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    long = items.withColumn("w", words("text")).withColumn("size", F.least(F.size("w") - 2, F.lit(window)))
    keys = long.where("size > 0").select("item_id", F.xxhash64("size", F.slice("w", F.lit(2), F.col("size"))).alias("h"))
    sizes = sorted(r[0] for r in long.where("size > 0").select("size").distinct().collect())  # at most ``window`` numbers
    hits = None
    for size in sizes:
        all_windows = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.xxhash64(F.lit(size), F.slice("w", i, F.lit(size))))  # noqa: B023
        found = docs.withColumn("w", words("text")).where(F.size("w") >= size).select("doc_id", F.explode(F.array_distinct(all_windows)).alias("h")).join(keys, "h").select("item_id", "doc_id")
        hits = found if hits is None else hits.unionByName(found)
    both = []
    if hits is not None:
        texts = hits.distinct().join(items.select("item_id", F.col("text").alias("item")), "item_id").join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
        both.append(texts.where(F.contains("body", F.col("item"))).select("item_id", "doc_id"))
    short = long.where("size <= 0")
    if not short.isEmpty():
        both.append(held(docs, short, phrase_id="item_id", phrase="text").select(F.col("phrase_id").alias("item_id"), "doc_id"))
    none = items.select("item_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first_doc"))
    if not both:
        return none
    counts = reduce(DataFrame.unionByName, both).groupBy("item_id").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("first_doc"))
    return items.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"), "first_doc")


def search(references: DataFrame, cited: DataFrame, words: str, key: str = "doc_id", k: int = 20) -> DataFrame:
    """The newest references whose title, venue or authors hold the words, with the number of their citations in the text.

    ``references``: key, ref_id, title, venue, authors, year; ``cited``: links as ``linked`` gives them.
    """
    low = F.lit(words.lower())
    hit = F.coalesce(F.contains(F.lower("title"), low), F.lit(False)) | F.coalesce(F.contains(F.lower("venue"), low), F.lit(False)) | F.contains(F.lower(F.array_join("authors", ", ")), low)
    counts = cited.where("ref_id is not null").groupBy("ref_id").agg(F.count(F.lit(1)).alias("in_text"))
    found = references.where(hit).join(counts, "ref_id", "left").withColumn("in_text", F.coalesce("in_text", F.lit(0)))
    return found.orderBy(F.desc_nulls_last("year"), key, "ref_id").limit(k)


def link_rate(links: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: links found in percent."""
    return links.groupBy(key).agg((100 * F.avg(F.col("ref_id").isNotNull().cast("int"))).alias("link_rate"))
