"""Lexicon entities, their relationships and co-occurrence."""

from __future__ import annotations

import re._parser as sre
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns and words of context by type (fixed values). Order decides pairs and which mention is first.
_TYPES = {
    "method": (
        (
            r"\b(?:neural network|deep learning|machine learning|CNN|RNN|LSTM|GRU|transformer|BERT|GPT)\b",
            r"\b(?:algorithm|approach|method|technique|framework|model|architecture)\b",
            r"\b(?:gradient descent|backpropagation|attention mechanism|self-attention)\b",
            r"\b(?:classification|regression|clustering|reinforcement learning)\b",
        ),
        ("propose", "introduce", "implement", "develop", "design"),
    ),
    "dataset": (
        (r"\b(?:ImageNet|CIFAR|MNIST|COCO|WikiText|Common Crawl|OpenWebText)\b", r"\bdataset\b", r"\bcorpus\b", r"\bbenchmark\b"),
        ("train", "evaluate", "test", "dataset", "data"),
    ),
    "metric": (
        (r"\b(?:accuracy|precision|recall|F1|BLEU|ROUGE|perplexity|AUC|MAP)\b", r"\b(?:loss|error|score|performance|evaluation)\b"),
        ("achieve", "measure", "evaluate", "score", "performance"),
    ),
    "tool": (
        (r"\b(?:PyTorch|TensorFlow|Keras|scikit-learn|Hugging Face|OpenAI|LangChain)\b", r"\b(?:Python|R|MATLAB|Julia|framework|library|toolkit)\b"),
        ("use", "implement", "build", "develop"),
    ),
    "concept": (
        (
            r"\b(?:artificial intelligence|AI|natural language processing|NLP|computer vision|CV)\b",
            r"\b(?:supervised learning|unsupervised learning|semi-supervised|few-shot|zero-shot)\b",
            r"\b(?:optimization|regularization|generalization|overfitting|underfitting)\b",
        ),
        ("concept", "idea", "theory", "principle"),
    ),
    "institution": (
        (r"\b(?:University|Institute|Laboratory|Lab|Research|Center|Centre)\b[^.]{0,50}", r"\b(?:MIT|Stanford|Harvard|Berkeley|CMU|Google|Microsoft|Facebook|OpenAI)\b"),
        ("affiliation", "university", "research"),
    ),
}
LEXICON = tuple((kind, pattern, context) for kind, (patterns, context) in _TYPES.items() for pattern in patterns)
STOP = ("the", "and", "or", "in", "on", "at")

#: Phrases that tell a relationship (fixed values).
RELATIONS = {
    "uses": (r"\w+\s+(?:uses|utilizes|employs|applies)\s+\w+", r"using\s+\w+", r"based on\s+\w+"),
    "implements": (r"implement(?:s|ed)?\s+\w+", r"\w+\s+implementation", r"develop(?:s|ed)?\s+\w+"),
    "compares": (r"compar(?:e|es|ed)\s+(?:with|to|against)\s+\w+", r"\w+\s+(?:vs|versus)\s+\w+", r"baseline\s+\w+"),
    "evaluates": (r"evaluat(?:e|es|ed)\s+(?:on|using)\s+\w+", r"test(?:s|ed)?\s+on\s+\w+", r"experiment(?:s)?\s+(?:with|on)\s+\w+"),
    "extends": (r"extend(?:s|ed)?\s+\w+", r"build(?:s)?\s+(?:on|upon)\s+\w+", r"improv(?:e|es|ed)\s+\w+"),
}


def needed(pattern: str) -> list[str]:
    """Strings, in lower case, of which every match of a pattern holds one, whatever the case; none if that can't be told."""

    def of(parts) -> list[str]:
        found, run = [], ""
        for op, arg in [*parts, (None, None)]:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            found, run = found + ([[run]] if run else []), ""
            if op is sre.SUBPATTERN:
                found.append(of(arg[3]))
            elif op is sre.BRANCH:
                each = [of(p) for p in arg[1]]
                found.append([x for xs in each for x in xs] if all(each) else [])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                found.append(of(arg[2]))
        return max(found, key=lambda xs: min(map(len, xs), default=0), default=[])

    return list(dict.fromkeys(x.lower() for x in of(sre.parse(pattern))))


def matches(text: Column, low: Column, pattern: str) -> Column:
    """All matches of a pattern, whatever the case. Most texts hold none, and are told by plain searches in ``low``, the text in lower case."""
    found = F.regexp_extract_all(text, F.lit(f"(?i)({pattern})"), F.lit(1))
    some = needed(pattern)
    if not some or not all(x.isascii() for x in some):
        return found
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in some]), found).otherwise(F.array().cast("array<string>"))


def with_mentions(chunks: DataFrame, lexicon=LEXICON, text: str = "text", out: str = "mentions") -> DataFrame:
    """``chunks`` and an array of the mentions in each: entity_type, seq, position, entity_text, confidence.

    Each pattern is an expression over the chunk, and what its context adds is found once for a chunk, if it has a match.
    """
    rows, parts = chunks.withColumn("__low", F.lower(text)), []
    for seq, (kind, pattern, context) in enumerate(lexicon):
        boost = sum((F.contains("__low", F.lit(w)).cast("int") for w in context), F.lit(0)) * 0.1
        found = matches(F.col(text), F.col("__low"), pattern)
        parts.append(F.flatten(F.transform(F.filter(F.array(found), lambda x: F.size(x) > 0), _mentions(kind, seq, boost))))
    kept = F.filter(F.concat(*parts), lambda m: (F.length(m.entity_text) >= 3) & ~F.lower(m.entity_text).isin(*STOP))
    return rows.withColumn(out, kept).drop("__low")


def mentions(chunks: DataFrame, lexicon=LEXICON, doc_id: str = "doc_id", chunk_id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, entity_type, seq, position, entity_text, confidence): all matches of all patterns, whatever the case.

    The arrays of a chunk are joined and exploded once, so a chunk is read once. (An outer explode: of an inner one Spark infers
    a filter on the array, for which it makes the array twice more.)
    """
    rows = chunks.select(F.col(doc_id).alias("doc_id"), F.col(chunk_id).alias("chunk_id"), F.col(text).alias("__text"))
    return with_mentions(rows, lexicon, "__text").select("doc_id", "chunk_id", F.explode_outer("mentions").alias("m")).where("m is not null").select("doc_id", "chunk_id", "m.*")


def _mentions(kind: str, seq: int, boost: Column):
    return lambda found: F.element_at(F.transform(F.array(boost), lambda b: F.transform(found, _mention(kind, seq, b))), 1)


def _mention(kind: str, seq: int, boost: Column):
    def made(m: Column, i: Column) -> Column:
        confidence = 0.5 + F.when(m.rlike("^[A-Z]"), 0.2).otherwise(0.0) + F.when(F.contains(m, F.lit(" ")), 0.1).otherwise(0.0) + boost
        return F.struct(F.lit(kind).alias("entity_type"), F.lit(seq).alias("seq"), i.alias("position"), m.alias("entity_text"), F.least(F.lit(1.0), confidence).alias("confidence"))

    return made


def merged(found: DataFrame) -> DataFrame:
    """One row per document, type and lower-case text: mentions, greatest confidence, the first text, the chunks."""
    first = F.struct("chunk_id", "seq", "position")
    return found.groupBy("doc_id", "entity_type", F.lower("entity_text").alias("normalized")).agg(
        F.count(F.lit(1)).alias("mention_count"), F.max("confidence").alias("confidence"), F.min_by("entity_text", first).alias("entity_text"), F.min(first).alias("first_at"), F.array_sort(F.collect_set("chunk_id")).alias("chunks")
    ).withColumn("entity_id", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "entity_type", "normalized")))


def citation_authors(citations: DataFrame, doc_id: str = "doc_id", authors: str = "authors") -> DataFrame:
    """Distinct author entities of a comma-separated column, names longer than three characters."""
    names = citations.select(F.col(doc_id).alias("doc_id"), F.explode(F.split(authors, ",")).alias("a")).select("doc_id", F.btrim("a").alias("entity_text"))
    return names.where(F.length("entity_text") > 3).distinct().select("doc_id", F.lit("author").alias("entity_type"), "entity_text", F.lit(0.9).alias("confidence"))


def cooccurrence(found: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, source, target): pairs of distinct entities of a chunk, in the order of type and text; rows of no chunk are left out.

    Pairs are formed of the distinct entities of one chunk, whose number a chunk's size bounds.
    """
    names = F.array_sort(F.collect_set(F.struct("entity_type", F.lower("entity_text").alias("name"))))
    each = found.where("chunk_id is not null").groupBy("doc_id", "chunk_id").agg(names.alias("es"))
    left = each.select("doc_id", "chunk_id", "es", F.posexplode("es").alias("i", "source"))
    return left.select("doc_id", "chunk_id", "source", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("target"))


def phrases(chunks: DataFrame, patterns: dict[str, tuple[str, ...]] = RELATIONS, doc_id: str = "doc_id", text: str = "text", apart: str | None = None) -> DataFrame:
    """(doc_id, relationship, context): the distinct phrases of a document that tell a relationship.

    ``apart`` is a class of characters other than word characters that no match holds: a text is cut at them, and a pattern tried only on the pieces that can match.
    """
    rows = chunks.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    if apart is None:
        rows = rows.withColumn("__low", F.lower("__text"))
        each = lambda p: matches(F.col("__text"), F.col("__low"), p)
    else:
        rows = rows.withColumn("__pieces", F.split("__text", apart))
        each = lambda p: F.flatten(F.transform("__pieces", lambda x: matches(x, F.lower(x), p)))
    found = [F.transform(each(p), _named(kind)) for kind, ps in patterns.items() for p in ps]
    return rows.select("doc_id", F.explode_outer(F.concat(*found)).alias("p")).where("p is not null").select("doc_id", "p.*").distinct()


def relations(chunks: DataFrame, entities: DataFrame, patterns: dict[str, tuple[str, ...]] = RELATIONS, doc_id: str = "doc_id", text: str = "text", apart: str | None = None) -> DataFrame:
    """(doc_id, relationship, source, target, context): pairs of a document's entities whose text stands in a matched phrase."""
    names = entities.select("doc_id", "normalized").distinct()
    inside = phrases(chunks, patterns, doc_id, text, apart).join(names, "doc_id").where(F.contains(F.lower("context"), F.col("normalized")))
    each = inside.groupBy("doc_id", "relationship", "context").agg(F.array_sort(F.collect_set("normalized")).alias("es"))
    left = each.select("doc_id", "relationship", "context", "es", F.posexplode("es").alias("i", "source"))
    return left.select("doc_id", "relationship", "source", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("target"), "context")


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("relationship"), x.alias("context"))


def search(entities: DataFrame, terms: list[str], k: int = 20) -> DataFrame:
    """Entities whose text or type holds a term, the surest first."""
    from texloom.functions.text import contains_any

    hits = entities.where(contains_any([F.col("entity_text"), F.col("entity_type")], terms))
    return hits.orderBy(F.desc("confidence"), F.desc("mention_count"), "doc_id", "entity_type", "normalized").limit(k)


def ranked_types(entities: DataFrame) -> DataFrame:
    """Per type: entities, mentions, mean confidence, rank by number."""
    s = entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.sum("mention_count").alias("mentions"), F.avg("confidence").alias("avg_confidence"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "entity_type")))  # a row per type
