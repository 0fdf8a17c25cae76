"""A stored inverted index for ranked search: built once as tables, read by term, and by block as far as the top k need.

``postings`` is bucketed by a hash of the term and sorted by it, so a query opens the files of its terms' buckets only. A
row is a block of postings of one term whose weight is alike: documents of one layer of term weight, and of one share of the
ids, so a block stays of bounded size however common its term is. Each block has its greatest count and its shortest
document, which bound the score that it can add for any k1 and b. ``terms`` has document frequencies, bucketed alike;
``documents`` the lengths; ``totals`` is one row.

A search bounds the k-th score from below by its best blocks, and then reads only blocks whose documents can still reach it.

Every build goes to a folder of its own, so one session never takes away the files that another reads. A build is found again
by its row of totals, which is written last and tells what it was built from and how many files it has.

A null text counts as empty. Documents without a term of the query score 0 and fill up the top k, ties by the smaller id.
A document's id is taken as its name: rows of one id are one document.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from texloom.functions.text import blank_tokens

from .retrieval import idf

#: Layers of term weight, and documents of a share at most.
LAYERS, SHARE = 16, 1 << 12


def saturation(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    """What the score multiplies an idf by; it grows with the count and falls with the length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(avgdl or 1.0)))


def postings(docs: DataFrame, doc_id: str, text: str, tokens) -> DataFrame:
    """(share, term, doc_id, dl, tf). Of ``docs`` that are dealt by ``share`` the counts are made where the texts are."""
    each = docs.select("share", F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t")).select("share", "doc_id", F.size("t").cast("long").alias("dl"), F.explode_outer("t").alias("term")).where("term is not null")
    return each.groupBy("share", "term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class TextIndex:
    """The tables of an index by the start of their names."""

    spark: SparkSession
    name: str

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(f"{self.name}_totals")  # written last

    def whole(self, totals: Row | None) -> bool:
        """Whether a build, by its row of totals, is of this name and has all its files."""
        if totals is None or totals.made_for != self.name:
            return False
        return all(_files(self.spark, f"{totals.folder}/{part}") == n for part, n in totals.files.items())

    def current(self) -> bool:
        """Whether this catalog has the index as ``of`` builds it; tables that something else put under the name, or whose files are gone, are not."""
        try:
            return self.exists() and self.whole(self.table("totals").first())
        except Exception as e:
            if _gone(e) or "UNRESOLVED_COLUMN" in str(e) or "made_for" in str(e):
                return False
            raise

    def found(self, folder: str) -> bool:
        """Take up a whole build that another session has left under ``folder``, if there is one."""
        try:
            builds = self.spark.read.parquet(f"{folder}/{self.name}/*/totals").orderBy("folder").collect()  # a row for each build
        except Exception as e:
            if _gone(e):
                return False
            raise
        totals = next((b for b in builds if self.whole(b)), None)
        if totals is None:
            return False
        for part in (*totals.files, "totals"):
            path = f"{totals.folder}/{part}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema.fields)
            bucketed = f"clustered by (term) sorted by (term) into {totals.buckets} buckets" if part in ("postings", "terms") else ""
            self.spark.sql(f"drop table if exists {self.name}_{part}")
            self.spark.sql(f"create table {self.name}_{part} ({columns}) using parquet {bucketed} location '{path}'")
        return True

    def build(self, docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokens=blank_tokens, buckets: int | None = None, share: int = SHARE, made_for: str | None = None) -> TextIndex:
        """Write all tables to a new folder under ``folder``, in place of those that the catalog has; the one row of totals comes last.

        The texts are dealt once, by share, and a task makes the postings and blocks of its shares where they are, so no posting is
        shuffled. There is a bucket for each million documents, 32 at least, and each task writes its own file of a bucket.
        """
        folder = f"{folder}/{self.name}/{uuid.uuid4().hex}"

        def write(df: DataFrame, part: str, by: str | None = None) -> None:
            out = df.write.mode("overwrite").format("parquet").option("path", f"{folder}/{part}")
            (out.bucketBy(buckets, by).sortBy(by) if by else out).saveAsTable(f"{self.name}_{part}")

        self.spark.sql(f"drop table if exists {self.name}_totals")
        write(docs.select(F.col(doc_id).alias("doc_id"), F.size(tokens(F.col(text))).cast("long").alias("dl")), "documents")
        n, avgdl = self.table("documents").agg(F.count(F.lit(1)), F.avg("dl")).first()
        shares, buckets = -(-max(n, 1) // share), buckets or max(32, n >> 20)
        layer = F.least(F.lit(LAYERS - 1), F.floor(saturation(F.col("tf"), F.col("dl"), avgdl or 1.0, 1.5, 0.75) / 2.5 * LAYERS).cast("int"))
        dealt = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id), F.lit(shares)).cast("int").alias("share")).repartition(shares, "share")
        blocks = postings(dealt, "doc_id", "text", tokens).groupBy("share", "term", layer.alias("layer")).agg(
            F.sort_array(F.collect_list(F.struct("doc_id", "tf", "dl"))).alias("docs"), F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")
        )
        write(blocks, "postings", "term")
        write(self.table("postings").groupBy("term").agg(F.sum("n").alias("df")).repartition(buckets, "term"), "terms", "term")
        mean = self.table("terms").agg(F.avg(idf(F.lit(n), F.col("df")))).first()[0]
        files = {part: _files(self.spark, f"{folder}/{part}") for part in ("documents", "postings", "terms")}
        row = (n, avgdl or 0.0, mean or 0.0, made_for, folder, buckets, files)
        write(self.spark.createDataFrame([row], "n long, avgdl double, mean_idf double, made_for string, folder string, buckets int, files map<string, int>"), "totals")
        return self

    def weights(self, query: list[str], epsilon: float = 0.25) -> tuple[dict[str, float], float]:
        """The weight of each term of the query that a document has, as often as the query has it, and the mean length."""
        n, avgdl, mean = self.table("totals").select("n", "avgdl", "mean_idf").first()
        found = self.table("terms").where(F.col("term").isin(*query)).collect() if query else []  # a row for each term
        own = {r.term: math.log(n - r.df + 0.5) - math.log(r.df + 0.5) for r in found}
        return {t: query.count(t) * (epsilon * mean if own[t] < 0 else own[t]) for t in dict.fromkeys(query) if t in own}, avgdl

    def scores(self, weights: dict[str, float], avgdl: float, blocks: DataFrame, k1: float, b: float) -> DataFrame:
        """(doc_id, score) over the blocks, each term's part added in the order of the query."""
        each = blocks.select("term", F.inline("docs")).groupBy("doc_id")
        parts = each.agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.lit(w) * saturation(F.col("tf"), F.col("dl"), avgdl, k1, b))), F.lit(0.0)).alias(f"s{i}") for i, (t, w) in enumerate(weights.items())])
        return parts.select("doc_id", sum((F.col(f"s{i}") for i in range(len(weights))), F.lit(0.0)).alias("score"))

    def top(self, query: list[str], k: int, within: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
        """(doc_id, score): the ``k`` best by Okapi BM25, of the ids in ``within`` (doc_id) if it is given."""
        weights, avgdl = self.weights(query, epsilon)
        ids = None if within is None else within.select("doc_id").distinct()
        kept = lambda df: df if ids is None else df.join(ids, "doc_id", "left_semi")
        order = [F.desc("score"), F.asc("doc_id")]
        zeros = kept(self.table("documents")).select("doc_id", F.lit(0.0).alias("score"))
        if not weights:
            return zeros.orderBy(*order).limit(k)
        blocks = self.table("postings").where(F.col("term").isin(*weights))
        if min(weights.values()) >= 0:
            blocks = self.promising(blocks, weights, avgdl, k, kept, k1, b)
            hits = kept(self.scores(weights, avgdl, blocks, k1, b)).where("score > 0").orderBy(*order).limit(k)
            rest = zeros.orderBy("doc_id").limit(2 * k)  # at most k of these are hits
            return hits.unionByName(rest.join(hits, "doc_id", "left_anti")).orderBy(*order).limit(k)
        hits = kept(self.scores(weights, avgdl, blocks, k1, b))
        return hits.unionByName(zeros.join(hits, "doc_id", "left_anti")).orderBy(*order).limit(k)

    def promising(self, blocks: DataFrame, weights: dict[str, float], avgdl: float, k: int, kept, k1: float, b: float) -> DataFrame:
        """The blocks that hold every document of the top k with all its terms; the others' documents cannot reach it.

        Weights are not negative, so a part of a document's terms gives it no more than its score: the k-th score by the best
        layers of each term is a lower bound. A document of a block scores at most the block's bound and the greatest ones of
        the other terms in its share of the documents, so a common term is read only where a rarer one can help.
        """
        weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("term"))
        bound = weight * saturation(F.col("max_tf"), F.col("min_dl"), avgdl, k1, b)
        layers = blocks.groupBy("term", "layer").agg(F.sum("n").alias("n")).collect()  # LAYERS rows a term at most
        first = F.lit(False)
        for t in weights:
            held = 0
            for r in sorted((r for r in layers if r.term == t), key=lambda r: -r.layer):
                if held < 4 * k:
                    first |= (F.col("term") == t) & (F.col("layer") == r.layer)
                    held += r.n
        head = kept(self.scores(weights, avgdl, blocks.where(first), k1, b)).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        if head.n < k:
            return blocks
        shares = blocks.groupBy("share").agg(*[F.coalesce(F.max(F.when(F.col("term") == t, bound)), F.lit(0.0)).alias(f"m{i}") for i, t in enumerate(weights)])
        others = sum((F.when(F.col("term") == t, F.lit(0.0)).otherwise(F.col(f"m{i}")) for i, t in enumerate(weights)), F.lit(0.0))
        return blocks.join(shares, "share").where(bound + others >= head.least * (1 - 1e-9)).select(blocks.columns)


def _gone(error: Exception) -> bool:
    """Whether a read failed because files are not, or no longer, there."""
    return any(x in str(error) for x in ("PATH_NOT_FOUND", "FileNotFoundException", "FILE_NOT_EXIST", "does not exist", "UNABLE_TO_INFER_SCHEMA"))


def _files(spark: SparkSession, path: str) -> int:
    """Files of a table; 0 if it is not there."""
    try:
        return len(spark.read.parquet(path).inputFiles())
    except Exception as e:
        if _gone(e):
            return 0
        raise


def of(docs: DataFrame, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", tokens=blank_tokens, **options) -> TextIndex:
    """The index of the rows that ``docs`` reads from files: that of this catalog, or one that another session left in ``folder``, if all its files are
    there; else it is built. Its name follows the files' paths, sizes, times and rows, the columns and the tokens, so changed files get a new one.
    ``folder``: the session's warehouse by default."""
    spark = docs.sparkSession
    files = docs.groupBy("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").agg(F.count(F.lit(1)).alias("rows"))
    version = files.agg(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time", "rows"))).first()[0] or 0
    version ^= zlib.crc32(f"2 {doc_id} {text} {tokens.__module__}.{tokens.__qualname__}".encode())  # 2: the tables' layout
    index = TextIndex(spark, f"texloom_index_{version & (1 << 64) - 1:016x}")
    folder = folder or spark.conf.get("spark.sql.warehouse.dir")
    return index if index.current() or index.found(folder) else index.build(docs, folder, doc_id, text, tokens, made_for=index.name, **options)
