"""Quality by compression: how much better does a dictionary of good text compress a text than one of bad text?

Two zstandard dictionaries hold snippets of good and bad labelled texts, two more the same snippets with letters and
digits reduced to their class, which shows layout. A whole text is cut to blocks, so that a dictionary counts for long
texts too, and each block is compressed with every dictionary. The size differences per byte, and the size per byte of
the whole text compressed by itself, are calibrated to a probability by a logistic regression. The sizes that it learns
from are those under dictionaries of other folds: under a dictionary that holds its own snippet, any text shrinks. The
penalty of the regression is chosen by folds within the rows that it learns from, never by held-out rows.

Fitted on at most ``rows`` labelled texts of each class, chosen by the hash of their id; every text is scored whole.
Null texts count as empty; an empty text gets a score like any other. With no text of a class to learn from, the score
is the share of good labels, or 0.5 with no labels. Null labels are left out; of several labels of an id the least
counts. Repeated rows are scored each; columns named like an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, with_python

#: Bytes of a dictionary, characters of a snippet, bytes of a block, compression level, folds of the calibration.
DICTIONARY, SNIPPET, BLOCK, LEVEL, FOLDS = 112_000, 1000, 1024, 3, 4
#: The class of each byte: lower case (and all beyond ASCII), upper case, digit, itself.
SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
PENALTIES = (0.1, 1.0, 10.0, 100.0)
NAMES = ("difference", "shape_difference", "alone")


class Compressors:
    """Sizes of a text under the bad and the good dictionary, as it is and by shape, and alone."""

    def __init__(self, bad: bytes, good: bytes):
        made = []
        for content in (bad, good, bad.translate(SHAPE), good.translate(SHAPE)):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False))
        self.bad, self.good, self.shape_bad, self.shape_good = (c.compress for c in made)
        self.alone = zstandard.ZstdCompressor(level=LEVEL).compress

    def measures(self, text: str) -> tuple[float, ...]:
        """NAMES, per byte."""
        raw = text.encode("utf-8", "replace")
        n = len(raw) + 1
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] or [b""]
        shapes = [b.translate(SHAPE) for b in blocks]
        bad, good = sum(len(self.bad(b)) for b in blocks), sum(len(self.good(b)) for b in blocks)
        shape_bad, shape_good = sum(len(self.shape_bad(b)) for b in shapes), sum(len(self.shape_good(b)) for b in shapes)
        return (bad - good) / n, (shape_bad - shape_good) / n, len(self.alone(raw)) / n


def _design(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -3, 3)  # what lies further out than the sample counts no more
    return np.column_stack([np.ones(len(z)), z, z * z])


def _regress(d: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Penalised logistic regression by steps of bounded curvature."""
    w = np.zeros(d.shape[1])
    # the curvature is at most a quarter everywhere, so these steps never overshoot, even where classes are apart
    bound = np.linalg.inv(0.25 * d.T @ d + penalty * np.eye(len(w)))
    for _ in range(5000):
        step = bound @ (d.T @ (y - 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Dictionaries and calibration; of fixed size. ``constant``: the score if there was nothing to learn from."""

    def __init__(self, bad: bytes = b"", good: bytes = b"", constant: float | None = None):
        self.bad, self.good, self.constant = bad, good, constant

    def calibrate(self, x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> Model:
        """Logistic regression with that one of PENALTIES whose log-loss over rows of other folds is least."""
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        d = _design(x, self.mean, self.spread)

        def loss(penalty: float) -> float:
            total = 0.0
            for fold in np.unique(folds):
                z = d[folds == fold] @ _regress(d[folds != fold], y[folds != fold], penalty)
                total += (np.logaddexp(0, z) - y[folds == fold] * z).sum()
            return total

        self.penalty = min(PENALTIES, key=loss)
        self.weights = _regress(d, y, self.penalty)
        return self

    def scorer(self):
        if self.constant is not None:
            return lambda text: (self.constant,)
        measures = Compressors(self.bad, self.good).measures

        def one(text: str) -> tuple[float]:
            z = _design(np.array([measures(text)]), self.mean, self.spread) @ self.weights
            return (float(1 / (1 + np.exp(-np.clip(z[0], -30, 30)))),)

        return one


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from fitting: crc32 of the id as text, modulo 3, is 1. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 2000, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Model:
    """A model from labelled texts that are not held out: at most ``rows`` of each class."""
    known = labels.where(~held_out(doc_id) & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(quality).alias("y"))
    each = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    chosen = F.broadcast(each[0].unionByName(each[1]))  # two times ``rows`` ids
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sample = saved(texts.join(chosen, "id").select("y", "text", F.xxhash64("id", F.lit(1)).alias("at"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(FOLDS)).alias("fold")))
    start = F.pmod(F.col("at"), F.greatest(F.length("text") - SNIPPET, F.lit(1))).cast("int") + 1
    chosen_snippets = [sample.where(F.col("y") == y).orderBy("at").limit(2 * DICTIONARY // SNIPPET).select("fold", F.substring(F.col("text"), start, F.lit(SNIPPET)).alias("s")).collect() for y in (0, 1)]
    parts = lambda fold: [b"\n".join(r.s.encode() for r in rows if r.fold != fold)[:DICTIONARY] for rows in chosen_snippets]
    whole = parts(None)
    if not all(whole):
        share = known.agg(F.avg("y")).first()[0]
        return Model(constant=0.5 if share is None else float(share))
    values, folds = [], []
    for fold in range(FOLDS):
        other = [p or q for p, q in zip(parts(fold), whole, strict=True)]  # a lone text has no other fold
        measured = with_python(sample.where(F.col("fold") == fold), "text", [(n, "double") for n in NAMES], lambda other=other: Compressors(*other).measures)
        found = [tuple(r) for r in measured.select("y", *NAMES).orderBy(*NAMES).collect()]  # at most 2 * ``rows`` in all
        values += found
        folds += [fold] * len(found)
    values = np.array(values, float)
    return Model(*whole).calibrate(values[:, 1:], values[:, 0], np.array(folds))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` and ``score``, the probability that the label is 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return with_python(docs, text, [("score", "double")], lambda: held.value.scorer())
