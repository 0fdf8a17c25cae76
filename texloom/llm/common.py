"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only, so any store that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of about ``most`` bytes in the last column, a row each at least; Spark bounds the batches themselves by bytes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy().astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1).tolist(), len(size)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin < end:
                yield batch.slice(begin, end - begin)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder of the session; where none is set, a folder of our own on a single machine only."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="texloom-"))
    return df.checkpoint()


def nonnull_text(column: str = "text"):
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_python(df: DataFrame, column: str, fields: list[tuple[str, str]], prepare) -> DataFrame:
    """``df`` and ``fields`` (name, SQL type) made from one text column, in Arrow batches.

    ``prepare()`` runs once for each task and gives the function from a text (null: empty) to a tuple of values. Columns
    of ``df`` that are named like a field are replaced, all others pass through.
    """
    names = {name.lower() for name, _ in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in names]
    made = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    source = df.select(*[F.col(f"`{f.name}`") for f in keep], nonnull_text(f"`{column}`").alias("__text"))
    kinds = list(to_arrow_schema(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = prepare()
        for batch in slices(batches):
            rows = [one(value.as_py()) for value in batch.column(batch.num_columns - 1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            arrays = [pa.array(list(c), k.type) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*(f.name for f in keep), *(k.name for k in kinds)])

    return source.mapInArrow(run, StructType([*keep, *made.fields]))


#: Components whose integers go beyond this count as non-finite: of up to 512 of them squared distances still are longs.
LARGEST = 1 << 26


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component as array<int>; null if the vector is null or a component is null, non-finite or beyond LARGEST."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & (F.abs(c * factor) < LARGEST))  # NaN is beyond all numbers
    return F.when(fine, F.transform(x, lambda c: F.floor(c * factor).cast("int")))


def int_rows(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """A matrix of the lists of an Arrow column, short ones filled up with zeros to ``width``, the longest by default."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat, wide = lists.flatten().to_numpy(), int(sizes.max(initial=0)) if width is None else width
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), flat.dtype)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out
