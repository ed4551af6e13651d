"""Helpers shared by the corpus operators: tables, durable lineage cuts, Arrow row maps."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a Python operator holds at once, besides what one row needs.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and read it back, cutting the lineage.

    The folder is the one in spark.checkpoint.dir. Only on a local master, where driver
    and executors are one machine, a folder of its own is made if none is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores put before it until df has no column of that name, case apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the fold that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def hash_share(hashed: Column, wanted: int, total: int) -> Column:
    """Whether a row is in an even sample of about `wanted` out of `total`, by a 64-bit hash of it.

    The share is kept to 64 bits, so that it never rounds to nothing: of 1e11 rows, 1e4 stay 1e4.
    """
    if total <= wanted:
        return F.lit(True)
    return hashed < F.lit(min((1 << 63) - 1, -(1 << 63) + max(1, (wanted << 64) // total)))


def fitted(sample: DataFrame, train: Callable[[list[dict]], object]):
    """train() on the rows of a bounded sample, as dicts, in one task; None where there are no rows.

    The rows need not pass through the driver, a lost executor costs a retry, and numpy
    keeps to the task's own cores. train() must not depend on the order of the rows.
    """

    def run(batches):
        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], type=pa.binary())], names=["model"])

    got = sample.coalesce(1).mapInArrow(run, "model binary").collect()  # one row, the model
    return pickle.loads(got[0]["model"]) if got else None


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each part holds about SLICE_CHARS of the column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= SLICE_CHARS:
                yield batch.slice(begin, i + 1 - begin)
                begin, total = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def map_text(
    df: DataFrame,
    column: str,
    start: Callable[[], Callable[[list], dict]],
    added: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Apply a batch function to a text column.

    start() runs once a task and returns a function from a list of texts (None where
    null) to a dict of columns, one value a row. The result holds the columns in keep
    (default: all but the text) and those in added. A name both in keep and in
    added takes the new values.
    """
    keep = [c for c in df.columns if c != column] if keep is None else keep
    new = T._parse_datatype_string(added) if added else T.StructType()
    names = {f.name for f in new}
    schema = T.StructType([df.schema[c] for c in keep if c not in names] + list(new))
    kept = [c for c in keep if c not in names]
    source = df.select(*dict.fromkeys([*kept, column]))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        apply = start()
        for part in slices(batches, column):
            out = apply(part.column(column).to_pylist())
            arrays = [part.column(c) for c in kept] + [pa.array(out[f.name], type=arrow.field(f.name).type) for f in new]
            arrays = [a.cast(arrow.field(i).type) if a.type != arrow.field(i).type else a for i, a in enumerate(arrays)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


def change_rows(df: DataFrame, column: str, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """df with its batches, cut by the characters of a text column, put through a function that keeps their columns.

    start() runs once a task and returns the function; it may leave out rows. Whatever
    the columns are called, none is added or renamed on the way.
    """
    schema = df.schema

    def run(batches):
        apply = start()
        for part in slices(batches, column):
            yield apply(part)

    return df.mapInArrow(run, schema)


def filter_text(df: DataFrame, column: str, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of df that a batch function of a text column flags; start() runs once a task and returns it."""

    def begin():
        flags = start()
        return lambda part: part.filter(pa.array(flags(part.column(column).to_pylist()), type=pa.bool_()))

    return change_rows(df, column, begin)
