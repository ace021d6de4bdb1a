"""What the corpus operators share: size-checked joins, Arrow passes over texts; lineage is cut as everywhere in the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.lineage import cut, drop_cut, shared_dir

__all__ = ["cut", "drop_cut", "shared_dir", "is_small", "join_checked", "slices", "map_texts", "sql_type", "fresh", "small_batches"]

#: A side is broadcast only if its rows and bytes, counted on the written table, stay below these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20
#: Texts are handed on in slices of about this many characters, so that a batch of long texts stays small.
SLICE_CHARS = 1 << 20
#: Words of more characters are not cached, so that caches of so many words are bounded in bytes too.
CACHED_CHARS = 32
#: Bytes of a batch of rows that goes to Python, unless the session names a bound of its own.
BATCH_BYTES, BATCH_BYTES_KEY, BATCH_BYTES_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session at BATCH_BYTES where it has the setting's default, so that memory stays small beside long texts.

    The setting stays: plans are lazy and read it when they run. It bounds batches of other queries of the session as well; a session that names a bound of its own keeps it.
    """
    if spark.conf.get(BATCH_BYTES_KEY, BATCH_BYTES_DEFAULT) == BATCH_BYTES_DEFAULT:
        spark.conf.set(BATCH_BYTES_KEY, BATCH_BYTES)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_small(written: DataFrame, wide: Sequence[str] = (), rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table can be broadcast, by its counted rows and the bytes of its wide columns."""
    total = sum((F.sum(F.octet_length(c)) for c in wide), F.lit(0))
    n, wide_bytes = written.agg(F.count(F.lit(1)), total).first()
    return n <= rows and n * 40 + (wide_bytes or 0) <= size


def join_checked(left: DataFrame, written: DataFrame, on: list[str], how: str, wide: Sequence[str] = ()) -> DataFrame:
    """Join with a written table: broadcast if it is small, else a shuffle join, whose hot keys AQE splits."""
    return left.join(F.broadcast(written) if is_small(written, wide) else written, on, how)


def slices(sizes: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of texts of the given sizes with about `limit` characters each; a longer text stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(df: DataFrame, columns: Sequence[str], schema: str, make: Callable[[], Callable[[list, list[str]], dict]]) -> DataFrame:
    """One Arrow pass over the given columns, of which the last is a text (null: empty).

    make() builds the function of a task; it gets the lists of the other columns and of the texts, and returns columns by name.
    Only the given columns are read, so that other columns of df, whatever their names, play no part.
    """
    picked = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, fields = make(), None
        for batch in batches:
            cells = batch.column(len(columns) - 1)
            for a, b in slices(pc.fill_null(pc.utf8_length(cells), 0).to_pylist()):
                texts = [x or "" for x in cells.slice(a, b - a).to_pylist()]
                got = work([batch.column(i).slice(a, b - a) for i in range(len(columns) - 1)], texts)
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, arrow_types[k]) for k, v in got.items()})
        pa.default_memory_pool().release_unused()

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow_types = {f.name: to_arrow_type(f.dataType) for f in kind.fields}
    return picked.mapInArrow(run, kind)


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
