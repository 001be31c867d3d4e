"""Helpers shared by the text operators: Arrow batches in, bytes inside, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task works on at a time.
SLICE_BYTES = 8 << 20

#: A-Z become a-z, every other ASCII character that is no letter or digit becomes a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def ascii_lower(column) -> F.Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_aside(docs: DataFrame) -> DataFrame:
    """``docs`` with every column but ``text`` under a name that no result column has; ``toDF`` brings the names back."""
    return docs.toDF(*[c if c == "text" else f"c{i}_" for i, c in enumerate(docs.columns)])


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that the texts of each part sum to about ``limit`` bytes; a null text is an empty one."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield _part(batch, texts, start, row)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield _part(batch, texts, start, batch.num_rows)


def _part(batch, texts, start: int, end: int):
    raw = texts.slice(start, end - start)
    raw = raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary())
    return batch.slice(start, end - start), [x if x is not None else b"" for x in raw.to_pylist()]


def map_slices(df: DataFrame, work: Callable, schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``work(rows, texts) -> dict of columns`` to bounded slices of every partition.

    ``rows`` is the record batch, ``texts`` its texts as bytes.  The columns
    returned are the table of ``schema``.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    names = target.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches):
        for rows, texts in slices(batches, column, limit):
            made = work(rows, texts)
            yield pa.RecordBatch.from_arrays([pa.array(made[n], type=arrow.field(n).type) if not isinstance(made[n], pa.Array) else made[n].cast(arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, target)
