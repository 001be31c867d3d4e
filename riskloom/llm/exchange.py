"""Questions from blocks of texts to buckets of keys, and answers back.

Some operators must know, for the keys of a text, what the whole corpus has at
these keys.  Documents are dealt into blocks of bounded bytes.  A block packs its
distinct keys into one binary value per bucket of the key space, buckets answer
every block in the order it asked, and blocks meet the answers again with their
texts.  A block sends a key once however often it holds it, so hot keys stay
small, and rows stay few.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes of a block.
BLOCK_BYTES = 12 << 20
PACKET = "block int, bucket int, data binary"
_PACKET_ARROW = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])


def dealt(docs: DataFrame, *carry: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, doc_id, carry columns, text) and the number of blocks; equal or hot ids are spread by their text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.select(block.alias("block"), "doc_id", *carry, "text"), blocks


def _in_order(table: pa.Table) -> tuple[pa.Table, list, list[bytes]]:
    """A block's rows by doc_id and text, their ids and texts: every pass must number them alike, and a shuffle does not."""
    ids = table.column("doc_id").to_pylist()
    texts = [x if x is not None else b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, texts[i]))
    return table.take(order), [ids[i] for i in order], [texts[i] for i in order]


def _packets(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=_PACKET_ARROW)


def _received(table: pa.Table, key: str) -> dict[int, bytes]:
    return dict(zip(table.column(key).to_pylist(), table.column("data").to_pylist()))


def ask(texts: DataFrame, work: Callable, answers: DataFrame | None = None) -> DataFrame:
    """``work(doc_ids, texts, answers by bucket) -> data by bucket`` for every block.

    Data for a negative bucket are a note that the block gets back unchanged.
    """

    def first(key, table):
        block = key[0].as_py()
        asked = work(*_in_order(table)[1:], {})
        return _packets([(block, bucket, data) for bucket, data in asked.items()])

    def again(key, table, answer):
        block = key[0].as_py()
        asked = work(*_in_order(table)[1:], _received(answer, "bucket"))
        return _packets([(block, bucket, data) for bucket, data in asked.items()])

    if answers is None:
        return texts.groupBy("block").applyInArrow(first, PACKET)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(again, PACKET)


def answer(asked: DataFrame, work: Callable) -> DataFrame:
    """``work(data by block) -> data by block`` for every bucket; notes are passed on."""

    def one(key, table):
        bucket = key[0].as_py()
        if bucket < 0:
            return table.select(["block", "bucket", "data"])
        told = work(_received(table, "block"))
        return _packets([(block, bucket, data) for block, data in told.items()])

    # A note goes back through the bucket of its block, so that notes are spread as well.
    noted = asked.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.col("block")).otherwise(F.col("bucket")))
    return noted.groupBy("bucket").applyInArrow(one, PACKET)


def finish(texts: DataFrame, answers: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(doc_ids, texts, answers by bucket, table) -> columns`` for every block."""
    target = texts.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(target)

    def last(_, table, answer):
        table, ids, texts = _in_order(table)
        made = work(ids, texts, _received(answer, "bucket"), table)
        arrays = [made[f.name] if isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(made[f.name], f.type) for f in arrow]
        return pa.table([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(last, target)
