"""Sequence packing by the sum-of-squares rule.

A document's ids are cut into pieces of at most ``capacity``.  Each piece goes
to the open sequence, or a new one, that leaves the squared counts of open
sequences per residual gap smallest.  Pieces are dealt into blocks of bounded
size, and every block is packed on its own: it leaves a sequence or two open.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import map_slices
from riskloom.llm.token_ids import encoder
from riskloom.session import stage

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs at a time.
BLOCK_PIECES = 50_000
#: One piece in so many, the smallest ones, is packed last.
LAST_SHARE = 10

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the crc32 of its ids.

    A null or empty text is the end id alone.  Equal rows give equal pieces.
    """
    end = int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def work(rows, texts):
        owner, piece, start, length, crc = [], [], [], [], []
        for doc, ids in zip(rows.column(0).to_pylist(), encoder(tokenizer).encode_texts(texts, end)):
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                owner.append(doc)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return {"doc_id": pa.array(owner, rows.column(0).type), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), work, f"doc_id {kind}, {PIECES}")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, taken in the given order.

    Of equal choices the fullest open sequence is taken, and a new one last.
    """
    counts = np.zeros(capacity + 1, np.int64)  # open sequences per gap; 0 and capacity are never counted
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    far = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        gain = far
        if size < capacity:
            now = counts[size:capacity]
            # Moving a sequence from gap g to g - size changes the sum by 2 (N[g-size] - N[g] + 1); to gap 0 by 1 - 2 N[g].
            change = np.where(now > 0, 2 * (counts[: capacity - size] - now + 1), far)
            if now[0] > 0:
                change[0] = 1 - 2 * now[0]
            best = int(np.argmin(change))
            gain = change[best]
        fresh = 2 * counts[capacity - size] + 1 if size < capacity else 0
        if gain <= fresh:
            gap = best + size
            at = open_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, at = capacity, made
            made += 1
        sequence[i], offset[i] = at, capacity - gap
        left = gap - size
        if left:
            counts[left] += 1
            open_by_gap[left].append(at)
    return sequence, offset


def _pack_block(block: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The larger pieces in hash order, as the rule wants a mixed stream; the smallest tenth fills the gaps at the end."""
    block = block.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
    large = len(block) - len(block) // LAST_SHARE
    mixed = np.argsort((block["ids_crc32"].to_numpy().astype(np.uint64)[:large] * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF), kind="stable")
    block = block.iloc[np.concatenate([mixed, np.arange(large, len(block))])]
    sequence, offset = sum_of_squares(block["length"].to_numpy(), capacity)
    return block.assign(bin=sequence, offset=offset)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset; every piece once, offsets of a sequence gapless from 0.

    ``pieces`` must be a written table (it is read twice) with lengths from 1 to
    ``capacity``.
    """
    total = pieces.count()
    blocks = max(1, -(-total // block_pieces))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("bigint"))
    shape = dealt.schema.simpleString()[len("struct<") : -1]
    packed = dealt.groupBy("block").applyInPandas(lambda b: _pack_block(b, capacity), f"{shape}, bin bigint, offset bigint")
    return packed.select(*pieces.columns, (F.col("block") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Cut every document into pieces and pack them: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stage(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity, block_pieces=block_pieces)
