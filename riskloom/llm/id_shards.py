"""Binary token-id shards with a minimal perfect hash index.

A shard file holds the raw ids of a range of documents in ascending doc_id
order, and an index that maps a document key to its row in constant time: a
key's slot comes from levels of bit arrays (a key that is alone at its place of
a level sets the bit; the others go on to the next level) and the rank of that
bit; the slot stores a fingerprint of the key and the row.

Layout, all little-endian: magic, payload, then the arrays of the index, then a
JSON directory of the arrays, its size (8 bytes) and the magic again.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.text import slices
from riskloom.llm.token_ids import encoder, vocabulary_size
from riskloom.session import stage

MAGIC = b"RLIDSH01"
END_ID = 1
#: Text bytes that a shard gets.
SHARD_BYTES = 16 << 20
LEVELS = 64


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Slots 0 to n-1 for n distinct 64-bit keys."""

    sizes: np.ndarray  # bits of each level
    words: np.ndarray  # the levels' bits, each level from a new 64-bit word on
    ranks: np.ndarray  # set bits before each word

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, levels = [], []
        left = keys.astype(np.uint64)
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys must be distinct")
            size = max(64, 2 * len(left))
            at = mixed(left, len(sizes)) % np.uint64(size)
            places, first, counts = np.unique(at, return_inverse=True, return_counts=True)
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[places[counts == 1].astype(np.int64)] = 1
            sizes.append(size)
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[counts[first] > 1]
        words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]) if len(words) else np.zeros(0)
        return cls(np.array(sizes, "<u8"), words, ranks.astype("<u4"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level knows it.  A foreign key may get a slot: compare fingerprints."""
        found = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = mixed(keys[open_], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + base, at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) > 0
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[open_[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
            base += -(-size // 64)
        return found


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def index_arrays(keys: list[int | None], bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The index of a shard's documents; of rows with the same key the first is found."""
    nulls = np.array([k is None for k in keys], np.uint8)
    rows = np.array([k if k is not None else 0 for k in keys], "<i8")
    distinct, first = np.unique(rows[nulls == 0], return_index=True)
    at_row = np.flatnonzero(nulls == 0)[first]
    unsigned = distinct.view(np.uint64)
    perfect = PerfectHash.build(unsigned)
    slots = perfect.slots(unsigned)
    marks, places = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    marks[slots], places[slots] = fingerprint(unsigned), at_row
    return {
        "keys": rows, "nulls": nulls, "bounds": bounds.astype("<u8"), "sizes": perfect.sizes, "words": perfect.words,
        "ranks": perfect.ranks, "fingerprints": marks, "rows": places,
    }


class ShardReader:
    """Keyed and ordered access to one shard file."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no id shard")
        told = int.from_bytes(tail[:8], "little")
        self.directory = json.loads(self.file.read_at(told, size - 16 - told))
        self.width = self.directory["width"]
        self.arrays = {n: np.frombuffer(self.file.read_at(b, a), t) for n, (t, a, b) in self.directory["arrays"].items()}
        self.perfect = PerfectHash(*[self.arrays[n] for n in ("sizes", "words", "ranks")])

    def close(self) -> None:
        self.file.close()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where the fingerprint says that it is not here."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slots = self.perfect.slots(keys)
        known = slots >= 0
        known[known] = self.arrays["fingerprints"][slots[known]] == fingerprint(keys[known])
        rows = np.full(len(keys), -1, np.int64)
        rows[known] = self.arrays["rows"][slots[known]]
        return rows

    def ids(self, row: int) -> np.ndarray:
        start, end = self.arrays["bounds"][row : row + 2].tolist()
        raw = self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        row = int(self.find(np.array([key]))[0])
        return self.ids(row) if row >= 0 else None


MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text and write the shards below ``folder``; the written manifest is returned.

    Documents are dealt by ranges of doc_id, nulls first; a null or empty text is
    the end id alone.  ``folder`` must be one that all executors share.  A file's
    name holds the task attempt, and the manifest names the attempt that counts,
    so a repeated task leaves the result right.
    """
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    dealt = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    end = int(end_id).to_bytes(4, "little")

    def write(batches):
        task = TaskContext.get()
        shard, keys, sizes, out, path = task.partitionId(), [], [0], None, ""
        for rows, texts in slices(batches):
            if out is None:
                path = f"{folder}/shard-{shard:06d}-{task.taskAttemptId()}.ids"
                system, place = fs.FileSystem.from_uri(path)
                system.create_dir(place.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(place)
                out.write(MAGIC)
            for key, ids in zip(rows.column(0).to_pylist(), encoder(tokenizer).encode_texts(texts, end)):
                keys.append(key)
                sizes.append(len(ids) // 4)
                out.write(np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() if width < 4 else ids)
        if out is None:
            return
        bounds = np.cumsum(np.array(sizes, np.int64))
        directory, at = {}, len(MAGIC) + int(bounds[-1]) * width
        for name, values in index_arrays(keys, bounds).items():
            raw = values.tobytes()
            out.write(raw)
            directory[name] = (values.dtype.str, at, len(raw))
            at += len(raw)
        told = json.dumps({"width": width, "arrays": directory}).encode()
        out.write(told + len(told).to_bytes(8, "little") + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([int(bounds[-1])], pa.int64())}
        )

    return stage(dealt.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it.  Rows are found through
    the index by their key; rows that share a key, or have none, by their place.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint").alias("base"))
    width = max(1, manifest.count())

    def work(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(path)
                keys, nulls = shard.arrays["keys"], shard.arrays["nulls"]
                rows = shard.find(keys)
                own = np.arange(len(keys))
                if ((rows != own) & (nulls == 0) & (keys[np.maximum(rows, 0)] != keys)).any():
                    raise ValueError(f"{path}: the index does not find its own keys")
                bounds = shard.arrays["bounds"].astype(np.int64)
                crc = [zlib.crc32(shard.ids(row).tobytes()) for row in own.tolist()]
                shard.close()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([None if n else k for k, n in zip(keys.tolist(), nulls.tolist())], pa.int64()),
                        "start": pa.array(bounds[:-1] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    return placed.repartition(width, "path").mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
