"""Benchmark decontamination with suffix arrays over training shards.

A shard is a bounded slice of a partition's documents.  Its word suffixes are
sorted once; every test suffix of the benchmark is binary-searched in that
order, which gives its longest verbatim match and the range of all places where
a whole window stands.  A document lies in one shard, so nothing is shuffled.
The benchmark is the stated query set; it is searched in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import map_slices, plain_words, set_aside

WINDOW = 10
#: Benchmark bytes in a block: one block at a time is sent to the tasks.
BLOCK_BYTES = 4 << 20


class TestSuffixes:
    """The windows of a block of benchmark items, ready to be searched for."""

    __test__ = False

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.window, self.ids, owners = window, {}, {}
        for item, text in items:
            words = plain_words(text)
            if not words:
                continue
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            span = min(window, len(codes))
            for at in range(len(codes) - span + 1):
                owners.setdefault(tuple(codes[at : at + span]), set()).add(str(item))
        self.windows = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.spans = np.array([len(w) for w in self.windows], np.int64)
        grid = np.zeros((len(self.windows), window), ">u4")
        for row, codes in enumerate(self.windows):
            grid[row, : len(codes)] = codes
        self.low = _keys(grid)
        high = grid.copy()
        for row, codes in enumerate(self.windows):
            high[row, len(codes) :] = 0xFFFFFFFF
        self.high = _keys(high)
        first = grid[:, 0].astype(np.int64)
        second = grid[:, 1].astype(np.int64) if window > 1 else np.zeros(len(grid), np.int64)
        self.pairs = np.unique(first[self.spans > 1] * (len(self.ids) + 1) + second[self.spans > 1])
        self.singles = np.unique(first[self.spans == 1])


def _keys(grid: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(grid).view(f"S{grid.shape[1] * 4}").ravel()


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def search_shard(texts: list[bytes], tests: TestSuffixes) -> tuple[list[int], list[np.ndarray], list[set[str]], np.ndarray]:
    """(words, hit word positions, items) of each document, and each window's longest match in words.

    Only suffixes that begin with the first two words of a window can hold one;
    the shard's suffix array is built over these.
    """
    span, base = tests.window, len(tests.ids) + 1
    lengths, parts, get = [], [], tests.ids.get
    for text in texts:
        words = plain_words(text)
        lengths.append(len(words))
        parts.append(np.array([get(w, 0) for w in words], np.int64))
        parts.append(np.zeros(span, np.int64))
    stream = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + span)])
    longest = np.zeros(len(tests.windows), np.int64)
    hits: list[list[np.ndarray]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if len(tests.windows) and len(stream) > span:
        heads, nexts = stream[:-span], stream[1 : len(stream) - span + 1]
        places = np.flatnonzero(heads)
        places = places[_member(heads[places] * base + nexts[places], tests.pairs) | _member(heads[places], tests.singles)]
        if len(places):
            grid = stream[places[:, None] + np.arange(span)].astype(">u4")
            keys = _keys(grid)
            order = np.argsort(keys, kind="stable")
            suffixes = keys[order]
            left = np.searchsorted(suffixes, tests.low, "left")
            right = np.searchsorted(suffixes, tests.high, "right")
            wanted = tests.low.view(">u4").reshape(-1, span)
            for near in (np.maximum(left - 1, 0), np.minimum(left, len(order) - 1)):
                same = (grid[order[near]] == wanted) & (wanted > 0)
                longest = np.maximum(longest, np.where(same.all(1), span, np.argmin(same, 1)))
            longest = np.minimum(longest, tests.spans)
            for w in np.flatnonzero(right > left):
                found = places[order[left[w] : right[w]]]
                docs = np.searchsorted(starts, found, "right") - 1
                for doc, at in zip(docs.tolist(), (found - starts[docs]).tolist()):
                    hits[doc].append(np.arange(at, at + tests.spans[w]))
                    items[doc].update(tests.owners[w])
    return lengths, [np.unique(np.concatenate(h)) if h else np.zeros(0, np.int64) for h in hits], items, longest


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's items in blocks, one at a time; a block holds at most ``block_bytes`` and one item more."""
    block: list[tuple[object, bytes]] = []
    held = 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        text = row["text"].encode()
        if held + len(text) > block_bytes and block:
            yield block
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text)
    yield block


MATCH_SCHEMA = "n_words bigint, hit_words array<bigint>, items array<string>"


def find_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: its words, the positions of its hit words, and the items with occurring windows.

    ``carry`` columns and ``text`` come along, so a filter needs no join.  A null
    or empty text has no words and no hit; an item with a null id or text is
    left out; an item of fewer than ``window`` words is one window.  Equal rows
    are judged one by one.  Further columns of either table are ignored.
    """
    spark = docs.sparkSession
    found = docs.select(*carry, "text", F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<bigint>)").alias("hit_words"), F.expr("cast(array() as array<string>)").alias("items"))
    for block in _blocks(benchmark, block_bytes):
        held = spark.sparkContext.broadcast(block)
        ready: dict[str, TestSuffixes] = {}

        def work(rows, texts, held=held, ready=ready):
            if "tests" not in ready:
                ready["tests"] = TestSuffixes(held.value, window)
            lengths, hits, items, _ = search_shard(texts, ready["tests"])
            before = rows.column(rows.schema.get_field_index("hit_words")).to_pylist()
            known = rows.column(rows.schema.get_field_index("items")).to_pylist()
            made = {name: rows.column(rows.schema.get_field_index(name)) for name in (*carry, "text")}
            return made | {
                "n_words": pa.array(lengths, pa.int64()),
                "hit_words": [sorted({*old, *new.tolist()}) if old else new.tolist() for old, new in zip(before, hits)],
                "items": [sorted({*old, *new}) for old, new in zip(known, items)],
            }

        found = map_slices(found, work, found.schema.simpleString()[len("struct<") : -1])
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    return find_matches(docs, benchmark, window=window).select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; columns as they were."""
    renamed = set_aside(docs)
    found = find_matches(renamed, benchmark, window=window, carry=tuple(c for c in renamed.columns if c != "text"))
    return found.where(F.size("hit_words") == 0).select(*renamed.columns).toDF(*docs.columns)


def items_digest(items: list[object]) -> str:
    """The digest of a set of item ids, as the query gives it."""
    return hashlib.sha256(",".join(sorted({str(i) for i in items})).encode()).hexdigest()
