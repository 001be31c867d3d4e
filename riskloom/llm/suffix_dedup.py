"""Suffix-array deduplication of repeated stretches across documents.

A byte goes if a stretch of ``SPAN`` bytes over it also starts in a document
with a smaller doc_id.  Every such stretch contains an anchor: a gram of
``GRAM`` bytes whose hash is the smallest of the stretch.  Equal stretches have
equal anchors at equal places, so only suffixes around anchors need sorting.

Three questions go from the blocks of texts to the buckets of anchors:

1. which anchors stand in other documents, too;
2. for these, with the hash of the anchor's whole surroundings: is there an
   earlier document with the same surroundings (then all stretches over the
   anchor go), and are there other surroundings of the same anchor;
3. for these, with the bytes of the surroundings: the suffixes that start
   before the anchor are sorted by a hash of their stretch, which is checked on
   the bytes, and a stretch goes where its run of equal suffixes has an earlier
   document.

Surroundings are sent once per block and question, so a passage that a third of
all documents share stays as small as its distinct surroundings.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import exchange
from riskloom.llm.suffix_sort import PrefixHashes, gather_equal

SPAN = 50
GRAM = 26
WINDOW = SPAN - GRAM + 1  # grams in a stretch
LEFT, RIGHT = SPAN - GRAM, SPAN  # bytes of surroundings before and from the anchor on
AROUND = LEFT + RIGHT
#: A document without an id counts as later than all others.
NO_ID = np.iinfo(np.int64).max


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the gram at every place."""
    with np.errstate(over="ignore"):
        part, power, size = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1), 1
        parts = {1: (part, power)}
        while size * 2 <= GRAM:
            part = part[:-size] * power + part[size:]
            power, size = power * power, size * 2
            parts[size] = (part, power)
        count, at, whole = len(data) - GRAM + 1, 0, None
        for size in sorted(parts, reverse=True):
            if GRAM - at >= size:
                part, power = parts[size]
                piece = part[at : at + count]
                whole = piece.copy() if whole is None else whole * power + piece
                at += size
        whole ^= whole >> np.uint32(15)
        whole *= np.uint32(0x2C1B3C6D)
        whole ^= whole >> np.uint32(12)
    return whole


def _sliding(values: np.ndarray, size: int, choose) -> np.ndarray:
    done = 1
    while done * 2 <= size:
        values = choose(values[:-done], values[done:])
        done *= 2
    rest = size - done
    return choose(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray) -> np.ndarray:
    """Places of the grams whose hash is the smallest of some stretch around them; all of equal ones."""
    if len(data) < SPAN:
        return np.zeros(0, np.int64)
    hashes = _gram_hashes(data)
    lowest = _sliding(hashes, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint32)
    reached = _sliding(np.concatenate([pad, lowest, pad]), WINDOW, np.maximum)
    # A gram is lowest somewhere where the largest of the minima over its windows is its own hash.
    return np.flatnonzero(reached == hashes)


def _mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of 64-bit words."""
    with np.errstate(over="ignore"):
        made = np.full(len(words), 0x243F6A8885A308D3, np.uint64)
        for k in range(words.shape[1]):
            made = (made ^ words[:, k]) * np.uint64(0x9FB21C651E98DF25)
            made ^= made >> np.uint64(32)
        made *= np.uint64(0xD6E8FEB86659FD93)
        return made ^ (made >> np.uint64(29))


def _hash_rows(grid: np.ndarray) -> np.ndarray:
    width = -(-grid.shape[1] // 8) * 8
    padded = np.zeros((len(grid), width), np.uint8)
    padded[:, : grid.shape[1]] = grid
    return _mixed(padded.view("<u8"))


class Block:
    """The anchors of a block's documents, with equal texts taken once."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = np.array([i if i is not None else NO_ID for i in ids], np.int64)
        size = sum(len(t) for t in texts) + (LEFT + RIGHT) * (len(texts) + 1)
        # Documents stand apart by more zeros than any surroundings reach.
        self.data = np.zeros(size, np.uint8)
        self.starts = np.zeros(len(texts), np.int64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        places, owners, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], LEFT + RIGHT
        for row, text in enumerate(texts):
            raw = np.frombuffer(text, np.uint8)
            self.data[at : at + len(raw)] = raw
            self.starts[row] = at
            found = anchors(raw)
            places.append(found + at)
            owners.append(np.full(len(found), row))
            at += len(raw) + LEFT + RIGHT
        self.places, self.owners = np.concatenate(places), np.concatenate(owners)

    def grams(self, which: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.data, GRAM)
        return _in_parts(which, lambda part: _hash_rows(view[self.places[part]]), np.uint64)

    def room(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the document before the anchor, and from it on, as far as the surroundings reach."""
        begin = self.starts[self.owners[which]]
        before = np.minimum(self.places[which] - begin, LEFT)
        after = np.minimum(begin + self.sizes[self.owners[which]] - self.places[which], RIGHT)
        return before, after

    def around(self, which: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.data, AROUND)
        return view[self.places[which] - LEFT]

    def surroundings(self, which: np.ndarray) -> np.ndarray:
        """A hash of the surroundings and of where the document ends in them."""

        def made(part):
            before, after = self.room(part)
            grid = np.concatenate([self.around(part), before[:, None].astype(np.uint8), after[:, None].astype(np.uint8)], axis=1)
            return _hash_rows(grid)

        return _in_parts(which, made, np.uint64)


def _in_parts(which: np.ndarray, made, kind, size: int = 1 << 17) -> np.ndarray:
    parts = [made(which[at : at + size]) for at in range(0, len(which), size)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that gathers keys by bucket, and where each bucket begins in it."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


# Question 1: anchors of other documents.


def _six(keys: np.ndarray) -> np.ndarray:
    """The upper 48 bits of the keys, as bytes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:])


def _first_keys(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash of each anchor, distinct hashes, inverse, whether several of the block's documents have it)."""
    every = np.arange(len(block.places))
    grams = block.grams(every)
    distinct, inverse = np.unique(grams, return_inverse=True)
    low, high = np.full(len(distinct), len(block.ids)), np.full(len(distinct), -1)
    np.minimum.at(low, inverse, block.owners)
    np.maximum.at(high, inverse, block.owners)
    return grams, distinct, inverse, low < high


def _ask_first(buckets: int):
    def work(ids, texts, _):
        _, distinct, _, several = _first_keys(Block(ids, texts))
        order, cuts = _by_bucket(distinct >> np.uint64(16), buckets)
        six, flags = _six(distinct[order]), several[order]
        return {b: cuts_bytes(cuts, b) + six[cuts[b] : cuts[b + 1]].tobytes() + np.packbits(flags[cuts[b] : cuts[b + 1]]).tobytes() for b in range(buckets) if cuts[b] < cuts[b + 1]}

    return work


def cuts_bytes(cuts: np.ndarray, bucket: int) -> bytes:
    return int(cuts[bucket + 1] - cuts[bucket]).to_bytes(4, "little")


def _answer_first(asked: dict[int, bytes]) -> dict[int, bytes]:
    keys, flags, counts = [], [], []
    for data in asked.values():
        n = int.from_bytes(data[:4], "little")
        grid = np.zeros((n, 8), np.uint8)
        grid[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 4).reshape(n, 6)
        keys.append(grid.view("<u8").ravel())
        flags.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + 6 * n), count=n).astype(bool))
        counts.append(n)
    every, several = np.concatenate(keys), np.concatenate(flags)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    twice = np.zeros(len(every), bool)
    same = ordered[1:] == ordered[:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    shared = twice | several
    cuts = np.concatenate([[0], np.cumsum(counts)])
    return {block: np.packbits(shared[cuts[i] : cuts[i + 1]]).tobytes() for i, block in enumerate(asked)}


def _told_first(block: Block, answers: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that other documents share, and their gram hashes."""
    grams, distinct, inverse, _ = _first_keys(block)
    order, cuts = _by_bucket(distinct >> np.uint64(16), buckets)
    shared = np.zeros(len(distinct), bool)
    for b, data in answers.items():
        if b >= 0:
            part = order[cuts[b] : cuts[b + 1]]
            shared[part] = np.unpackbits(np.frombuffer(data, np.uint8), count=len(part)).astype(bool)
    which = np.flatnonzero(shared[inverse])
    return which, grams[which]


# Question 2: equal surroundings in earlier documents.

_SECOND = np.dtype([("gram", "<u8"), ("around", "<u8"), ("doc", "<i8")])


def _second_keys(block: Block, which: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct (gram, surroundings) with their first document, inverse, an anchor in that document)."""
    around, docs = block.surroundings(which), block.ids[block.owners[which]]
    order = np.lexsort((docs, around, grams))
    new = np.ones(len(order), bool)
    new[1:] = (grams[order][1:] != grams[order][:-1]) | (around[order][1:] != around[order][:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    head = order[new]
    keys = np.zeros(len(head), _SECOND)
    keys["gram"], keys["around"], keys["doc"] = grams[head], around[head], docs[head]
    return keys, inverse, head


def _chosen(which: np.ndarray, total: int) -> bytes:
    flags = np.zeros(total, bool)
    flags[which] = True
    return np.packbits(flags).tobytes()


def _ask_second(buckets: int):
    def work(ids, texts, answers):
        block = Block(ids, texts)
        which, grams = _told_first(block, answers, buckets)
        keys, _, _ = _second_keys(block, which, grams)
        order, cuts = _by_bucket(keys["gram"], buckets)
        asked = {b: keys[order[cuts[b] : cuts[b + 1]]].tobytes() for b in range(buckets) if cuts[b] < cuts[b + 1]}
        return asked | {-1: _chosen(which, len(block.places))}

    return work


def _answer_second(asked: dict[int, bytes]) -> dict[int, bytes]:
    """Per key: bit 0, an earlier document has the same surroundings; bit 1, the anchor has other surroundings, too."""
    parts = [np.frombuffer(data, _SECOND) for data in asked.values()]
    keys = np.concatenate(parts)
    order = np.lexsort((keys["doc"], keys["around"], keys["gram"]))
    ordered = keys[order]
    new_gram = np.concatenate([[True], ordered["gram"][1:] != ordered["gram"][:-1]])
    new = new_gram | np.concatenate([[True], ordered["around"][1:] != ordered["around"][:-1]])
    heads = np.flatnonzero(new)
    first = np.repeat(ordered["doc"][heads], np.diff(np.append(heads, len(keys))))
    grams = np.flatnonzero(new_gram)
    kinds = np.add.reduceat(new.astype(np.int64), grams)
    several = np.repeat(kinds > 1, np.diff(np.append(grams, len(keys))))
    status = np.zeros(len(keys), np.uint8)
    status[order] = (first < ordered["doc"]).astype(np.uint8) + 2 * several.astype(np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return {block: status[cuts[i] : cuts[i + 1]].tobytes() for i, block in enumerate(asked)}


class Told:
    """A block's anchors after the second answer."""

    def __init__(self, block: Block, answers: dict[int, bytes], buckets: int):
        note = next(data for b, data in answers.items() if b < 0)
        self.which = np.flatnonzero(np.unpackbits(np.frombuffer(note, np.uint8), count=len(block.places)))
        self.grams = block.grams(self.which)
        self.keys, self.inverse, self.head = _second_keys(block, self.which, self.grams)
        order, cuts = _by_bucket(self.keys["gram"], buckets)
        self.status = np.zeros(len(self.keys), np.uint8)
        for b, data in answers.items():
            if b >= 0:
                self.status[order[cuts[b] : cuts[b + 1]]] = np.frombuffer(data, np.uint8)
        docs = block.ids[block.owners[self.which]]
        # All stretches over these anchors go.
        self.whole = (self.status[self.inverse] & 1 > 0) | (docs > self.keys["doc"][self.inverse])
        # These surroundings are the first of their kind and have rivals.
        self.open = np.flatnonzero(self.status == 2)


# Question 3: sorted suffixes of rival surroundings.

_THIRD = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("before", "u1"), ("after", "u1"), ("bytes", "u1", (AROUND,))])


def _ask_third(buckets: int):
    def work(ids, texts, answers):
        block = Block(ids, texts)
        told = Told(block, answers, buckets)
        head = told.which[told.head[told.open]]
        keys = np.zeros(len(head), _THIRD)
        keys["gram"], keys["doc"] = told.keys["gram"][told.open], told.keys["doc"][told.open]
        keys["before"], keys["after"] = block.room(head)
        keys["bytes"] = block.around(head)
        order, cuts = _by_bucket(keys["gram"], buckets)
        asked = {b: keys[order[cuts[b] : cuts[b + 1]]].tobytes() for b in range(buckets) if cuts[b] < cuts[b + 1]}
        rival = ~told.whole & (told.status[told.inverse] == 2)
        left, row = told.which[rival], np.searchsorted(told.open, told.inverse[rival])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # The note: anchors that go whole, then (place, question) of the open ones.
        pairs = np.stack([block.places[left], place[row]], axis=1).astype("<i8").tobytes()
        starts = cuts.astype("<i8").tobytes()
        places = block.places[told.which[told.whole]].astype("<i8").tobytes()
        return asked | {-1: len(places).to_bytes(8, "little") + len(pairs).to_bytes(8, "little") + places + pairs + starts}

    return work


def sorted_masks(keys: np.ndarray) -> np.ndarray:
    """For each surroundings, a bit per offset: the stretch from there on has an equal one in an earlier document."""
    masks = np.zeros(len(keys), "<u4")
    step = 1 << 14
    ranked = np.argsort(keys["gram"], kind="stable")
    grams = keys["gram"][ranked]
    heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(keys) else np.zeros(0, np.int64)
    # Whole groups of an anchor are sorted together, several groups at a time.
    begin = 0
    ends = np.append(heads[1:], len(keys))
    while begin < len(heads):
        end = begin + 1
        while end < len(heads) and ends[end] - heads[begin] <= step:
            end += 1
        part = ranked[heads[begin] : ends[end - 1]]
        masks[part] = _masks_of(keys[part])
        begin = end
    return masks


def _masks_of(keys: np.ndarray) -> np.ndarray:
    hashes = PrefixHashes(np.ascontiguousarray(keys["bytes"]).ravel())
    group = np.cumsum(np.concatenate([[0], keys["gram"][1:] != keys["gram"][:-1]]))
    offset = np.arange(WINDOW)
    row, at = np.nonzero((offset >= LEFT - keys["before"][:, None]) & (offset + SPAN <= LEFT + keys["after"][:, None].astype(np.int64)))
    segment = group[row] * WINDOW + at
    by_segment = np.lexsort((keys["doc"][row], segment))
    row, at, segment = row[by_segment], at[by_segment], segment[by_segment]
    starts = row * AROUND + at
    order, runs = gather_equal(hashes, starts, segment, SPAN)
    docs = keys["doc"][row[order]]
    # Equal suffixes keep their order, so a run begins with its earliest document.
    heads = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, np.int64)
    first = np.repeat(docs[heads], np.diff(np.append(heads, len(runs))))
    gone = order[first < docs]
    masks = np.zeros(len(keys), "<u4")
    np.bitwise_or.at(masks, row[gone], np.uint32(1) << at[gone].astype(np.uint32))
    return masks


def _answer_third(asked: dict[int, bytes]) -> dict[int, bytes]:
    parts = [np.frombuffer(data, _THIRD) for data in asked.values()]
    masks = sorted_masks(np.concatenate(parts))
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return {block: masks[cuts[i] : cuts[i + 1]].tobytes() for i, block in enumerate(asked)}


def _gone(ids: list, texts: list[bytes], answers: dict[int, bytes]) -> list[np.ndarray]:
    """The removed bytes of each document, as flags."""
    note = next(data for b, data in answers.items() if b < 0)
    whole, pairs = int.from_bytes(note[:8], "little"), int.from_bytes(note[8:16], "little")
    sure = np.frombuffer(note, "<i8", whole // 8, 16)
    asked = np.frombuffer(note, "<i8", pairs // 8, 16 + whole).reshape(-1, 2)
    cuts = np.frombuffer(note, "<i8", offset=16 + whole + pairs)
    masks = np.zeros(int(cuts[-1]) if len(cuts) else 0, np.uint32)
    for b, data in answers.items():
        if b >= 0:
            masks[cuts[b] : cuts[b + 1]] = np.frombuffer(data, "<u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.concatenate([[LEFT + RIGHT], sizes[:-1] + LEFT + RIGHT])) if len(sizes) else np.zeros(0, np.int64)
    change = np.zeros(int(sizes.sum()) + (LEFT + RIGHT) * (len(sizes) + 2) + 1, np.int64)
    if len(sizes):
        owner = np.searchsorted(starts, sure, "right") - 1
        np.add.at(change, np.maximum(sure - LEFT, starts[owner]), 1)
        np.add.at(change, np.minimum(sure + RIGHT, starts[owner] + sizes[owner]), -1)
        mask = masks[asked[:, 1]] if len(asked) else np.zeros(0, np.uint32)
        for offset in range(WINDOW):
            at = asked[(mask >> np.uint32(offset)) & np.uint32(1) > 0, 0] - LEFT + offset
            np.add.at(change, at, 1)
            np.add.at(change, at + SPAN, -1)
    flags = np.cumsum(change) > 0
    return [flags[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist())]


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _with_gone(docs: DataFrame, carry: tuple[str, ...], work, schema: str, block_bytes: int) -> DataFrame:
    texts, buckets = exchange.dealt(docs, *carry, block_bytes=block_bytes)
    shared = exchange.answer(exchange.ask(texts, _ask_first(buckets)), _answer_first)
    around = exchange.answer(exchange.ask(texts, _ask_second(buckets), shared), _answer_second)
    sorted_ = exchange.answer(exchange.ask(texts, _ask_third(buckets), around), _answer_third)
    return exchange.finish(texts, sorted_, work, schema)


def repeated_bytes(docs: DataFrame, *, block_bytes: int = exchange.BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the digest of the bytes that stay.

    A null or empty text has no bytes.  Rows with the same doc_id do not remove
    each other's bytes; a row without an id counts as later than all others.
    Other columns are ignored.
    """

    def work(ids, texts, answers, table):
        flags = _gone(ids, texts, answers)
        return {
            "doc_id": table.column("doc_id"),
            "n_bytes": [len(t) for t in texts],
            "n_removed": [int(f.sum()) for f in flags],
            "n_spans": [int((f[1:] & ~f[:-1]).sum() + f[:1].sum()) for f in flags],
            "kept_sha256": [hashlib.sha256(np.frombuffer(t, np.uint8)[~f].tobytes()).hexdigest() for t, f in zip(texts, flags)],
        }

    return _with_gone(docs.select("doc_id", "text"), (), work, f"doc_id bigint, {RESULT}", block_bytes)


def without_repeats(docs: DataFrame, *, block_bytes: int = exchange.BLOCK_BYTES) -> DataFrame:
    """``docs`` with the repeated stretches cut out of ``text``; all rows stay, n_chars follows the text.

    What a cut leaves of a multi-byte character goes with it.  A null text stays null.
    """
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    renamed = docs.select("doc_id", "text", *[docs[c].alias(n) for c, n in names.items()])

    def work(ids, texts, answers, table):
        flags = _gone(ids, texts, answers)
        kept = [np.frombuffer(t, np.uint8)[~f].tobytes().decode(errors="ignore") if f.any() else t.decode() for t, f in zip(texts, flags)]
        nulls = table.column("text").is_null().to_pylist()
        made = {"doc_id": table.column("doc_id"), "text": [None if n else k for n, k in zip(nulls, kept)]}
        return made | {n: table.column(n) for n in names.values()}

    shape = renamed.schema.simpleString()[len("struct<") : -1]
    cut = _with_gone(renamed, tuple(names.values()), work, shape, block_bytes)
    back = cut.select(*[(F.col(c) if c in ("doc_id", "text") else F.col(names[c])).alias(c) for c in docs.columns])
    return back.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else back
