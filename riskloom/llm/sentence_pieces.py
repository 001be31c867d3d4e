"""SentencePiece encoding by a score-ordered agenda of adjacent symbol pairs, checked against the library.

A text's blanks become the vocabulary's blank sign, one more stands in front.
Every adjacent pair of symbols whose joined text is a piece waits in an agenda,
the best score first, the leftmost among equals; the best pair is joined and its
new neighbours are entered, until the agenda is empty.  Symbols that are no piece fall
back to their bytes.

Characters that stand next to each other in some piece are of one family; joins
never leave a family, except that blanks join what follows them.  So a text is
cut into runs of one family with the blanks before them, and a worker remembers
the ids of runs that it has met, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from riskloom.llm.text import map_slices, set_aside

#: Runs a worker remembers in each of two generations; the older one goes when the younger is full.
REMEMBERED = 600_000
#: Longer runs are encoded each time, with a heap for their agenda.
LONG_RUN = 64
NEVER = float("inf")
#: Text bytes that a task encodes at a time; their ids take many times that.
SLICE_BYTES = 1 << 20
#: The vocabulary's blank sign; a blank stands for it in here.
SIGN = "▁"

_loaded: dict[str, "PieceEncoder"] = {}


def encoder(path: str) -> "PieceEncoder":
    """The vocabulary file's encoder; a worker loads it once."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def families(pieces: Iterable[str]) -> list[set[str]]:
    """Sets of characters that are linked by standing next to each other in a piece, blanks left aside."""
    of: dict[str, set[str]] = {}
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            if " " not in (a, b):
                one, other = of.setdefault(a, {a}), of.setdefault(b, {b})
                if one is not other:
                    one |= other
                    of.update(dict.fromkeys(other, one))
    return list({id(f): f for f in of.values()}.values())


class Runs(dict):
    """The packed ids of runs; a run not met yet is encoded on the way."""

    def __init__(self, work: Callable[[str], bytes]):
        self.work, self.older = work, {}

    def __missing__(self, run: str) -> bytes:
        known = self.older.get(run)
        if known is None:
            known = self.work(run)
        if len(run) <= LONG_RUN:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[run] = known
        return known


class PieceEncoder:
    """Ids of whole texts, equal to the library's; for merge-type vocabularies without a normalisation table."""

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds, rules = model.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only merge-type vocabularies without user-defined or unused pieces are supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only vocabularies that keep texts as they are, with a blank in front, are supported")
        pieces = [(i, p.piece.replace(SIGN, " "), p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.ids = {piece: i for i, piece, _ in pieces}
        self.order = {piece: -score for _, piece, score in pieces}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = self.library.unk_id()
        self.decimals = [str(i) for i in range(len(model.pieces))]
        if any(" " in piece.lstrip(" ") for piece in self.ids):
            self.parts = re.compile("(?s).+")
        else:
            runs = ["[" + re.escape("".join(sorted(f))) + "]+" for f in families(self.ids)]
            self.parts = re.compile(f" *(?:{'|'.join([*runs, '[^ ]'])})| +")
        self.runs = Runs(self.run_ids)

    def agenda(self, run: str) -> list[str]:
        """The symbols left when no adjacent pair of ``run`` forms a piece; the heap is for runs too long to scan."""
        order = self.order
        if len(run) <= LONG_RUN:
            symbols, rank_of = list(run), order.get
            ranks = [rank_of(a + b, NEVER) for a, b in zip(run, run[1:])]
            while ranks and (best := min(ranks)) < NEVER:
                at = ranks.index(best)
                symbols[at : at + 2] = [joined] = [symbols[at] + symbols[at + 1]]
                del ranks[at]
                if at < len(ranks):
                    ranks[at] = rank_of(joined + symbols[at + 1], NEVER)
                if at:
                    ranks[at - 1] = rank_of(symbols[at - 1] + joined, NEVER)
            return symbols
        symbols = list(run)
        n = len(symbols)
        ranks = [order.get(a + b) for a, b in zip(run, run[1:])]
        waiting = [(rank, i, i + 1, 2) for i, rank in enumerate(ranks) if rank is not None]
        heapify(waiting)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while waiting:
            _, i, j, size = heappop(waiting)
            a, b = symbols[i], symbols[j]
            if not a or not b or len(a) + len(b) != size:
                continue
            symbols[i], symbols[j] = joined, _ = a + b, ""
            after[i] = far = after[j]
            if far < n:
                before[far] = i
                rank = order.get(joined + symbols[far])
                if rank is not None:
                    heappush(waiting, (rank, i, far, size + len(symbols[far])))
            near = before[i]
            if near >= 0:
                rank = order.get(symbols[near] + joined)
                if rank is not None:
                    heappush(waiting, (rank, near, i, size + len(symbols[near])))
        return [s for s in symbols if s]

    def fallback(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.replace(" ", SIGN).encode()] if self.bytes else [self.unknown]

    def run_ids(self, run: str) -> bytes:
        symbols = self.agenda(run)
        ids = [self.ids.get(s) for s in symbols]
        if None in ids:
            ids = [i for s in symbols for i in ([self.ids[s]] if s in self.ids else self.fallback(s))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        if not text:
            return []
        runs = self.runs
        return np.frombuffer(b"".join([runs[r] for r in self.parts.findall(" " + text.replace(SIGN, " "))]), "<u4").tolist()

    def decimal(self, ids: list[int]) -> str:
        names = self.decimals
        return ",".join([names[i] for i in ids])


def encode_pieces(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """``docs`` with ``piece_ids`` (array), ``ids_text`` (decimal, comma-joined), ``decoded`` and ``agrees``.

    ``agrees`` tells whether the library gives the same ids for the whole text;
    it is true without a look if ``check`` is off.  A null or empty text has no
    ids and decodes to an empty text; repeated rows stay, columns of any name
    are kept (but ``text`` becomes ``decoded``), an empty table gives an empty
    one.  Texts of any length are encoded whole; tasks work on slices of some MB.
    """
    return _mapped(docs, model_path, check, _whole, "piece_ids array<int>, ids_text string, decoded string")


def encoding_digests(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """Per document ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``agrees``; edge cases as in ``encode_pieces``."""
    return _mapped(docs, model_path, check, _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _whole(ids, decimal, decoded):
    return {"piece_ids": ids, "ids_text": decimal, "decoded": decoded}


def _digests(ids, decimal, decoded):
    return {
        "n_tokens": list(map(len, ids)),
        "ids_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decimal],
        "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
    }


def _mapped(docs: DataFrame, model_path: str, check: bool, columns, types: str) -> DataFrame:
    plain = set_aside(docs)
    kept = [f for f in plain.schema.fields if f.name != "text"]

    def work(rows, texts):
        own = encoder(model_path)
        plain_texts = [t.decode() for t in texts]
        ids = [own.encode(t) for t in plain_texts]
        agrees = [a == b for a, b in zip(ids, own.library.encode(plain_texts, num_threads=1))] if check else [True] * len(ids)
        decoded = own.library.decode(ids, num_threads=1) if ids else []
        return {f.name: rows.column(f.name) for f in kept} | columns(ids, [own.decimal(i) for i in ids], decoded) | {"agrees": agrees}

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"{types}, agrees boolean"
    result = map_slices(plain, work, schema, limit=SLICE_BYTES)
    return result.toDF(*[c for c in docs.columns if c != "text"], *result.columns[len(kept) :])
