"""Token ids of whole texts, through the tokenizers library.

Where a vocabulary's normaliser and pre-tokeniser never join characters across
white space, the ids of a text are those of its white-space separated chunks in
order, and a worker keeps the ids of chunks it has met, up to a fixed number.
Chunks of plain Latin letters go straight to the library's model, which skips
its normalisation; everything else takes the library's whole way.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Chunks a worker remembers in each of two generations; when the younger is full it becomes the older one.
REMEMBERED = 300_000
#: Longer chunks are encoded each time and not remembered.
LONG_CHUNK = 64

#: The pre-tokeniser's pattern that the chunk way is right for, and the same on plain Latin letters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")

_loaded: dict[str, "TextEncoder"] = {}


def encoder(path: str) -> "TextEncoder":
    """The vocabulary file's encoder; a worker loads it once."""
    if path not in _loaded:
        _loaded[path] = TextEncoder(path)
    return _loaded[path]


def vocabulary_size(path: str) -> int:
    return encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)


def splits_at_white_space(tokenizer: Tokenizer) -> bool:
    """Whether chunks between ASCII white space are encoded independently of each other."""
    told = json.loads(tokenizer.to_str())
    steps = [s.get("type") for s in (told["normalizer"] or {}).get("normalizers", [])]
    pieces = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [p.get("type") for p in pieces] == ["Split", "ByteLevel"]
        and pieces[0]["pattern"] == {"Regex": PATTERN}
        and (pieces[0]["behavior"], pieces[0]["invert"]) == ("Removed", True)
        and not pieces[1]["add_prefix_space"]
        and told["post_processor"] is None
        and not any(a["normalized"] or a["lstrip"] or a["rstrip"] for a in told["added_tokens"])
    )


class TextEncoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the library's ids of the whole text."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_chunk = splits_at_white_space(self.tokenizer)
        self.special = "<|"
        bytes_as_text = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: bytes_as_text.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in made]

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """The ids of every wanted chunk; most are remembered already."""
        missing = wanted.difference(self.chunks)
        if len(self.chunks) + len(missing) > REMEMBERED:
            self.older, self.chunks, self.pieces = self.chunks, {}, {}
            missing = wanted
        made, hard = {}, []
        pieces, older = self.pieces, self.older
        for chunk in missing:
            if chunk in older:
                made[chunk] = older[chunk]
                continue
            text = chunk.decode()
            if LATIN.fullmatch(text) is None or self.special in text:
                hard.append(chunk)
                continue
            parts = LATIN_PIECES.findall(text.lower())
            for p in parts:
                if p not in pieces:
                    pieces[p] = self._piece(p)
            made[chunk] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])
        made.update(zip(hard, self.whole([c.decode() for c in hard])))
        if len(pieces) > REMEMBERED:
            self.pieces = {}
        if len(made) > REMEMBERED:
            return made
        self.chunks.update(made)
        return self.chunks

    def encode_texts(self, texts: list[bytes], end: bytes = b"") -> list[bytes]:
        """The ids of every text, followed by ``end``."""
        if not self.by_chunk:
            return [ids + end for ids in self.whole([t.decode() for t in texts])]
        split = [text.split() for text in texts]
        wanted: set[bytes] = set()
        for chunks in split:
            wanted.update(chunks)
        known = self._learn(wanted)
        ids = [b"".join([known[c] for c in chunks]) + end for chunks in split]
        for chunk in [c for c in wanted if len(c) > LONG_CHUNK]:
            self.chunks.pop(chunk, None)
        return ids
