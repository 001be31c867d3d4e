"""Phrase mining with Rabin-Karp fingerprints of all n-grams.

Prefix polynomials over bytes give every word's hash, prefix polynomials over
word hashes those of every n-gram, without a Python object per word.

1. Words, then pairs, then longer n-grams: every task adds up its fingerprints,
   a shuffle sums them, frequent ones are marked in a bit table of fixed size.
   Only n-grams are sent whose two shorter parts are marked, as a phrase is no
   more frequent than its parts.  Fingerprints travel as steps between sorted
   neighbours, by ranges; n-grams of one sent fingerprint are counted together,
   which can mark a rare one, but misses none.
2. N-grams that are marked are cut out of the texts where they occur, and their
   counts are summed once more by the phrase itself, with a pointer to the first
   document; tasks send them sorted and packed.  So two phrases of one fingerprint are told apart by their text,
   and what a full bit table lets through costs time, but changes no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.text import slices
from riskloom.session import stage

#: Bits of the table of marks; it is broadcast, 16 MB at any size of the corpus.
MARK_BITS = 27
#: Text bytes that a task works on at a time, and bytes of one run of prefix polynomials.
SLICE_BYTES, RUN_BYTES = 2 << 20, 1 << 20
#: Fingerprints that a task adds up before it hands them on.
HELD = 1_000_000
#: Upper bits of a fingerprint that are sent, more than the table of marks takes.
SENT_BITS = 36
#: Text bytes whose n-grams one range of fingerprints takes, on average.
RANGE_BYTES = 8 << 20
#: Phrases that a task adds up before it hands them on, and text bytes whose phrases one range takes.
WRITTEN_HELD, WRITTEN_BYTES = 400_000, 16 << 20
#: Ranges of a small corpus.
LEAST_RANGES = 64

#: A-Z become a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Between words: 1, between pieces: 2.
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = 1
KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Polynomials:
    """Prefix polynomials modulo 2**64; the powers are kept and grow with the longest run."""

    def __init__(self):
        self.up, self.down = powers(BASE, 1), powers(INVERSE, 1)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``values[start:end]``, equal for equal content wherever it stands."""
        if len(self.up) <= len(values):
            n = 2 * len(values) + 1
            self.up, self.down = powers(BASE, n), powers(INVERSE, n)
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=prefix[1:])
        return (prefix[ends] - prefix[starts]) * self.down[starts]


class Words:
    """The words of some texts: places, piece and text of each, and fingerprints of their n-grams."""

    def __init__(self, texts: list[bytes], salts: np.ndarray, polynomials: Polynomials):
        self.polynomials = polynomials
        self.data = b"\n".join(texts).translate(LOWER)
        data = np.frombuffer(self.data, np.uint8)
        kind = KIND[data]
        word = np.zeros(len(data) + 2, np.int8)
        word[1:-1] = kind == 0
        edges = np.diff(word)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        self.offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        self.text = np.searchsorted(self.offsets, self.starts, side="right") - 1
        hashes = np.zeros(len(self.starts), np.uint64)
        first = 0
        while first < len(self.starts):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + RUN_BYTES)))
            low, high = int(self.starts[first]), int(self.ends[last - 1])
            hashes[first:last] = polynomials.spans(BYTE_VALUES[data[low:high]], self.starts[first:last] - low, self.ends[first:last] - low)
            first = last
        self.salts = salts
        self.hashes = _mixed(hashes)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-grams within pieces, and their fingerprints, which differ by language and length."""
        count = len(self.starts) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.piece[:count] == self.piece[n - 1 : n - 1 + count])
        spans = self.hashes[first] if n == 1 else self.polynomials.spans(self.hashes, first, first + n)
        return first, self._salted(spans, first, n)

    def _salted(self, spans: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        return _mixed(spans ^ (self.salts[self.text[first]] + np.uint64(n)))

    def prints(self, first: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams that begin with the words ``first``."""
        return self._salted(self.hashes[first] if n == 1 else self.polynomials.spans(self.hashes, first, first + n), first, n)

    def exact_ids(self) -> np.ndarray:
        """A number for every word, equal for equal words: by hash, and every word compared with the first of its hash."""
        _, head, ids = np.unique(self.hashes, return_index=True, return_inverse=True)
        data, sizes = np.frombuffer(self.data, np.uint8), self.ends - self.starts
        model = head[ids]
        differs = sizes != sizes[model]
        like = np.flatnonzero(~differs)
        held = sizes[like]
        steps = np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)
        unequal = data[np.repeat(self.starts[like], held) + steps] != data[np.repeat(self.starts[model[like]], held) + steps]
        differs[np.repeat(like, held)[unequal]] = True
        others: dict[bytes, int] = {}
        for at in np.flatnonzero(differs).tolist():
            ids[at] = others.setdefault(self.data[self.starts[at] : self.ends[at]], len(head) + len(others))
        return ids

    def exact_grams(self, ids: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First words of the n-grams of every length, and numbers equal for equal n-grams."""
        count = len(ids)
        grams, first = ids, np.arange(count)
        for n in range(1, longest + 1):
            if n > 1:
                first = np.flatnonzero(self.piece[: max(0, count - n + 1)] == self.piece[n - 1 :])
                pairs = whole[first] * (count + 1) + ids[first + n - 1]
                _, grams = np.unique(pairs, return_inverse=True)
            whole = np.zeros(count, np.int64)
            whole[first] = grams
            yield first, grams

    def lang_of(self, langs: list[str]) -> np.ndarray:
        """For every text the number of the first text of its language."""
        firsts: dict[str, int] = {}
        return np.array([firsts.setdefault(lang, at) for at, lang in enumerate(langs)], np.int64)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    polynomials = Polynomials()
    for rows, texts in slices(batches, limit=SLICE_BYTES):
        salts = np.array([hash_text(lang) for lang in rows.column("lang").to_pylist()], np.uint64)
        yield rows, Words(texts, salts, polynomials)


def hash_text(text: str) -> int:
    value = 1
    for b in text.encode():
        value = (value * BASE + b + 1) % (1 << 64)
    return value


class Marks:
    """A table of bits by the upper bits of fingerprints, made in Spark, read in tasks."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two numbers whose upper bits are set for a fingerprint, as far as it is sent."""
        sent = fingerprints >> np.uint64(64 - SENT_BITS) << np.uint64(64 - SENT_BITS)
        return sent, _mixed(sent)

    def holds(self, fingerprints: np.ndarray) -> np.ndarray:
        one, two = self.places(fingerprints)
        return self._set(one) & self._set(two)

    def _set(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers >> np.uint64(64 - MARK_BITS)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    @staticmethod
    def of(places: DataFrame) -> np.ndarray:
        """Bit table of a column ``place`` of 64-bit numbers: at most 2**(MARK_BITS-6) rows of 64 bits come to the driver."""
        at = F.shiftrightunsigned("place", 64 - MARK_BITS)
        marked = places.groupBy(F.shiftright(at, 6).alias("row")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(place, {64 - MARK_BITS}) & 63 as int))")).alias("bits")).toArrow()
        bits = np.zeros(1 << (MARK_BITS - 6), np.uint64)
        bits[marked["row"].to_numpy()] = marked["bits"].to_numpy().view(np.uint64)
        return bits


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers as bytes of one place after the other."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def packed(found: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted fingerprints as steps, and their counts."""
    steps = np.diff(found, prepend=found.dtype.type(0))
    return zlib.compress(_planes(steps) + _planes(counts), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes)
    return np.cumsum(steps, dtype=np.uint64), counts


def _summed(parts: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """What a task has found, packed by range."""
    found, counts = np.unique(np.concatenate(parts) >> np.uint64(64 - SENT_BITS), return_counts=True)
    width = -(-(1 << SENT_BITS) // ranges)
    cuts = np.searchsorted(found, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
    held = np.flatnonzero(np.diff(cuts))
    data = [packed(found[cuts[r] : cuts[r + 1]], counts[cuts[r] : cuts[r + 1]]) for r in held.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(data, pa.binary())], ["range", "data"])


def _frequent(docs: DataFrame, n: int, least: int, marks, ranges: int) -> DataFrame:
    """Places to mark, of n-grams found ``least`` times or more; two words and more only where both shorter parts are marked."""

    def run(batches):
        table = Marks(marks.value) if n > 1 else None
        held, size = [], 0
        for _, words in _texts(batches):
            first, prints = words.grams(n)
            if n > 1:
                shorter, marked = words.grams(n - 1)
                good = np.zeros(len(words.starts) + 1, bool)
                good[shorter[table.holds(marked)]] = True
                prints = prints[good[first] & good[first + 1]]
            held.append(prints)
            size += len(prints)
            if size > HELD:
                yield _summed(held, ranges)
                held, size = [], 0
        if held:
            yield _summed(held, ranges)

    def total(rows):
        found, counts = (np.concatenate(c) for c in zip(*(unpacked(d.as_py()) for d in rows.column("data"))))
        order = np.argsort(found, kind="stable")
        found, counts = found[order], counts[order]
        heads = np.flatnonzero(np.diff(found, prepend=~found[:1]))
        often = found[heads[np.add.reduceat(counts, heads) >= least]] << np.uint64(64 - SENT_BITS)
        return pa.table({"place": pa.array(np.concatenate(Marks.places(often)).view(np.int64))})

    counted = docs.select("text", "lang").mapInArrow(run, "range int, data binary")
    return counted.groupBy("range").applyInArrow(total, "place bigint")


def _listed(keys: pa.Array, counts: pa.Array, doc_ids: pa.Array) -> tuple[bytes, bytes]:
    """Sorted keys, counts and documents, packed."""
    keys = pa.array(keys, pa.large_string()).cast(pa.large_binary())
    ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    text = keys.buffers()[2][ends[0] : ends[-1]].to_pybytes()
    held = pa.BufferOutputStream()
    with pa.ipc.new_stream(held, pa.schema([("doc_id", doc_ids.type)])) as stream:
        stream.write_batch(pa.record_batch([doc_ids], ["doc_id"]))
    return zlib.compress(len(keys).to_bytes(8, "little") + _planes(np.diff(ends)) + _planes(counts.to_numpy()) + text, 1), zlib.compress(held.getvalue(), 1)


def _unlisted(data: bytes, doc_ids: bytes) -> pa.Table:
    data = zlib.decompress(data)
    n = int.from_bytes(data[:8], "little")
    sizes, counts = (np.ascontiguousarray(p.T).view("<i8").ravel() for p in np.frombuffer(data, np.uint8, 16 * n, 8).reshape(2, 8, -1))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    keys = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(data[8 + 16 * n :]))
    return pa.table([keys, pa.array(counts), pa.ipc.open_stream(zlib.decompress(doc_ids)).read_all().column(0)], ["key", "n", "doc_id"])


def _merged(rows: pa.Table) -> pa.Table:
    """One row of equal keys, in order: all counts, the smallest doc_id."""
    names = [c for c in rows.column_names if c not in ("n", "doc_id")]
    made = rows.group_by(names, use_threads=False).aggregate([("n", "sum"), ("doc_id", "min")])
    return made.rename_columns([*names, "n", "doc_id"]).sort_by([(c, "ascending") for c in names])


def _written_out(docs: DataFrame, longest: int, marks, ranges: int = LEAST_RANGES) -> DataFrame:
    """Marked n-grams as text: lang, phrase, n, doc_id, the smallest that holds it; a null phrase counts all words of a language.

    A task adds up phrases by their text, sorts and packs them by ranges of their
    fingerprints; equal phrases meet in one range.  A key is the language, a line
    feed, which no phrase holds, and the phrase.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    doc_type = to_arrow_schema(spark.createDataFrame([], f"doc_id {kind}").schema).field("doc_id").type

    def rows_of(where: np.ndarray, keys: list[bytes], counts: np.ndarray, doc_ids: list) -> pa.Table:
        columns = [pa.array(where % np.uint64(ranges)).cast(pa.int32()), pa.array(keys, pa.large_binary()).cast(pa.large_string()), pa.array(counts, pa.int64()), pa.array(doc_ids, doc_type)]
        return pa.table(columns, ["range", "key", "n", "doc_id"])

    def found(rows: pa.RecordBatch, words: Words, table: Marks) -> Iterator[pa.Table]:
        langs, doc_ids = rows.column("lang").to_pylist(), rows.column("doc_id").to_pylist()
        heads = [lang.encode() + b"\n" for lang in langs]
        place = np.empty(len(doc_ids), np.int64)
        place[sorted(range(len(doc_ids)), key=lambda t: (doc_ids[t] is None, doc_ids[t] if doc_ids[t] is not None else 0))] = np.arange(len(doc_ids))
        ids = words.exact_ids()
        texts = [words.data[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist())] if len(ids) else []
        for n, (first, grams) in enumerate(words.exact_grams(ids, longest), 1):
            prints = words.prints(first, n)
            kept = table.holds(prints)
            if n > 1:
                kept &= good[first] & good[first + 1]
            # a phrase is no more frequent than its parts
            good = np.zeros(len(ids) + 1, bool)
            good[first[kept]] = True
            # by doc_id, so that the first of equal n-grams is in the smallest
            kept = np.flatnonzero(kept)
            kept = kept[np.argsort(place[words.text[first[kept]]], kind="stable")]
            # the same words in two languages are two phrases
            alike = grams[kept] * len(rows) + words.lang_of(langs)[words.text[first[kept]]]
            _, at, counts = np.unique(alike, return_index=True, return_counts=True)
            where, at = prints[kept][at], first[kept][at]
            text = words.text[at].tolist()
            yield rows_of(where, [heads[t] + b" ".join(texts[i : i + n]) for t, i in zip(text, at.tolist())], counts, [doc_ids[t] for t in text])
        text, counts = np.unique(words.text, return_counts=True)
        yield rows_of(words.salts[text], [heads[t] for t in text.tolist()], counts, [None] * len(text))

    def packets(held: list[pa.Table]) -> pa.RecordBatch:
        whole = _merged(pa.concat_tables(held)).combine_chunks()
        cuts = np.searchsorted(whole.column("range").to_numpy(), np.arange(ranges + 1))
        at = np.flatnonzero(np.diff(cuts))
        keys, counts, doc_ids = (whole.column(c).combine_chunks() for c in ("key", "n", "doc_id"))
        made = [_listed(*(c[int(cuts[r]) : int(cuts[r + 1])] for c in (keys, counts, doc_ids))) for r in at.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(list(c), pa.binary()) for c in zip(*made))], ["range", "data", "docs"])

    def run(batches):
        table = Marks(marks.value)
        held, size = [], 0
        for rows, words in _texts(batches):
            for part in found(rows, words, table):
                held.append(part)
                size += len(part)
            if size > WRITTEN_HELD:
                yield packets(held)
                held, size = [], 0
        if size:
            yield packets(held)

    def total(rows):
        whole = _merged(pa.concat_tables(_unlisted(data.as_py(), doc_ids.as_py()) for data, doc_ids in zip(rows.column("data"), rows.column("docs"))))
        return whole.cast(pa.schema([("key", pa.string()), ("n", pa.int64()), ("doc_id", doc_type)]))

    packed_rows = docs.select("doc_id", "text", "lang").mapInArrow(run, "range int, data binary, docs binary")
    summed = packed_rows.groupBy("range").applyInArrow(total, f"key string, n bigint, doc_id {kind}")
    phrase = F.substring_index("key", "\n", -1)
    lang = F.expr("left(key, length(key) - length(substring_index(key, '\\n', -1)) - 1)")
    return summed.select(lang.alias("lang"), F.nullif(phrase, F.lit("")).alias("phrase"), "n", "doc_id")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """lang, phrase, words, n, first: every phrase of one to ``longest`` words found ``least`` times or more in its language.

    ``first`` is the smallest doc_id that holds it.  A row
    with a null phrase and 0 words counts all words of a language.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    bits, marks = np.zeros(1 << (MARK_BITS - 6), np.uint64), None
    for n in range(1, longest + 1):
        bits |= Marks.of(_frequent(docs, n, least, marks, ranges))
        if marks is not None:
            marks.unpersist()
        marks = spark.sparkContext.broadcast(bits)
    written = _written_out(docs, longest, marks, max(LEAST_RANGES, -(-size // WRITTEN_BYTES)))
    words = F.when(F.col("phrase").isNull(), 0).otherwise(F.size(F.split("phrase", " "))).alias("words")
    return written.select("lang", "phrase", words, "n", F.col("doc_id").alias("first")).where((F.col("n") >= least) | (F.col("words") == 0))


def mine_phrases(docs: DataFrame, top: int = 2000, longest: int = 3, least: int = 10, covered: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, first: the ``top`` phrases of two to ``longest`` words of every language.

    A phrase that occurs ``a`` times is cut where a*a / (l*r) is least, l and r
    being the counts of the two parts; the score is a million times that, rounded
    down, in whole numbers.  A phrase is dropped if one longer candidate around it
    has ``covered`` per cent of its occurrences.  Ties: a, then the phrase.

    Null and empty texts have no words, a null language is ``und``, repeated rows
    count as often as they stand there, other columns are ignored, an empty table
    gives an empty result.  Texts and words of any length are taken whole.
    """
    counts = stage(phrase_counts(docs, longest, least), "phrases")
    totals = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    known = counts.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    parts = F.split("phrase", " ")
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), "first", parts.alias("parts"))
    # The two parts are cut out of the phrase on both sides of a shuffle, which carries the phrase alone.
    cuts = found.select("lang", "phrase", "a", "words", "first", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left, right = F.expr("lang = lang_l and substring_index(phrase, ' ', k) = left"), F.expr("lang = lang_r and substring_index(phrase, ' ', k - words) = right")
    scored = cuts.join(known.toDF("lang_l", "left", "l"), left).join(known.toDF("lang_r", "right", "r"), right)
    square = F.expr("cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000 as decimal(38,0)) div cast(cast(l as decimal(16,0)) * cast(r as decimal(16,0)) as decimal(38,0))")
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct(square.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("first").alias("first"))
    inside = found.where("words > 2").select("lang", F.col("a").alias("around"), "parts", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "around", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inside = inside.groupBy("lang", F.concat_ws(" ", F.slice("parts", F.col("at"), F.col("size"))).alias("phrase")).agg(F.max("around").alias("around"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"), "first")
