"""Language-model scores from a probabilistic suffix tree over words.

The tree's root has the smoothed word frequencies.  A context of one or two
words is retained where its next-word counts diverge enough from its parent's
distribution; a retained context's distribution is smoothed by its parent's.  A
word is scored in the longest retained suffix of the words before it.

Words below a training count share one symbol in contexts and as next symbol; such
a word's probability is the symbol's times its share of it.  The count is the same
for every corpus, so the alphabet grows with the corpus and a word's treatment hangs
on its own count alone.

Blocks and buckets tell each other whole counts, packed; probabilities are worked
out from them on either side.  Symbols are numbered by frequency.  Of contexts of two
symbols a block asks only about those that can be retained, as far as it knows: a
context's total is the count of its two symbols as a pair, told before.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import exchange

#: Additive smoothing of the root.
ADDED = 0.1
#: Training count that a word of the alphabet has at least; a power of two, as counts are told by class.
MIN_COUNT = 16
#: Weight of the parent's distribution, in counts.
PARENT_WEIGHT = 20.0
#: A context is retained where its log-likelihood gain over the parent exceeds this per next symbol, and this once.
GAIN_PER_SYMBOL, GAIN_ONCE = 1.0, 5.0
RARE, START, FIRST = 1, 2, 3
CLASSES = 48  # count classes, by powers of two


def in_training(doc_id: object) -> bool:
    """Whether a document is learned from; one without an id is not."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers from 0, column by column, the lowest bytes first, no more of them than the largest needs."""
    made = []
    for c in columns:
        c = np.ascontiguousarray(c).astype("<u8")
        width = -(-int(c.max()).bit_length() // 8) if len(c) else 0
        made += [bytes([width]), len(c).to_bytes(8, "little"), c.view(np.uint8).reshape(-1, 8).T[:width].tobytes()]
    return zlib.compress(b"".join(made), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    data, columns, at = zlib.decompress(data), [], 0
    while at < len(data):
        width, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = np.frombuffer(data, np.uint8, width * n, at + 9).reshape(width, n).T
        columns.append(whole.view("<u8").ravel())
        at += 9 + width * n
    return columns


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, small ones of either sign as small numbers."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    return (steps << 1) ^ (steps >> 63)


def _unstepped(steps: np.ndarray) -> np.ndarray:
    steps = steps.astype(np.int64)
    return np.cumsum((steps >> 1) ^ -(steps & 1))


def _by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The stable order by bucket; small numbers are sorted by their digits."""
    return np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """An order of rows by several columns, as one number where they fit into one."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.int64)
    for c, width in zip(columns, bits):
        key = key << width | c
    return np.argsort(key)


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Tokens:
    """The words of a block's documents, each document closed by an end token."""

    def __init__(self, ids: list, texts: list[bytes]):
        vocabulary = Numbers({b"": 0})  # the end token; no word is empty
        parts, sizes = [], []
        for text in texts:
            words = text.lower().split()
            words.append(b"")
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)
        self.stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.training = np.array([in_training(i) for i in ids], bool)
        self.learned = np.repeat(self.training, self.sizes)

    def cuts(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        bucket = (self.hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(self.hashes)
        order = order[_by_bucket(bucket[order], buckets)]
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


# Question 1: the training counts of words.


def _ask_counts(buckets: int):
    def work(ids, texts, _):
        tokens = Tokens(ids, texts)
        counts = np.bincount(tokens.stream[tokens.learned], minlength=len(tokens.hashes))
        order, cuts = tokens.cuts(buckets)
        parts = [order[cuts[b] : cuts[b + 1]] for b in range(buckets)]
        # Every bucket is asked, as every bucket's totals are needed.
        return {b: packed(np.diff(tokens.hashes[part], prepend=np.uint64(0)), counts[part]) for b, part in enumerate(parts)}

    return work


def _answer_counts(asked: dict[int, bytes]) -> dict[int, bytes]:
    """Totals of the bucket's words by count class, then each asked word's count and place among the bucket's frequent ones, from 1."""
    hashes, counts = zip(*map(unpacked, asked.values()))
    cuts = np.cumsum([0, *map(len, hashes)])
    distinct, inverse = np.unique(np.concatenate([np.cumsum(h, dtype=np.uint64) for h in hashes]), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, np.concatenate(counts).astype(np.int64))
    known = total[total > 0]
    level = np.floor(np.log2(known)).astype(np.int64) if len(known) else np.zeros(0, np.int64)
    head = np.concatenate([np.bincount(level, minlength=CLASSES), np.bincount(level, weights=known, minlength=CLASSES).astype(np.int64)])
    often = np.flatnonzero(total >= MIN_COUNT)
    place = np.zeros(len(distinct), np.int64)
    place[often[np.argsort(-total[often], kind="stable")]] = np.arange(1, len(often) + 1)
    each, places = total[inverse], place[inverse]
    return {block: packed(head, each[cuts[i] : cuts[i + 1]], places[cuts[i] : cuts[i + 1]]) for i, block in enumerate(asked)}


class Root:
    """Counts of a block's words, and the corpus totals."""

    def __init__(self, tokens: Tokens, answers: dict[int, bytes], buckets: int):
        order, cuts = tokens.cuts(buckets)
        self.counts = np.zeros(len(tokens.hashes), np.int64)
        self.symbols = np.full(len(tokens.hashes), RARE, np.int64)
        totals = np.zeros(2 * CLASSES, np.int64)
        for b in range(buckets):
            head, counts, places = (c.astype(np.int64) for c in unpacked(answers[b]))
            part = order[cuts[b] : cuts[b + 1]]
            totals += head
            self.counts[part] = counts
            # Places of all buckets alternate, so that frequent symbols have small numbers.
            self.symbols[part] = np.where(places > 0, FIRST + (places - 1) * buckets + b, RARE)
        self._set(totals)

    def _set(self, totals: np.ndarray) -> None:
        self.totals = totals
        words, mass = totals[:CLASSES], totals[CLASSES:]
        self.tokens, self.words = int(mass.sum()), int(words.sum())
        self.whole = self.tokens + ADDED * (self.words + 1)
        level = MIN_COUNT.bit_length() - 1
        self.rare = (int(mass[:level].sum()) + ADDED * (int(words[:level].sum()) + 1)) / self.whole
        self.shares = (self.counts + ADDED) / self.whole
        self.often = self.counts >= MIN_COUNT

    def packed(self) -> bytes:
        return packed(self.totals, self.counts, self.symbols)

    @classmethod
    def unpacked(cls, data: bytes) -> "Root":
        made = cls.__new__(cls)
        totals, made.counts, made.symbols = (c.astype(np.int64) for c in unpacked(data))
        made._set(totals)
        return made


class Grams:
    """The distinct (v, u, w) of a block: the next symbol w after u v, and the distinct (v, w) among them; or the latter alone."""

    def __init__(self, tokens: Tokens, root: Root, pairs_only: bool = False):
        self.alphabet, code = np.unique(np.append(root.symbols, START).astype(np.uint32), return_inverse=True)
        start, code = int(code[-1]), code[:-1]
        next_ = code[tokens.stream].astype(np.int64)
        v = np.empty(len(next_), np.int64)
        u = np.empty(len(next_), np.int64)
        v[1:], u[2:] = next_[:-1], next_[:-2]
        v[tokens.starts] = u[tokens.starts] = start
        second = tokens.starts[tokens.sizes > 1] + 1
        u[second] = start
        size = len(self.alphabet)
        if pairs_only:
            pairs, pair = np.unique(v * size + next_, return_inverse=True)
            self.pair_counts = np.bincount(pair[tokens.learned], minlength=len(pairs))
        else:
            keys, self.inverse = np.unique((v * size + u) * size + next_, return_inverse=True)
            self.w, rest = keys % size, keys // size
            self.u, self.v = rest % size, rest // size
            self.counts = np.bincount(self.inverse[tokens.learned], minlength=len(keys))
            pairs, self.pair = np.unique(self.v * size + self.w, return_inverse=True)
        self.pair_v, self.pair_w = pairs // size, pairs % size
        self.whole, self.rare = root.whole, root.rare
        self.known = np.zeros(size, np.int64)
        self.known[code[root.often]] = root.counts[root.often]
        self.pair_shares = _shares(self.known[self.pair_w], root.whole, root.rare)


def _shares(known: np.ndarray, whole: float, rare: float) -> np.ndarray:
    """The root's probability of symbols with such counts; 0 is the symbol of rare words."""
    return np.where(known > 0, (known + ADDED) / whole, rare)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """A group number for equal neighbours of sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


class Cut:
    """Rows of a block gathered by the bucket of their context: what is asked about them, and what is told."""

    def __init__(self, grams: Grams, buckets: int, rows: np.ndarray, context: tuple[np.ndarray, ...], next_: np.ndarray):
        """``rows`` numbers rows that are sorted by ``context``, then by ``next_``."""
        self.grams, self.size = grams, len(next_)
        mixed = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for c in context:
                mixed = (mixed ^ grams.alphabet[c[rows]]) * np.uint64(0x9FB21C651E98DF25)
                mixed ^= mixed >> np.uint64(32)
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        order = _by_bucket(bucket, buckets)
        self.order, self.bounds = rows[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.context, self.next = [c[self.order] for c in context], next_[self.order]
        self.heads = np.flatnonzero(np.diff(_groups(*self.context), prepend=-1))
        self.sizes = np.diff(self.heads, append=len(self.order))
        self.head_bounds = np.searchsorted(self.heads, self.bounds)

    def asked(self, counts: np.ndarray, *behind: np.ndarray) -> dict[int, bytes]:
        """For each bucket: contexts, their rows, and what the parent's probabilities follow from.

        ``behind`` is nothing, or the parent's own total and counts, row by row.
        """
        alphabet, known = self.grams.alphabet, self.grams.known
        numbers = np.array([self.grams.whole, self.grams.rare]).tobytes()
        made = {}
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            part, heads = slice(self.bounds[b], self.bounds[b + 1]), slice(self.head_bounds[b], self.head_bounds[b + 1])
            at, order = self.heads[heads], self.order[part]
            columns = [_steps(alphabet[self.context[0][at]])] + [alphabet[c[at]] for c in self.context[1:]]
            columns += [self.sizes[heads], alphabet[self.next[part]], counts[order], _steps(known[np.unique(self.next[part])])]
            if behind:
                columns += [_steps(behind[0][self.order[at]]), behind[1][order]]
            made[b] = numbers + packed(*columns)
        return made

    def told(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether its context is retained, the context's total, its own count) of every row.

        Totals are zero for contexts that are not retained, and so are counts behind two symbols.
        """
        columns = [unpacked(answers[b]) for b in np.flatnonzero(np.diff(self.bounds)).tolist()]
        kept, total, counts = (np.concatenate(c).astype(np.int64) for c in zip(*columns)) if columns else np.zeros((3, 0), np.int64)
        kept = np.repeat(kept > 0, self.sizes)
        made = np.zeros((3, self.size), np.int64)
        made[0, self.order] = kept
        made[1, self.order[kept]] = np.repeat(total, self.sizes[kept[self.heads]])
        made[2, self.order[kept] if len(self.context) > 1 else self.order] = counts
        return made[0] > 0, made[1], made[2]


def _read(data: bytes, symbols: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(context symbols and next symbol, counts, parent's probabilities, rows of each context) of a packet."""
    whole, rare = np.frombuffer(data, np.float64, 2)
    columns = unpacked(data[16:])
    context, (sizes, next_, counts, known) = columns[:symbols], columns[symbols : symbols + 4]
    sizes = sizes.astype(np.int64)
    context[0] = _unstepped(context[0])
    _, code = np.unique(next_, return_inverse=True)
    parent = _shares(_unstepped(known)[code], whole, rare)
    if len(columns) > symbols + 4:
        parent = inside(columns[-1].astype(np.int64), np.repeat(_unstepped(columns[-2]), sizes), parent)
    names = [*(np.repeat(c.astype(np.uint32), sizes) for c in context), next_.astype(np.uint32)]
    return names, counts.astype(np.int64), parent, sizes


def _answer_contexts(symbols: int):
    """Rows of all blocks with the same symbols become one; every block is told which of its contexts are retained, and totals and counts."""

    def work(asked: dict[int, bytes]) -> dict[int, bytes]:
        parts = [_read(data, symbols) for data in asked.values()]
        names = [np.concatenate(c) for c in zip(*(p[0] for p in parts))]
        counts, parent = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        sizes = [p[3] for p in parts]
        del parts
        order = _order(names)
        group = _groups(*[c[order] for c in names])
        at = order[np.flatnonzero(np.diff(group, prepend=-1))]
        sums = np.bincount(group, counts[order]).astype(np.int64)
        context = _groups(*[c[at] for c in names[:-1]])
        total, kept = _retained(context, sums, parent[at])
        row = np.empty(len(order), np.int64)
        row[order] = group
        made, start = {}, 0
        for block, rows in zip(asked, sizes):
            mine = row[start : (start := start + int(rows.sum()))]
            of = context[mine[np.cumsum(rows) - rows]]
            if symbols > 1:
                mine = mine[np.repeat(kept[of], rows)]
            made[block] = packed(kept[of], total[of[kept[of]]], sums[mine])
        return made

    return work


def inside(counts: np.ndarray, total: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with such totals, smoothed by the parent's."""
    return (counts + PARENT_WEIGHT * parent) / (total + PARENT_WEIGHT)


def _retained(context: np.ndarray, counts: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, whether it is retained) of every context, from its sorted (context, next symbol) rows."""
    total = np.bincount(context, counts).astype(np.int64)
    gain = np.bincount(context, counts * np.log(inside(counts, total[context], parent) / parent))
    kinds = np.bincount(context, counts > 0)
    return total, gain > GAIN_PER_SYMBOL * kinds + GAIN_ONCE


# Question 2: contexts of one symbol.


def pair_scores(v: np.ndarray, w: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """P(w | v) of sorted distinct (v, w); the root's share with a minus sign where v is not retained."""
    context = _groups(v)
    total, kept = _retained(context, counts, shares)
    return np.where(kept[context], inside(counts, total[context], shares), -shares)


def _pair_cut(grams: Grams, buckets: int) -> Cut:
    return Cut(grams, buckets, np.arange(len(grams.pair_v)), (grams.pair_v,), grams.pair_w)


def _ask_pairs(buckets: int):
    def work(ids, texts, answers):
        tokens = Tokens(ids, texts)
        root = Root(tokens, answers, buckets)
        grams = Grams(tokens, root, pairs_only=True)
        return _pair_cut(grams, buckets).asked(grams.pair_counts) | {-1: root.packed()}

    return work


# Question 3: contexts of two symbols.


def context_scores(v: np.ndarray, u: np.ndarray, w: np.ndarray, counts: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 P(w | longest retained suffix of u v) of sorted distinct (v, u, w); ``one`` is the answer for (v, w)."""
    context, parent = _groups(v, u), np.abs(one)
    total, kept = _retained(context, counts, parent)
    return np.log10(np.where(kept[context] & (one > 0), inside(counts, total[context], parent), parent))


class Pairs:
    """What a block knows of its (v, w) once they are answered."""

    def __init__(self, grams: Grams, buckets: int, answers: dict[int, bytes]):
        self.kept, self.total, self.counts = _pair_cut(grams, buckets).told(answers)
        self.chance = np.where(self.kept, inside(self.counts, self.total, grams.pair_shares), grams.pair_shares)

    def open_rows(self, grams: Grams) -> np.ndarray:
        """Rows (v, u, w) whose context may be retained.

        A context is not retained where v alone is not.  Nor is one that training has
        once at most, as long as v has few occurrences: what follows once has a chance
        of 1 / (total of v + PARENT_WEIGHT) at least behind v, which bounds the gain.
        And where all of a context's occurrences are the block's own, its gain is known;
        buckets that hear nothing of a context take it for not retained.
        """
        context = _groups(grams.v, grams.u)
        heads = np.flatnonzero(np.diff(context, prepend=-1))
        v, u, size = grams.v[heads], grams.u[heads], len(grams.alphabet)
        pairs = grams.pair_v * size + grams.pair_w
        at = np.minimum(np.searchsorted(pairs, u * size + v), len(pairs) - 1)
        # The start is no symbol's next; the count of a pair that may end a text is more than the context's total.
        total = np.where(pairs[at] == u * size + v, self.counts[at], np.iinfo(np.int64).max)
        behind = self.total[grams.pair[heads]]
        seldom = (total <= 1) & (np.log((behind + 2 * PARENT_WEIGHT) / (1 + PARENT_WEIGHT)) < GAIN_PER_SYMBOL + GAIN_ONCE - 1e-6)
        own = np.bincount(context, grams.counts).astype(np.int64) == total
        known = ~_retained(context, grams.counts, self.chance[grams.pair])[1]
        return np.flatnonzero((self.kept[grams.pair[heads]] & ~seldom & ~(own & known))[context])


def _gram_cut(grams: Grams, buckets: int, pairs: Pairs) -> Cut:
    return Cut(grams, buckets, pairs.open_rows(grams), (grams.v, grams.u), grams.w)


def _ask_grams(buckets: int):
    def work(ids, texts, answers):
        grams = Grams(Tokens(ids, texts), Root.unpacked(_note(answers)))
        pairs = Pairs(grams, buckets, answers)
        return _gram_cut(grams, buckets, pairs).asked(grams.counts, pairs.total[grams.pair], pairs.counts[grams.pair])

    return work


def _note(answers: dict[int, bytes]) -> bytes:
    return next(data for b, data in answers.items() if b < 0)


def gram_logs(grams: Grams, buckets: int, paired: dict[int, bytes], answers: dict[int, bytes]) -> np.ndarray:
    """log10 P(w | longest retained suffix of u v) of a block's (v, u, w), from both answers."""
    pairs = Pairs(grams, buckets, paired)
    chance = pairs.chance[grams.pair]
    kept, total, counts = _gram_cut(grams, buckets, pairs).told(answers)
    return np.log10(np.where(kept, inside(counts, total, chance), chance))


RESULT = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, *, block_bytes: int = exchange.BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is the end token alone.  Equal rows are learned from and
    scored one by one.  A row without doc_id is held out.  Other columns are
    ignored.  An empty table gives no rows.
    """
    texts, buckets = exchange.dealt(docs.select("doc_id", "text"), block_bytes=block_bytes)
    counted = exchange.answer(exchange.ask(texts, _ask_counts(buckets)), _answer_counts)
    paired = exchange.answer(exchange.ask(texts, _ask_pairs(buckets), counted), _answer_contexts(1))
    modelled = exchange.answer(exchange.ask(texts, _ask_grams(buckets), paired), _answer_contexts(2))
    # Blocks need both answers again; those about pairs come from the same shuffle a second time, which is less than a note through two.
    both = modelled.union(paired.withColumn("bucket", F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.col("bucket") + buckets)))

    def work(ids, texts, answers, table):
        tokens = Tokens(ids, texts)
        root = Root.unpacked(_note(answers))
        grams = Grams(tokens, root)
        logs = gram_logs(grams, buckets, {b - buckets: data for b, data in answers.items() if b >= buckets}, answers)
        own = np.where(root.often, 0.0, np.log10(root.shares / root.rare))
        scores = logs[grams.inverse] + own[tokens.stream]
        base = np.log10(root.shares)[tokens.stream]
        known = (root.counts > 0)[tokens.stream].astype(np.int64)
        return {
            "doc_id": table.column("doc_id"),
            "held_out": (~tokens.training).tolist(),
            "n_tokens": tokens.sizes.tolist(),
            "n_known": np.add.reduceat(known, tokens.starts).tolist(),
            "train_tokens": [root.tokens] * len(ids),
            "base_score": np.add.reduceat(base, tokens.starts).tolist(),
            "score": np.add.reduceat(scores, tokens.starts).tolist(),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return exchange.finish(texts, both, work, f"doc_id {kind}, {RESULT}")
