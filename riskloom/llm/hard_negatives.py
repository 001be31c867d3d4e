"""Hard negatives by exact integer scores from a residue-number-system matrix product.

Components are integers.  They are taken modulo a few small primes, centred,
multiplied as float32 matrices (no partial sum reaches 2**24, so every residue
is exact), and the signed scores follow from the residues by Chinese
remaindering.  As many primes are used as the largest possible score needs.

Anchors are dealt into groups of bounded size, rows into groups that a task
streams through; a cell is one group of each.  A cell's task keeps its anchors
and the best rows so far, never the scores.  First the positives of every anchor
are found, then the negatives inside the window that each positive opens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.session import stage

#: Components times this, rounded down, are the integers that are multiplied.
SCALE = 256
#: The primes of the residue system, largest first; further ones follow downwards.
FIRST_PRIME = 1021
#: A float32 sum is exact below this.
EXACT = 1 << 24
#: Float32 bytes of one group's anchors.
ANCHOR_BYTES = 8 << 20
#: Anchors of a group at most, however short their vectors are.
GROUP_ANCHORS = 16_384
#: Rows of a group at most.
GROUP_ROWS = 4_000_000
#: Scores that a task holds at a time, and anchors among them.
TILE, TILE_ANCHORS = 1 << 21, 512
#: A negative scores at least and at most these percentages of its positive.
WINDOW = (30, 90)
#: Scores travel as hexadecimal text of one width, which sorts as they do; no float32 vectors reach this.
ZERO, DIGITS = 1 << 287, 72

#: What a cell tells of an anchor's rows; ``wanted`` is the positive score whose window they are in.
FOUND = "anchor_uid bigint, anchor_id bigint, wanted string, ordered string, score bigint, vec_id bigint, uid bigint"
ANCHOR, ROW = 0, 1


def primes() -> Iterator[int]:
    """Odd primes from ``FIRST_PRIME`` downwards."""
    for p in range(FIRST_PRIME, 2, -2):
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            yield p


def system(bound: int) -> list[int]:
    """Primes whose product exceeds twice ``bound``, so that scores of either sign are told apart."""
    chosen, product = [], 1
    for p in primes():
        chosen.append(p)
        product *= p
        if product > 2 * bound + 1:
            return chosen
    raise OverflowError("the vectors are too long and large for the residue system")


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Centred residues of integers held as doubles, as float32; ``fmod`` is exact at any size."""
    rest = np.fmod(values, p)
    half = p // 2
    rest[rest > half] -= p
    rest[rest < -half] += p
    return rest.astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` (from 0 to p-1, int64); dimensions are cut so that every float32 sum is exact."""
    step = max(1, (EXACT - 1) // (p // 2) ** 2)
    total = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], step):
        total += (a[:, at : at + step] @ b[:, at : at + step].T).astype(np.int64)
    return np.mod(total, p)


def reconstruct(parts: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Signed integers from their residues: mixed-radix digits, int64 where the product allows it, else Python integers."""
    product = int(np.prod([int(p) for p in moduli], dtype=object))
    wide = product >= 1 << 62
    value = parts[0].astype(object) if wide else parts[0].copy()
    radix = moduli[0]
    for part, p in zip(parts[1:], moduli[1:]):
        digit = np.mod((part - np.mod(value, p).astype(np.int64)) * pow(radix, -1, p), p)
        value += radix * (digit.astype(object) if wide else digit)
        radix *= p
    return np.where(value > product // 2, value - product, value)


class Scorer:
    """Exact scores of one group of anchors against any rows."""

    def __init__(self, anchors: np.ndarray):
        self.anchors = anchors
        self.largest = self.square(anchors)
        self.known: dict[int, np.ndarray] = {}

    @staticmethod
    def square(vectors: np.ndarray) -> int:
        """No squared length exceeds this."""
        top = int(np.abs(vectors).max(initial=0.0))
        if top < 1 << 20:
            return int((vectors * vectors).sum(axis=1).max(initial=0.0) * (1 + 1e-9)) + 1
        return top * top * max(1, vectors.shape[1])

    def scores(self, rows: np.ndarray, which: slice) -> np.ndarray:
        """Scores of the anchors ``which`` (axis 0) with ``rows`` (axis 1)."""
        width = min(rows.shape[1], self.anchors.shape[1])
        larger = max(self.largest, self.square(rows))
        moduli = system(larger)
        parts = []
        for p in moduli:
            if p not in self.known:
                self.known[p] = residues(self.anchors.copy(), p)
            parts.append(residue_product(self.known[p][which, :width], residues(rows[:, :width].copy(), p), p))
        return reconstruct(parts, moduli)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Integer components as doubles; shorter vectors are filled with zeros."""
    ends = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(ends.max(initial=0))
    if (ends == width).all():
        return flat.reshape(len(ends), width)
    made = np.zeros((len(ends), width))
    made[np.arange(width) < ends[:, None]] = flat
    return made


def as_text(score: int) -> str:
    return f"{score + ZERO:0{DIGITS}x}"


def from_text(text: str) -> int:
    return int(text, 16) - ZERO


class Leaders:
    """The ``k`` best rows met so far: higher scores first, ties by smaller vec_id (nulls last), then by row."""

    def __init__(self, k: int):
        self.k = k
        self.kept: list[tuple] = []

    def offer(self, scores: np.ndarray, columns: np.ndarray, ids: list, uids: list) -> None:
        """Rows ``columns`` of a tile whose rows stand in the order of ties."""
        k = self.k
        if len(self.kept) == k:
            may = scores >= -self.kept[-1][0]
            scores, columns = scores[may], columns[may]
        if len(scores) > 4 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            above, level = np.flatnonzero(scores > cut), np.flatnonzero(scores == cut)
            take = np.concatenate([above, level[: k - len(above)]])
            scores, columns = scores[take], columns[take]
        if len(scores):
            new = [(-s, ids[c] is None, ids[c] or 0, uids[c]) for s, c in zip(scores.tolist(), columns.tolist())]
            self.kept = sorted(self.kept + new)[:k]


class Cell:
    """The anchors of one cell, and what is best for each of their slots among the rows met so far."""

    def __init__(self, anchors: pa.RecordBatch, k: int):
        self.uids, self.ids = anchors.column("uid").to_pylist(), anchors.column("vec_id").to_pylist()
        self.labels = anchors.column("label").to_numpy()
        self.scorer = Scorer(matrix(anchors.column("embedding")))
        self.leaders = [{w: Leaders(k) for w in wanted or []} for wanted in anchors.column("wanted").to_pylist()]
        self.windows = [{w: (-(-WINDOW[0] * from_text(w) // 100), WINDOW[1] * from_text(w) // 100) for w in slots if w} for slots in self.leaders]

    def meet(self, rows: pa.RecordBatch) -> None:
        ids, uids = rows.column("vec_id").to_pylist(), rows.column("uid").to_pylist()
        order = sorted(range(len(uids)), key=lambda i: (ids[i] is None, ids[i] or 0, uids[i]))
        labels, vectors = rows.column("label").to_numpy()[order], matrix(rows.column("embedding"))[order]
        ids, uids = [ids[i] for i in order], [uids[i] for i in order]
        anchors = min(len(self.uids), TILE_ANCHORS)
        for at in range(0, len(uids), TILE // anchors):
            cut = slice(at, at + TILE // anchors)
            for first in range(0, len(self.uids), anchors):
                self.tile(first, self.scorer.scores(vectors[cut], slice(first, first + anchors)), labels[cut], ids[cut], uids[cut])

    def tile(self, first: int, scores: np.ndarray, labels: np.ndarray, ids: list, uids: list) -> None:
        here = dict(zip(uids, range(len(uids))))
        same = {label: np.flatnonzero(labels == label) for label in set(self.labels[first : first + len(scores)].tolist())}
        other = {label: np.flatnonzero(labels != label) for label in same}
        for at, row in enumerate(scores, first):
            label, slots, windows = self.labels[at], self.leaders[at], self.windows[at]
            if "" in slots:
                columns = same[label]
                if self.uids[at] in here:
                    columns = columns[columns != here[self.uids[at]]]
                slots[""].offer(row[columns], columns, ids, uids)
            if windows:
                columns = other[label]
                own = row[columns]
                for wanted, (low, high) in windows.items():
                    inside = np.flatnonzero((own >= low) & (own <= high))
                    slots[wanted].offer(own[inside], columns[inside], ids, uids)

    def found(self) -> dict[str, list]:
        rows = [
            (uid, vec_id, wanted, as_text(-worst), -worst if -(1 << 63) <= -worst < 1 << 63 else None, None if unknown else other, row)
            for uid, vec_id, slots in zip(self.uids, self.ids, self.leaders)
            for wanted, leaders in slots.items()
            for worst, unknown, other, row in leaders.kept
        ]
        return dict(zip([f.split()[0] for f in FOUND.split(", ")], [list(c) for c in zip(*rows)] or [[] for _ in range(7)]))


def _cells(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[dict[str, list]]:
    """Batches sorted by (cell, kind): a cell's anchors are gathered, its rows met batch by batch."""
    number, anchors, cell = None, [], None
    for batch in batches:
        cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        edges = (np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1).tolist()
        for start, end in zip([0, *edges], [*edges, batch.num_rows]):
            if cells[start] != number:
                if cell is not None:
                    yield cell.found()
                number, anchors, cell = cells[start], [], None
            if kinds[start] == ANCHOR:
                anchors.append(batch.slice(start, end - start))
            elif anchors or cell is not None:
                if cell is None:
                    cell, anchors = Cell(pa.concat_batches(anchors), k), []
                cell.meet(batch.slice(start, end - start))
    if cell is not None:
        yield cell.found()


def best_rows(rows: DataFrame, anchors: DataFrame, groups: tuple[int, int], k: int) -> DataFrame:
    """The ``k`` best rows for every anchor and every entry of its ``wanted`` (empty text: rows of its label, itself apart)."""
    row_groups, anchor_groups = groups
    spread_rows = rows.withColumn("own", F.pmod(F.xxhash64("uid"), F.lit(row_groups))).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(anchor_groups - 1)), lambda other: F.col("own") * anchor_groups + other)).alias("cell"), F.lit(ROW).alias("kind"), "uid", "vec_id", "label", "embedding", F.lit(None).cast("array<string>").alias("wanted")
    )
    spread_anchors = anchors.withColumn("own", F.pmod(F.xxhash64("uid"), F.lit(anchor_groups))).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(row_groups - 1)), lambda other: other * anchor_groups + F.col("own"))).alias("cell"), F.lit(ANCHOR).alias("kind"), "uid", "vec_id", "label", "embedding", "wanted"
    )
    target = rows.sparkSession.createDataFrame([], FOUND).schema
    arrow = to_arrow_schema(target)

    def run(batches):
        for found in _cells(batches, k):
            yield pa.RecordBatch.from_pydict(found, schema=arrow)

    met = spread_anchors.unionByName(spread_rows).repartition(row_groups * anchor_groups, "cell").sortWithinPartitions("cell", "kind").mapInArrow(run, target)
    order = Window.partitionBy("anchor_uid", "wanted").orderBy(F.desc("ordered"), F.asc_nulls_last("vec_id"), "uid")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding, an integer label, and ``is_anchor``; other
    columns are ignored.  For the ``positives`` best other rows of an anchor's
    label: the ``negatives`` best rows of other labels whose score lies in
    ``WINDOW`` of the positive's.

    Rows with a null label, a null vector, or a null or non-finite component take
    no part.  Repeated rows are rows of their own, also as positives of each
    other.  A null vec_id takes part and comes last among ties; a null
    ``is_anchor`` is no anchor.  Missing components of shorter vectors count as
    zero.  A score beyond 64 bits is ordered and compared exactly, but returned
    as null.  An empty table gives an empty result.
    """
    usable = F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = stage(
        vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
        .where(usable)
        .withColumn("uid", F.monotonically_increasing_id()),
        "vectors",
    )
    n_rows, n_anchors, width = rows.agg(F.count("*"), F.count_if("is_anchor"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    anchor_groups = max(1, -(-n_anchors // max(1, min(GROUP_ANCHORS, ANCHOR_BYTES // (4 * max(1, width))))))
    cells = 4 * rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_rows // GROUP_ROWS), min(-(-cells // anchor_groups), n_rows // 1024)), anchor_groups
    anchors = rows.where("is_anchor")
    near = stage(best_rows(rows, anchors.withColumn("wanted", F.array(F.lit(""))), groups, positives), "positives")
    wanted = near.groupBy(F.col("anchor_uid").alias("uid")).agg(F.collect_set("ordered").alias("wanted"))
    far = best_rows(rows, anchors.join(wanted, "uid"), groups, negatives)
    pairs = near.select("anchor_uid", "anchor_id", F.col("ordered").alias("wanted"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(far.select("anchor_uid", "wanted", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_uid", "wanted"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
