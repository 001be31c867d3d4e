"""Near-duplicate documents by a MinHash LSH forest.

Signatures are sorted in several orders, each by its own sequence of hash
functions.  Rows that share a long enough prefix of an order, a run, are to be
compared unless a component holds both.  Neighbours in the order come first, and
then hubs: a row that has a candidate inside a component is compared with the
members nearest to the component's modal signature, as copies of one original
differ most from each other and least from the original.  Both only save work:
afterwards all rows of different components are compared in runs of bounded
size, and the rows of larger runs meet by an exact prefix filter on their rarest
shingles (``dense_candidates``).  Candidates are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.components import connected
from riskloom.llm.text import map_slices, slices
from riskloom.session import stage

SHINGLE_WORDS = 5
#: Percent of the union that two sets must share, where a caller asks for nothing else.
SIMILARITY = 85
FUNCTIONS = 128
ORDERS = 20
DEPTH = 8  # values of an order's key
MIN_DEPTH = 4  # values that candidates share
NEXT_ROWS = 2  # rows after a row that it is compared with
HUBS = 3
#: Rows of a run, or of a shingle's list, up to which all pairs are compared; beyond, the exact filter takes over.
RUN_ROWS = 64
#: Word hashes that a worker remembers.
REMEMBERED = 300_000

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint32)
ORDER_FUNCTIONS = [_rng.permutation(FUNCTIONS)[:DEPTH].tolist() for _ in range(ORDERS)]
_word_hashes: dict[bytes, int] = {}


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; one for a shorter text, none for one without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_word_hashes) > REMEMBERED:
        _word_hashes.clear()
    for word in words:
        if word not in _word_hashes:
            _word_hashes[word] = xxhash.xxh64_intdigest(word)
    codes = np.array([_word_hashes[w] for w in words], np.uint64)
    span = min(SHINGLE_WORDS, len(codes))
    size = len(codes) - span + 1
    made = np.full(size, len(codes) if span < SHINGLE_WORDS else 0, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            made = (made ^ codes[k : k + size]) * np.uint64(0x9FB21C651E98DF25)
            made ^= made >> np.uint64(31)
    return np.unique(made)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function over the set."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    made = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(folded), 1024):
            part = folded[at : at + 1024]
            made = np.minimum(made, ((part[None, :] ^ _SHIFTS[:, None]) * _FACTORS[:, None]).min(axis=1))
    return made


def least_shared(similarity: int) -> int:
    """Shared signature values below which a pair is not confirmed: a similar pair is over four deviations away (92 at 85 %)."""
    share = similarity / 100
    return int(FUNCTIONS * share - 4.1 * (FUNCTIONS * share * (1 - share)) ** 0.5)


def linked(a: np.ndarray, b: np.ndarray, similarity: int = SIMILARITY) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= similarity * (len(a) + len(b) - shared) and shared > 0


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, signature) per row; digest and signature are null for an empty set."""

    def work(rows, texts):
        made = {"doc_id": rows.column(0), "n_shingles": [], "digest": [], "signature": []}
        for text in texts:
            shingles = shingle_set(text)
            made["n_shingles"].append(len(shingles))
            made["digest"].append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            made["signature"].append(signature(shingles).astype(">u4").tobytes() if len(shingles) else None)
        return made

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), work, "doc_id bigint, n_shingles bigint, digest binary, signature binary")


def _neighbours(keys: list[bytes], ids: list[int], orders: list[int]) -> tuple[list[int], list[int]]:
    """Pairs of rows up to ``NEXT_ROWS`` apart that share their order and the first ``MIN_DEPTH`` values."""
    if len(keys) < 2:
        return [], []
    grid = np.frombuffer(b"".join(keys), ">u4").reshape(len(keys), DEPTH)
    doc, order = np.array(ids, np.int64), np.array(orders)
    left, right = [], []
    for step in range(1, NEXT_ROWS + 1):
        near = (order[step:] == order[:-step]) & (grid[step:, :MIN_DEPTH] == grid[:-step, :MIN_DEPTH]).all(axis=1)
        left += doc[:-step][near].tolist()
        right += doc[step:][near].tolist()
    return left, right


PAIR = "a bigint, b bigint"


def forest_candidates(classes: DataFrame) -> DataFrame:
    """Candidate pairs a < b of the sorted orders; ``classes`` has doc_id and signature, one row per distinct set."""
    spark = classes.sparkSession
    rows = classes.select(
        "doc_id",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("order"),
                        F.concat(*[F.substring("signature", 4 * k + 1, 4) for k in functions]).alias("key"),
                    )
                    for n, functions in enumerate(ORDER_FUNCTIONS)
                ]
            )
        ).alias("row"),
    ).select("row.order", "row.key", "doc_id")
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = rows.repartitionByRange(width, "order", "key", "doc_id").sortWithinPartitions("order", "key", "doc_id")

    def work(batches):
        held: tuple[list, list, list] = ([], [], [])
        head: list[tuple] = []
        for batch in batches:
            orders, keys, ids = (batch.column(k).to_pylist() for k in range(3))
            if len(head) < NEXT_ROWS:
                head += list(zip(orders, keys, ids))[: NEXT_ROWS - len(head)]
            orders, keys, ids = held[0] + orders, held[1] + keys, held[2] + ids
            left, right = _neighbours(keys, ids, orders)
            pairs = sorted({(min(p), max(p)) for p in zip(left, right)})
            yield _forest_rows([p[0] for p in pairs], [p[1] for p in pairs], [], [], [])
            held = (orders[-NEXT_ROWS:], keys[-NEXT_ROWS:], ids[-NEXT_ROWS:])
        tail = list(zip(*held))
        if head:
            edge = sorted(set(head) | set(tail))
            yield _forest_rows([], [], *zip(*edge))

    found = stage(ordered.mapInArrow(work, f"{PAIR}, order int, key binary, doc_id bigint"), "forest")
    # Rows at the ends of partitions meet their neighbours of the next partition here: a few rows per partition.
    along = Window.partitionBy("order").orderBy("key", "doc_id")
    edges = found.where("a is null").select("order", "key", "doc_id")
    across = [
        edges.select("key", F.col("doc_id").alias("x"), F.lead("doc_id", step).over(along).alias("y"), F.lead("key", step).over(along).alias("other"))
        .where(F.substring("key", 1, 4 * MIN_DEPTH) == F.substring("other", 1, 4 * MIN_DEPTH))
        .where("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        for step in range(1, NEXT_ROWS + 1)
    ]
    pairs = found.where("a is not null and a <> b").select("a", "b")
    for more in across:
        pairs = pairs.union(more)
    return pairs.distinct()


def _forest_rows(a, b, order, key, ids) -> pa.RecordBatch:
    n, m = len(a), len(ids)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*a, *[None] * m], pa.int64()),
            pa.array([*b, *[None] * m], pa.int64()),
            pa.array([*[None] * n, *order], pa.int32()),
            pa.array([*[None] * n, *key], pa.binary()),
            pa.array([*[None] * n, *ids], pa.int64()),
        ],
        names=["a", "b", "order", "key", "doc_id"],
    )


def with_shared(pairs: DataFrame, classes: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Pairs with the number of signature values that both share, where these are ``least_shared`` at least."""
    least = least_shared(similarity)
    left = classes.select(F.col("doc_id").alias("a"), F.col("signature").alias("left"))
    right = classes.select(F.col("doc_id").alias("b"), F.col("signature").alias("right"))

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                grids = [np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u4").reshape(-1, FUNCTIONS) for k in (2, 3)]
                shared = (grids[0] == grids[1]).sum(axis=1)
                kept = pa.array(shared >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(shared, pa.int32()).filter(kept)], names=["a", "b", "shared"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(work, f"{PAIR}, shared int")


def confirmed(pairs: DataFrame, docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(a, b, linked) of pairs, judged on the full sets of both texts."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("left")).join(pairs, "a", "left_semi")
    right = docs.select(F.col("doc_id").alias("b"), "text").join(pairs, "b", "left_semi")

    def work(batches):
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(doc, text):
            if doc not in known:
                known[doc] = shingle_set(text)
                if len(known) > 64:
                    known.popitem(last=False)
            known.move_to_end(doc)
            return known[doc]

        for rows, texts in slices(batches):
            lefts = rows.column(rows.schema.get_field_index("left")).cast(pa.binary()).to_pylist()
            a, b = rows.column(0), rows.column(1)
            told = [linked(of(x, t), of(y, u), similarity) for x, t, y, u in zip(a.to_pylist(), lefts, b.to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(told)], names=["a", "b", "linked"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "text").mapInArrow(work, f"{PAIR}, linked boolean")


def _linked(links: DataFrame) -> DataFrame:
    return links.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _labelled(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with the components of both ends; an end without links is a component of its own."""
    ends = [members.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component")) for x in ("a", "b")]
    joined = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return joined.withColumns({f"{x}_component": F.coalesce(f"{x}_component", x) for x in ("a", "b")})


def hubs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(component, hub): members that share most values with their component's modal signature, of different ranks."""
    signed = members.join(classes.select(F.col("doc_id").alias("node"), "signature"), "node")

    def value(k):
        return F.call_function("substring", F.col("signature"), 4 * k + 1, F.lit(4))

    every = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(FUNCTIONS - 1)), value)).alias("k", "value")
    counted = signed.select("component", every).groupBy("component", "k", "value").agg(F.count("*").alias("n"))
    modal = counted.groupBy("component", "k").agg(F.max(F.struct("n", "value")).alias("top"))
    # One value per function, and one member per number of agreeing values: lists of bounded length.
    modes = modal.groupBy("component").agg(F.collect_list(F.struct("k", F.col("top.value").alias("value"))).alias("modes"))
    agree = F.size(F.filter("modes", lambda m: value(m["k"]) == m["value"]))
    ranked = signed.join(modes, "component").select("component", "node", agree.alias("agree")).groupBy("component", "agree").agg(F.min("node").alias("hub"))
    best = Window.partitionBy("component").orderBy(F.desc("agree"))
    return ranked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= HUBS).select("component", "hub")


def _with_component(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` with the component of doc_id; one without links is a component of its own."""
    joined = rows.join(members.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return joined.withColumn("component", F.coalesce("component", "doc_id"))


def runs(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, run, n): rows that share their order's first ``MIN_DEPTH`` values, in runs of several components.

    Runs of ``NEXT_ROWS`` + 1 rows at most are left out: their rows are all candidates already.
    """
    keys = [F.xxhash64(F.lit(n), *[F.substring("signature", 4 * k + 1, 4) for k in functions[:MIN_DEPTH]]) for n, functions in enumerate(ORDER_FUNCTIONS)]
    rows = _with_component(classes, members).select("doc_id", "component", F.explode(F.array(*keys)).alias("run"))
    sizes = rows.groupBy("run").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    return rows.select("doc_id", "run").join(sizes.where(f"least < most and n > {NEXT_ROWS + 1}").select("run", "n"), "run").select("doc_id", "run", "n")


def pairs_within(rows: DataFrame, group: str) -> DataFrame:
    """Pairs a < b of different components within each group of rows (group, doc_id, component) of bounded size."""
    lists = rows.groupBy(group).agg(F.collect_list(F.struct("doc_id", "component")).alias("rows"))
    each = lists.select(F.explode("rows").alias("x"), "rows")
    later = F.filter("rows", lambda y: (y["doc_id"] > F.col("x.doc_id")) & (y["component"] != F.col("x.component")))
    return each.select(F.col("x.doc_id").alias("a"), F.explode(later).alias("y")).select("a", F.col("y.doc_id").alias("b")).distinct()


def _prefixes(batches, similarity: int):
    """Per set: its rare prefix shingles, its other ones with the place of the first of them, and the digest of all its common shingles."""
    for batch in batches:
        made: dict[str, list] = {n: [] for n in ("rare", "common", "first", "digest")}
        for rows in batch.column(2).to_pylist():
            rows = sorted((r["n"], r["shingle"]) for r in rows)
            least = -(-similarity * len(rows) // 100)
            prefix = rows[: len(rows) - least + 1]
            made["rare"].append([s for n, s in prefix if 1 < n <= RUN_ROWS])
            made["common"].append([s for n, s in prefix if n > RUN_ROWS])
            made["first"].append(len(prefix) - len(made["common"][-1]))
            made["digest"].append(xxhash.xxh3_128_digest(np.array([s for n, s in rows if n > RUN_ROWS], np.int64).tobytes()))
        lists = pa.list_(pa.int64())
        sizes = pa.array([len(r) for r in batch.column(2)], pa.int64())
        columns = [batch.column(0), sizes, pa.array(made["rare"], lists), pa.array(made["common"], lists), pa.array(made["first"], pa.int64()), pa.array(made["digest"], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "rare", "common", "first", "digest"])


def dense_candidates(dense: DataFrame, docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Pairs a < b that connect whatever is linked among ``dense`` (doc_id, component), and pairs to be ruled out.

    Sets are sorted by the number of sets that hold a shingle.  Linked sets x and y
    share a shingle of both their prefixes, the first |x| - ceil(s |x|) + 1.  If a
    rare one is among those, its list is short and all of its pairs are candidates.
    Else x and y share common shingles only.  Of the sets with the same common
    shingles as y, let m be the smallest: it shares as many with x and is no larger
    than y, so x and m are linked as well, and so are y and the smallest one of x's
    kind, and these two.  So sets meet the smallest one of each kind only, where
    both prefixes hold the same common shingle.  Nothing before the first shared
    shingle is shared, so what follows it in the smaller rest must be enough for
    the similarity: pages of one template whose own shingles already differ too
    much do not meet.
    """

    def work(rows, texts):
        ids, owns, every = [], [], []
        for doc, text in zip(rows.column(0).to_pylist(), texts):
            shingles = shingle_set(text)
            ids.append(np.full(len(shingles), doc, np.int64))
            owns.append(np.full(len(shingles), xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).view(np.int64))
            every.append(shingles.view(np.int64))
        return {"doc_id": pa.array(np.concatenate(ids)), "own": pa.array(np.concatenate(owns)), "shingle": pa.array(np.concatenate(every))}

    texts = docs.join(dense.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    postings = map_slices(texts, work, "doc_id bigint, own bigint, shingle bigint").distinct()
    counted = postings.withColumn("n", F.count("*").over(Window.partitionBy("shingle")))
    sets = counted.groupBy("doc_id", "own").agg(F.collect_list(F.struct("n", "shingle")).alias("rows"))
    made = sets.mapInArrow(lambda batches: _prefixes(batches, similarity), "doc_id bigint, size bigint, rare array<bigint>, common array<bigint>, first bigint, digest binary")
    known = stage(made.join(dense, "doc_id"), "prefixes")

    few = pairs_within(known.select("doc_id", "component", F.explode("rare").alias("shingle")).distinct(), "shingle")
    kinds = known.where(F.size("common") > 0).groupBy("digest").agg(F.min(F.struct("size", "doc_id", "component", "common", "first")).alias("m"))

    def by_shingle(rows):
        rest = (F.col("size") - F.col("first") - F.col("at")).alias("rest")
        return rows.select("size", "doc_id", "component", "first", F.posexplode("common").alias("at", "shingle")).select("size", "doc_id", "component", "shingle", rest)

    smallest, shared = by_shingle(kinds.select("m.*")), by_shingle(known)
    # Most sets that hold a shingle are often one component, whose members need not meet: one side is outside of it.
    counts = shared.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("shingle").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("shingle", F.col("main.component").alias("main"))

    def outside(rows):
        return rows.join(main, "shingle").where("component <> main").drop("main")

    pairs = few
    for left, right in ((outside(shared), smallest), (shared, outside(smallest))):
        x, y = left.alias("x"), right.alias("y")
        met = x.join(y, "shingle").where(f"x.component <> y.component and {100 + similarity} * least(x.rest, y.rest) >= {similarity} * (x.size + y.size)")
        pairs = pairs.union(met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")))
    return pairs.distinct()


def near_components(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; links share ``similarity`` percent of their union.

    Equal sets are one class; links between classes are sought among their
    smallest ids.  A null text, an empty one and one without words have an empty
    set and stay alone.  A row without doc_id has no component and is kept; rows
    that share a doc_id are one document.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = stage(sketches(docs), "sketches")
    named = rows.where("doc_id is not null and digest is not null")
    first = named.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("class"))
    members = stage(named.select("doc_id", "digest", "n_shingles").join(first, ["digest", "n_shingles"]).select("doc_id", "class").distinct(), "classes")
    heads = members.where("doc_id = class").select("doc_id")
    classes = stage(named.select("doc_id", "signature").join(heads, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("signature").alias("signature")), "heads")
    # A doc_id with several texts ties their classes.
    several = members.groupBy("doc_id").agg(F.min("class").alias("v"), F.max("class").alias("w")).where("v < w").select("doc_id", "v")
    edges = members.join(several, "doc_id").select(F.col("class").alias("u"), "v")

    pairs = stage(with_shared(forest_candidates(classes), classes, similarity), "pairs")
    # First each document's best candidate; then what is still between components, and their hubs.
    best = (
        pairs.select(F.col("a").alias("x"), "a", "b", "shared")
        .union(pairs.select(F.col("b").alias("x"), "a", "b", "shared"))
        .groupBy("x")
        .agg(F.max(F.struct("shared", -F.col("a"), -F.col("b"))).alias("best"))
        .select((-F.col("best.col2")).alias("a"), (-F.col("best.col3")).alias("b"))
        .distinct()
    )
    links = stage(confirmed(stage(best, "best"), docs, similarity), "links")
    reached = stage(connected(edges.union(_linked(links))), "members")
    for _ in range(2):
        between = stage(_labelled(pairs.select("a", "b"), reached).where("a_component <> b_component"), "between")
        if between.isEmpty():
            break
        towards = (
            between.select(F.col("a").alias("x"), F.col("b_component").alias("component"))
            .union(between.select(F.col("b").alias("x"), F.col("a_component").alias("component")))
            .distinct()
        )
        top = hubs(reached.join(towards.select("component").distinct(), "component", "left_semi"), classes)
        through = towards.join(top, "component").where("x <> hub").select(F.least("x", "hub").alias("a"), F.greatest("x", "hub").alias("b"))
        wanted = stage(between.select("a", "b").union(through).distinct().join(links.select("a", "b"), ["a", "b"], "left_anti"), "wanted")
        more = stage(confirmed(wanted, docs, similarity), "links")
        if more.where("linked").isEmpty():
            break
        links = links.union(more)
        reached = stage(connected(edges.union(_linked(links))), "members")
    # Whatever shares a prefix and is in different components still: short runs as a whole, the rows of long ones by the exact filter.
    open_runs = stage(runs(classes, reached), "runs")
    for long in (False, True):
        held = _with_component(open_runs.where(F.col("n") > RUN_ROWS if long else F.col("n") <= RUN_ROWS), reached)
        if long:
            several = held.groupBy("run").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
            dense = stage(held.join(several, "run", "left_semi").select("doc_id", "component").distinct(), "dense")
            if dense.isEmpty():
                break
            found = dense_candidates(dense, docs, similarity)
        else:
            found = pairs_within(held, "run")
        fresh = found.join(links.select("a", "b"), ["a", "b"], "left_anti")
        more = stage(confirmed(stage(with_shared(fresh, classes, similarity).select("a", "b"), "wanted"), docs, similarity), "links")
        if not more.where("linked").isEmpty():
            links = links.union(more)
            reached = stage(connected(edges.union(_linked(links))), "members")
    groups = members.join(reached.select(F.col("node").alias("class"), "component"), "class", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "class")).alias("component")
    )
    return rows.select("doc_id", "n_shingles").join(groups, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        (F.col("doc_id").isNull() | (F.coalesce("component", "doc_id") == F.col("doc_id"))).alias("kept"),
    )


def without_near_copies(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; columns as they were."""
    gone = near_components(docs, similarity).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
