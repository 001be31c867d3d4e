"""Near duplicates, repeated stretches and the pipeline, against brute force."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from riskloom.llm import id_shards, near_dedup, suffix_dedup
from riskloom.llm.components import connected
from riskloom.llm.suffix_sort import PrefixHashes, equal_runs, merge_sorted


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Components


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert not connected(spark.createDataFrame([], "u bigint, v bigint")).count()


# Near duplicates


def brute_components(rows):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        span = min(5, len(words))
        sets[doc] = {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            union = len(sets[a] | sets[b])
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * union:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"Word{i}" for i in range(2000)]
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A B"), (6, "a b c")]
    hub = [rng.choice(vocabulary) for _ in range(150)]
    rows.append((400, " ".join(hub)))
    # Copies with two words changed are near the original but not near each other.
    for doc in range(401, 460):
        copy = list(hub)
        for at in rng.sample(range(5, 145), 2):
            copy[at] = rng.choice(vocabulary)
        rows.append((doc, " ".join(copy)))
    for doc in range(10, 90):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 30, 80]))]
        rows.append((doc, " ".join(base)))
        if doc % 4 == 0:
            rows.append((doc + 500, "  ".join(base).upper()))
        if doc % 3 == 0:
            base[len(base) // 2] = "changed"
            rows.append((doc + 600, " ".join(base)))
    return rows


def test_near_components_equal_brute_force(corpus):
    rows = near_rows()
    got = rows_of(near_dedup.near_components(corpus(rows, clashing=True)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_components(rows), key=repr)


def template_rows(plain, linked):
    """Pages of one template, pairwise at 80 to 84 %, and pairs of pages at 85 % or more among them."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(200)]
    pages = [template + [f"p{doc}w{i}" for i in range(22)] for doc in range(plain + linked)]
    for doc in range(linked):
        # Half of the original's own words, so the pair shares some of what is rare.
        pages.append(template + [f"p{doc}w{i}" for i in range(11)] + [f"q{doc}w{i}" for i in range(11)])
    ids = rng.sample(range(1, 10_000), len(pages))
    return [(doc, " ".join(page)) for doc, page in zip(ids, pages)]


def test_links_inside_a_template_region_are_found(corpus):
    rows = template_rows(260, 40)
    want = brute_components(rows)
    assert sum(not kept for *_, kept in want) == 40
    assert rows_of(near_dedup.near_components(corpus(rows)), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


def test_pages_that_share_common_shingles_only_meet_the_smallest_of_their_kind(spark, corpus):
    template = [f"t{i}" for i in range(200)]
    # Two kinds (with and without the template's end), own ends of 0 to 45 words: short ones are linked, long ones are not.
    rows = [(doc, " ".join((template if doc % 2 else template[:190]) + [f"p{doc}w{i}" for i in range(doc * 7 % 46)])) for doc in range(300)]
    want = brute_components(rows)
    alone = spark.createDataFrame([(doc, doc) for doc, _ in rows], "doc_id bigint, component bigint")
    pairs = near_dedup.dense_candidates(alone, corpus(rows))
    assert pairs.count() < 300 * 299 / 8
    links = near_dedup.confirmed(pairs, corpus(rows)).where("linked").selectExpr("a u", "b v")
    found = dict(tuple(r) for r in connected(links).collect())
    assert [found.get(doc, doc) for doc, _ in rows] == [component for _, _, component, _ in want]


def test_pages_of_one_template_do_not_all_meet(spark, corpus):
    rows = template_rows(260, 40)
    alone = spark.createDataFrame([(doc, doc) for doc, _ in rows], "doc_id bigint, component bigint")
    pairs = {tuple(r) for r in near_dedup.dense_candidates(alone, corpus(rows)).collect()}
    linked = {(component, doc) for doc, _, component, kept in brute_components(rows) if not kept}
    assert linked <= pairs and len(pairs) < len(rows)


def test_the_stage_takes_near_copies_of_80_percent(spark, corpus):
    rows = template_rows(2, 0)
    assert near_dedup.least_shared(85) == 92 and near_dedup.least_shared(80) < 92
    assert sorted(near_dedup.near_components(corpus(rows)).select("kept").toPandas()["kept"]) == [True, True]
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, corpus(rows), "").collect()] == [min(doc for doc, _ in rows)]


def test_near_copies_of_edge_rows(spark, corpus, edge_rows):
    docs = corpus(edge_rows, clashing=True)
    kept = near_dedup.without_near_copies(docs)
    # 6 and 7 have one text, 12 has it twice; a row without an id stays.
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(i) for i, _ in edge_rows if i not in (7, 12))
    assert not near_dedup.near_components(corpus([])).count()


# Suffix sorting


def test_mergesort_equals_sorted():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 700)
    segment = np.sort(rng.integers(0, 6, 700))
    hashes = PrefixHashes(data)
    order = merge_sorted(hashes, starts, segment, 30)
    want = sorted(range(700), key=lambda i: (segment[i], data[starts[i] : starts[i] + 30].tobytes(), i))
    assert order.tolist() == want
    runs = equal_runs(hashes, starts, segment, order, 30)
    keys = [(segment[i], data[starts[i] : starts[i] + 30].tobytes()) for i in order]
    assert [a == b for a, b in zip(runs, runs[1:])] == [a == b for a, b in zip(keys, keys[1:])]


def test_false_hash_equality_is_noticed():
    hashes = PrefixHashes(np.frombuffer(b"abcdabce", np.uint8))
    hashes.common = lambda a, b, limit: np.full(len(a), limit)
    with pytest.raises(ArithmeticError):
        equal_runs(hashes, np.array([0, 4]), np.zeros(2, int), np.array([0, 1]), 4)


# Repeated stretches


def brute_repeats(rows, span=50):
    first, made = {}, []
    key = [i if i is not None else suffix_dedup.NO_ID for i, _ in rows]
    raw = [(t or "").encode() for _, t in rows]
    for k, text in zip(key, raw):
        for at in range(len(text) - span + 1):
            stretch = text[at : at + span]
            first[stretch] = min(first.get(stretch, k), k)
    for (doc, _), k, text in zip(rows, key, raw):
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - span + 1):
            if first[text[at : at + span]] < k:
                gone[at : at + span] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        made.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(made, key=repr)


def repeat_rows():
    rng = random.Random(9)

    def rand(n, alphabet="abc d"):
        return "".join(rng.choice(alphabet) for _ in range(n))

    base = [rand(400) for _ in range(5)]
    rows = [(None, base[0]), (5, None), (6, ""), (7, "a" * 300), (8, "a" * 49), (9, "a" * 50), (10, "ab" * 100), (11, "x" + "ab" * 60), (12, base[0]), (12, base[0]), (3, base[0] + base[1]), (13, "\x00" * 120), (14, "é" * 120), (15, "\x00" * 60 + "q")]
    for _ in range(80):
        text = ""
        for _ in range(rng.randint(1, 5)):
            source, at = rng.choice(base), rng.randint(0, 350)
            text += source[at : at + rng.randint(20, 200)] + rand(rng.randint(0, 30), "éxyz")
        rows.append((rng.randint(20, 300), text))
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 24, 4_000])
def test_repeats_equal_brute_force(corpus, block_bytes):
    rows = repeat_rows()
    got = rows_of(suffix_dedup.repeated_bytes(corpus(rows, clashing=True), block_bytes=block_bytes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(rows)


def test_cut_texts(corpus, edge_rows):
    shared = "The same passage of well over fifty bytes stands in both of these texts. "
    docs = corpus([*edge_rows, (50, shared + "first"), (51, "é" + shared + "second")], clashing=True)
    cut = suffix_dedup.without_repeats(docs)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == docs.columns and cut.count() == len(edge_rows) + 2
    assert texts[50] == shared + "first" and texts[51] == "ésecond" and texts[1] is None and texts[7] == ""
    assert not suffix_dedup.without_repeats(corpus([])).count()


# Pipeline


def test_pipeline_keeps_clean_and_drops_planted(spark, corpus, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    vocabulary = [f"{a}{b}{c}" for a in ("ta", "mo", "ri", "el") for b in ("ne", "so", "ka") for c in ("l", "rn", "st", "")]

    def prose():
        return "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(12))

    clean = [(i, prose(), "en", "s", 1) for i in range(30)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    planted = [
        (100, clean[0][1], "en", "s", 1),
        (101, clean[1][1].replace(clean[1][1].split()[40], "changed", 1), "en", "s", 1),
        (102, prose() + "\n" + passage, "en", "s", 1),
        (103, "\n".join(" | ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(12)), "en", "s", 1),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(clean + planted, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == {i for i, *_ in clean}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_equal_keys_of_a_shard_share_an_entry():
    arrays = id_shards.index_arrays([None, 3, 3, 9], np.arange(5))
    assert sorted(arrays["rows"].tolist()) == [1, 3] and arrays["nulls"].tolist() == [1, 0, 0, 0]


def test_equal_stretches_are_found_without_comparing_suffixes(monkeypatch):
    monkeypatch.setattr(PrefixHashes, "compare", None)
    random = np.random.default_rng(5)
    keys = np.zeros(300, suffix_dedup._THIRD)
    keys["gram"], keys["doc"] = np.arange(300) % 4, random.permutation(300)
    keys["before"], keys["after"] = suffix_dedup.LEFT, suffix_dedup.RIGHT
    # Few kinds of both ends around a common middle: stretches in common are all, some or none.
    keys["bytes"] = 97
    keys["bytes"][:, :12] = random.integers(97, 123, (9, 12))[random.integers(0, 9, 300)]
    keys["bytes"][:, -12:] = random.integers(97, 123, (9, 12))[random.integers(0, 9, 300)]
    first = {}
    for key in np.sort(keys, order="doc"):
        for at in range(suffix_dedup.WINDOW):
            first.setdefault((key["gram"], at, key["bytes"][at : at + suffix_dedup.SPAN].tobytes()), key["doc"])
    masks = [
        sum(1 << at for at in range(suffix_dedup.WINDOW) if first[key["gram"], at, key["bytes"][at : at + suffix_dedup.SPAN].tobytes()] < key["doc"])
        for key in keys
    ]
    assert suffix_dedup.sorted_masks(keys).tolist() == masks and len(set(masks)) > 2
