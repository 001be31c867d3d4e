"""Operators that judge or encode one text at a time, against brute force."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskloom.llm import decontaminate, id_shards, license_scan, line_quality, packing, suffix_tree_lm, token_ids, toxicity, url_rules
from riskloom.llm.queries import DECONTAMINATION_SQL, URL_RULES, URL_SQL, default_tokenizer

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NO_LABELS = "doc_id bigint, quality int, toxic int"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Quality rules


def brute_base(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = text.split("\n")
    dup = sum(bool(SPACE.search(line)) and line in lines[:i] for i, line in enumerate(lines)) if len(text) < 5000 else None
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_base_counts_equal_brute_force(spark, corpus, edge_rows):
    rows = [*edge_rows, (20, "a b c a b c x | y\n" * 9 + "# $ % & < > *\n\n x \n x \n"), (21, "x y z " * 3)]
    labels = spark.createDataFrame([], NO_LABELS)
    got = rows_of(line_quality.judge_quality(corpus(rows, clashing=True), labels), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, *brute_base(t)) for i, t in rows]
    want = [w if w[4] is not None else (*w[:4], 0, *w[5:]) for w in want]
    assert got == sorted(want, key=repr)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    for n in range(1, 8):
        scores, links = rng.normal(size=n), rng.normal(size=(2, 2))

        def value(labels):
            return sum(s for s, x in zip(scores, labels) if x) + sum(links[a, b] for a, b in zip(labels, labels[1:]))

        best = max(value([code >> k & 1 for k in range(n)]) for code in range(1 << n))
        assert value(line_quality.viterbi(scores.tolist(), links)) == pytest.approx(best)


def test_field_learns_a_planted_rule():
    rng = np.random.default_rng(5)
    good, bad = (12, 60, 0, 0, 0, 1, 45, 0, 12, 1, 0, 0), (3, 20, 6, 2, 0, 1, 9, 0, 3, 0, 0, 0)
    segments = [(label, np.array([bad if label else good] * rng.integers(2, 9))) for label in rng.integers(0, 2, 80)]
    field = line_quality.fit_field(segments)
    scores = lambda m: (line_quality.feature_rows(m) @ field.weights).tolist()
    assert all(set(line_quality.viterbi(scores(m), field.links)) == {label} for label, m in segments)


def test_quality_keeps_prose_and_drops_lists(spark, corpus):
    rng = np.random.default_rng(8)
    prose = "\n".join(" ".join(f"word{k}" for k in rng.integers(0, 900, 11)) + "." for _ in range(12))
    listed = "\n".join(" | ".join(f"item{i}{j}" for j in range(8)) for i in range(12))
    docs = corpus([(1, prose), (2, listed), (3, None)])
    labels = spark.createDataFrame([], NO_LABELS)
    assert [r[0] for r in rows_of(line_quality.judge_quality(docs, labels).where("kept"), "doc_id")] == [1]
    assert rows_of(line_quality.keep_good(docs, labels), "doc_id", "text") == [(1, prose)]


# URL rules


def test_urls_equal_sql(spark, corpus):
    urls = [
        None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.b.Example.NET/en/x?q#f", "http://example.net/de/", "ftp://xnet/", "http://example.com/de", "http://example.com/de/1",
        "http://w.example.com/DE/1", "http://org/fr/", "http://a.org/fr/?x://net/", "a://b://net/", "http://a..net//", "http://" + "a." * 3000 + "net" + "/b" * 3000, "http://net?x", "http://net#/en/",
    ]
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls + urls[:3])], "page_id bigint, url string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, verdict string")
    got = rows_of(url_rules.judge_urls(pages, rules), "page_id", "host", "path", "rule", "verdict")
    duck = duckdb.connect()
    duck.register("pages", pages.toPandas())
    assert got == sorted(duck.execute(f"select page_id, host, path, rule, verdict from ({URL_SQL})").fetchall(), key=repr)


def test_rules_with_partial_paths_and_no_rules(spark, corpus):
    pages = spark.createDataFrame([(1, "http://a.x/docs/page"), (2, "http://a.x/do")], "page_id int, url string")
    rules = spark.createDataFrame([("x", "/do", "block"), ("a.x", "/docs/p", "allow"), ("x", "/do", "allow"), (None, "/", "block")], "rule_host string, rule_path string, verdict string")
    assert rows_of(url_rules.judge_urls(pages, rules), "page_id", "rule", "verdict") == [(1, "a.x/docs/p", "allow"), (2, "x/do", "block")]
    assert rows_of(url_rules.judge_urls(pages, rules.limit(0)), "page_id", "rule", "verdict") == [(1, None, "allow"), (2, None, "allow")]


def test_url_plan_has_no_python(spark, tiny):
    from riskloom.llm.catalog import queries

    plan = queries()["op3_url_filters"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan


# Licenses


def test_license_base_equals_brute_force(spark, corpus, edge_rows):
    rows = [*edge_rows, (30, "Under the MIT license, under the mit-License. CC BY-NC"), (31, "under the mit license version 2 apache license version 2 cc by nc cc by nc")]

    def brute(text):
        words = PLAIN.findall((text or "").translate(LOWER))
        found = sorted((i, label) for phrase, label in license_scan.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))

    table = license_scan.scan_licenses(corpus(rows, clashing=True))
    assert rows_of(table, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted([(i, *brute(t)) for i, t in rows], key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in table.collect())


def test_contained_and_rival_detections_are_suppressed():
    def labels(text):
        return [rule.label for _, _, rule in license_scan.detections(license_scan.normalised(text.encode())[0])]

    assert labels("Licensed under the GNU Lesser General Public License, version 2.1 or later.") == ["lgpl-2.1"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("released under cc by-nc-sa 4.0") == ["cc-by-nc-sa-4.0"]
    assert labels("a house in the public garden") == []
    assert len(license_scan.signature_rules()) > 300


def test_gates_skip_no_detection(monkeypatch):
    names = [(name, versions) for _, _, own, versions in license_scan.FAMILIES for name in own]
    texts = [f"{before}{name} license{after}" for name, versions in names for before in ("", "licensed under the ") for after in ("", *[f" version {v}" for v in versions])]
    texts += [f"{name} {v}" for name, versions in names for v in versions] + [f"spdx license identifier {name}" for name, _ in names]
    texts += ["permission is hereby granted free of charge to any person obtaining a copy", "released into the public domain", "all rights reserved", "copyright 2020"]

    def found():
        return [sorted((s, e, rule.label) for s, e, rule in license_scan.detections(license_scan.normalised(t.encode())[0])) for t in texts]

    gated = found()
    assert [x[2] for x in gated[texts.index("licensed under the expat license")]] == ["mit"]
    assert [x[2] for x in gated[texts.index("asl license version 2 0")]] == ["apache-2.0"]
    assert [x[2] for x in gated[texts.index("creative commons zero 1 0")]] == ["cc0-1.0"]
    ungated = ((b"", license_scan.signature_rules()),)
    monkeypatch.setattr(license_scan, "_rules", lambda: ungated)
    assert found() == gated


# Toxicity


def test_toxicity_learns_and_never_crashes(spark, corpus, edge_rows):
    calm = "the quiet garden lies behind the old house and nobody walks there today"
    rude = "you stupid idiot, you pathetic loser, nobody wants you here"
    rows = [(100 + i, f"{calm} {i} " * 3 + (rude if i % 4 == 0 else "")) for i in range(160)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], NO_LABELS)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(corpus([*rows, *edge_rows[2:]], clashing=True), labels).collect()}
    held = [r for i, r in got.items() if i >= 100 and r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) == int(r["score"] >= 0.3) for r in held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_without_labels(spark, corpus):
    table = toxicity.score_toxicity(corpus([(1, "you idiot you moron"), (2, None), (None, "calm")]), spark.createDataFrame([], NO_LABELS))
    scores = {r["doc_id"]: r["score"] for r in table.collect()}
    assert scores[1] > scores[2] == scores[None] == 0


# Language model


def brute_base_score(rows):
    tokens = [[*SPACE.findall((t or "").translate(LOWER)), None] for _, t in rows]
    learned = Counter(w for (i, _), words in zip(rows, tokens) if suffix_tree_lm.in_training(i) for w in words)
    n, v = sum(learned.values()), len(learned)
    return [(i, not suffix_tree_lm.in_training(i), len(w), sum(learned[x] > 0 for x in w), n, round(sum(math.log10((learned[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for (i, _), w in zip(rows, tokens)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 40_000])
def test_language_model_base_equals_brute_force(corpus, edge_rows, block_bytes):
    table = suffix_tree_lm.score_documents(corpus(edge_rows, clashing=True), block_bytes=block_bytes).collect()
    got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in table], key=repr)
    assert got == sorted(brute_base_score(edge_rows), key=repr)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in table)


def test_context_scores_sum_to_one_and_follow_the_context():
    # Symbols 10 and 11 follow 5 and 6 strictly; 7 says nothing; after 8, the symbol before it decides.
    v, w, counts = (np.array(x) for x in zip((5, 10, 90), (5, 11, 0), (6, 10, 0), (6, 11, 90), (7, 10, 2), (7, 11, 2), (8, 10, 90), (8, 11, 110)))
    one = suffix_tree_lm.pair_scores(v, w, counts, np.full(8, 0.5))
    assert np.abs(one).reshape(4, 2).sum(1) == pytest.approx([1, 1, 1, 1])
    assert one[0] > 0.8 > 0.2 > one[1] > 0 and one[4:].tolist() == [-0.5] * 4
    v, u, w, counts = (np.array(x) for x in zip((5, 1, 10, 90), (5, 1, 11, 0), (7, 1, 10, 2), (7, 1, 11, 2)))
    got = 10 ** suffix_tree_lm.context_scores(v, u, w, counts, np.array([0.9, 0.1, -0.5, -0.5]))
    assert got.reshape(2, 2).sum(1) == pytest.approx([1, 1]) and got[2:].tolist() == [0.5, 0.5]
    v, u, w, counts = (np.array(x) for x in zip((5, 1, 10, 90), (5, 1, 11, 0), (5, 2, 10, 0), (5, 2, 11, 90)))
    got = 10 ** suffix_tree_lm.context_scores(v, u, w, counts, np.full(4, 0.5))
    assert got.reshape(2, 2).sum(1) == pytest.approx([1, 1]) and got[0] > 0.8 and got[3] > 0.8


# Token ids, packing and shards


def test_chunk_encoding_equals_the_library(edge_rows):
    texts = [t or "" for _, t in edge_rows] + ["don't <|endoftext|> I'LL x<|startoftext|>y l'été ×÷ ªº Ÿ ÞÐ straße İstanbul", "ΣΑΣ ο\u0323\u0301 café\u0301s 1234 a_b--c ..."]
    encoder = token_ids.TextEncoder(default_tokenizer())
    assert encoder.by_chunk
    raw = [t.encode() for t in texts]
    assert encoder.encode_texts(raw) == encoder.whole(texts) == encoder.encode_texts(raw)
    encoder.by_chunk = False
    assert encoder.encode_texts(raw, b"\1\0\0\0") == [ids + b"\1\0\0\0" for ids in encoder.whole(texts)]


def library_ids(text):
    return [*token_ids.encoder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("block_pieces", [50_000, 6])
def test_packing_is_whole_and_gapless(corpus, edge_rows, block_pieces):
    table = packing.pack_documents(corpus(edge_rows, clashing=True), default_tokenizer(), block_pieces=block_pieces).toPandas()
    want = []
    for doc, text in edge_rows:
        ids = library_ids(text)
        want += [(doc, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for k, at in enumerate(range(0, len(ids), 4096))]
    named = [(None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in table.itertuples()]
    assert sorted(named, key=repr) == sorted(want, key=repr)
    for _, sequence in table.sort_values("offset").groupby("sequence_id"):
        assert (sequence["offset"].to_numpy() == np.cumsum(sequence["length"]) - sequence["length"]).all() and sequence["length"].sum() <= 4096


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(2)
    lengths, capacity = rng.integers(1, 21, 200), 20
    sequence, offset = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}

    def squares(levels):
        return sum(n * n for g, n in Counter(levels.values()).items() if 0 < g < capacity)

    for at, place, size in zip(sequence.tolist(), offset.tolist(), lengths.tolist()):
        options = [squares(gaps | {b: g - size}) for b, g in gaps.items() if g >= size] + [squares(gaps | {len(gaps): capacity - size})]
        assert place == capacity - gaps.get(at, capacity)
        gaps[at] = gaps.get(at, capacity) - size
        assert squares(gaps) == min(options)
    assert len(gaps) <= 1.1 * math.ceil(lengths.sum() / capacity)


def test_shards_round_trip(spark, corpus, edge_rows, tmp_path):
    rows = [*edge_rows, *((1000 + i, f"text {i}") for i in range(500))]
    manifest = id_shards.write_shards(corpus(rows, clashing=True), str(tmp_path), default_tokenizer(), shard_bytes=50_000)
    got = id_shards.read_shards(manifest).toPandas().sort_values("start")
    assert manifest.count() > 2 and got["start"].tolist() == (np.cumsum(got["n_tokens"]) - got["n_tokens"]).tolist()
    ids = [None if math.isnan(i) else int(i) for i in got["doc_id"]]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    want = sorted(((i, len(library_ids(t)), crc(library_ids(t))) for i, t in rows), key=repr)
    assert sorted(zip(ids, got["n_tokens"], got["ids_crc32"]), key=repr) == want
    readers = [id_shards.ShardReader(r["path"]) for r in manifest.collect()]
    for key in (4, 1000, 1250, 1499):
        found = [r.get(key) for r in readers]
        assert [f.tolist() for f in found if f is not None] == [library_ids(dict(rows)[key])]
    assert all(r.get(77_777) is None for r in readers)


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    perfect = id_shards.PerfectHash.build(keys)
    assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        id_shards.PerfectHash.build(np.array([5, 5], np.uint64))


# Decontamination


def test_decontamination_equals_sql(spark, corpus, edge_rows):
    passage = " ".join(f"Word{i}" for i in range(25))
    rows = [*edge_rows[:8], (40, f"before {passage.upper()} after"), (41, passage[: len(passage) // 2] + " cut"), (42, "short one here"), (43, f"{passage} {passage}"), (44, "Short-One x")]
    items = [(1, passage), (2, "short one"), (3, ""), (4, None), (10, passage), (5, " ".join(passage.split()[9:19])), (6, "none of these words stand anywhere in any text so far")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, items string")
    docs = corpus(rows, clashing=True)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = rows_of(decontaminate.contamination(docs, benchmark), *columns)
    duck = duckdb.connect()
    for name, table in (("documents", rows), ("benchmark", items)):
        key = "doc_id" if name == "documents" else "item_id"
        duck.execute(f"create table {name} ({key} bigint, text varchar)")
        duck.executemany(f"insert into {name} values (?, ?)", table)
    assert got == sorted(duck.execute(f"select {', '.join(columns)} from ({DECONTAMINATION_SQL})").fetchall(), key=repr)
    blocks = decontaminate.find_matches(docs, benchmark, block_bytes=60)
    assert rows_of(blocks.selectExpr("doc_id", "n_words", "size(hit_words) n"), "doc_id", "n_words", "n") == [r[:3] for r in got]
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(r[0]) for r in got if not r[5])


def test_longest_matches():
    tests = decontaminate.TestSuffixes([(1, b"a b c d e f g h i j k")])
    _, _, _, longest = decontaminate.search_shard([b"x a b c d y", b"b c d e f g h i j k"], tests)
    assert dict(zip(tests.windows, longest.tolist())) == {tuple(range(1, 11)): 4, tuple(range(2, 12)): 10}


def test_empty_tables(spark, corpus):
    empty, labels = corpus([]), spark.createDataFrame([], NO_LABELS)
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert not decontaminate.contamination(empty, benchmark).count() and not license_scan.scan_licenses(empty).count()
    assert not line_quality.judge_quality(empty, labels).count() and not toxicity.score_toxicity(empty, labels).count()
    assert not suffix_tree_lm.score_documents(empty).count() and not packing.pack_documents(empty, default_tokenizer()).count()
    assert rows_of(decontaminate.contamination(corpus([(1, "a b")]), benchmark), "doc_id", "n_hit") == [(1, 0)]
