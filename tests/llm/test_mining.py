"""Phrase mining, hard negatives and sentence pieces against brute force, the SQL and the library."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import hard_negatives, phrases, sentence_pieces
from riskloom.llm.queries import NEGATIVES_SQL, PHRASES_SQL, piece_model

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = " \t\n▁ab1.,;'\"<>\\/(){}[]éß한국😀\x00　�́-_=+#"


# Hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    good = [(i, n, [math.floor(256 * x) for x in v], label) for n, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for i, n, q, label in good:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, w)), j is None, j or 0, m, other) for j, m, w, other in good)
        near = [s for s in scored if s[4] == label and s[3] != n][:positives]
        for s, unknown, j, m, _ in near:
            inside = [t for t in scored if t[4] != label and 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            found += [(i, None if unknown else j, r, None if t[1] else t[2], -s, -t[0]) for r, t in enumerate(inside, 1)]
    return sorted(found, key=repr)


def vectors_table(spark, rows):
    schema = "vec_id bigint, embedding array<float>, label int, rank string, score string, uid int, cell int"
    made = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], schema).repartition(5)
    return made.selectExpr("*", "vec_id % 100 = 0 as is_anchor")


def float32(rng, n):
    return [float(np.float32(x)) for x in rng.normal(0.02, 0.3, n)]


def test_negatives_equal_brute_force_on_edges(spark, corpus, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, float32(rng, 9), int(rng.integers(3))) for i in range(260)]
    same = float32(rng, 9)
    rows += [(1000 + i, same, i % 3) for i in range(90)]  # one vector, many rows: ties
    rows += [(100, rows[100][1], rows[100][2])] * 2  # repeated anchors
    rows += [(None, same, 1), (None, float32(rng, 9), None), (2000, None, 1), (2100, [0.5, None] * 4, 1), (2200, [math.nan] * 9, 2), (2300, [math.inf] * 9, 2), (2400, [], 1), (2500, same[:4], 0)]
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 3)
    got = hard_negatives.mine_hard_negatives(vectors_table(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_negatives(rows)


def test_negatives_of_an_empty_table(spark, corpus):
    assert hard_negatives.mine_hard_negatives(vectors_table(spark, [])).collect() == []


def test_residue_scores_are_exact():
    rng = np.random.default_rng(5)
    for scale, width in ((100, 64), (30_000, 300), (2**40, 7), (2**120, 3)):
        a, b = (np.floor(rng.normal(0, scale, (n, width))) for n in (4, 6))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert hard_negatives.Scorer(a).scores(b, slice(0, 4)).tolist() == want


def test_scores_travel_in_order():
    numbers = sorted([0, -1, 1, 2**70, -(2**70), 255, 256, -(2**286)])
    texts = [hard_negatives.as_text(n) for n in numbers]
    assert texts == sorted(texts) and [hard_negatives.from_text(t) for t in texts] == numbers


def test_negatives_sql(spark, corpus, tiny):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tiny}/embeddings.parquet'")
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert sorted(con.execute(NEGATIVES_SQL).fetchall(), key=repr) == brute_negatives(rows)


# Phrases


def brute_phrases(rows, top=2000, longest=3, least=10):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    found = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = defaultdict(int)
        for p, a in wanted.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    around[p[i : i + n]] = max(around[p[i : i + n]], a)
        rows_ = []
        for p, a in wanted.items():
            if 100 * around[p] >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def phrase_rows(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, phrase string, n int").repartition(4)
    return sorted(tuple(r) for r in phrases.mine_phrases(table, **options).drop("first").collect())


def test_phrases_equal_brute_force(spark, corpus, edge_rows):
    rng = random.Random(6)
    words = ["The", "the", "of", "new", "YORK", "york", "city", "É", "한", "a-b", "x" * 70]
    rows = [(i, t, rng.choice(["en", None, ""])) for i, t in edge_rows]
    for i in range(60):
        rows.append((100 + i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for _ in range(150)), rng.choice(["en", "de", None])))
    assert phrase_rows(spark, rows) == brute_phrases(rows)
    assert phrase_rows(spark, rows, top=7) == brute_phrases(rows, top=7)
    assert phrase_rows(spark, rows, longest=4, least=4) == brute_phrases(rows, longest=4, least=4)


def test_phrases_survive_collisions_and_a_full_table(spark, corpus, monkeypatch):
    rows = [(i, "a b c d. b a d c. a c b d", "en") for i in range(12)]
    want = brute_phrases(rows)
    assert phrase_rows(spark, rows) == want
    # all words of a length get one hash, all n-grams pass the table of marks
    salts = np.zeros(1, np.uint64)
    words = phrases.Words([rows[0][1].encode()], salts, phrases.Polynomials())
    words.hashes[:] = 7
    ids = words.exact_ids()
    texts = [words.data[a:b] for a, b in zip(words.starts, words.ends)]
    assert all((ids[i] == ids[j]) == (texts[i] == texts[j]) for i in range(len(ids)) for j in range(len(ids)))


def test_fingerprints_travel_packed():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 64, 300_000, np.uint64)
    batch = phrases._summed([prints, prints[:1000]], 7)
    assert sum(len(d.as_py()) for d in batch.column("data")) < 4 * len(prints)
    found, counts = (np.concatenate(c) for c in zip(*(phrases.unpacked(d.as_py()) for d in batch.column("data"))))
    want, n = np.unique(np.concatenate([prints, prints[:1000]]) >> np.uint64(64 - phrases.SENT_BITS), return_counts=True)
    assert (found == want).all() and (counts == n).all()


def test_frequent_fingerprints_are_all_marked(spark, corpus):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(200)]
    table = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(5)
    got = {r["place"] for r in phrases._frequent(table, 1, 300, None, 64).collect()}
    counts = Counter(" ".join(texts).split())
    salts = np.array([phrases.hash_text("en")], np.uint64)
    often = phrases.Words([" ".join(sorted(w for w, c in counts.items() if c >= 300)).encode()], salts, phrases.Polynomials())
    want = np.concatenate(phrases.Marks.places(often.grams(1)[1])).view(np.int64)
    assert 0 < len(want) < 52 and got == set(want.tolist())


def test_phrases_around_rare_parts_are_not_written_out(spark, corpus):
    class Marked:
        value = np.zeros(1 << (phrases.MARK_BITS - 6), np.uint64)

    salts = np.array([phrases.hash_text("en")], np.uint64)
    words = phrases.Words([b"a b c"], salts, phrases.Polynomials())
    # a, b, c, a b and a b c are marked, b c is not
    for at in np.concatenate([x for f, n in (([0, 1, 2], 1), ([0], 2), ([0], 3)) for x in phrases.Marks.places(words.prints(np.array(f), n))]):
        place = int(at) >> (64 - phrases.MARK_BITS)
        Marked.value[place >> 6] |= np.uint64(1 << (place & 63))
    table = spark.createDataFrame([(1, "a b c", "en")], "doc_id bigint, text string, lang string")
    assert {r["phrase"] for r in phrases._written_out(table, 3, Marked).collect()} == {None, "a", "b", "c", "a b"}


def test_phrases_travel_sorted_and_packed(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Ünï", "c"]) for _ in range(40)) for _ in range(300)]

    class Marked:
        value = np.full(1 << (phrases.MARK_BITS - 6), ~np.uint64(0))

    table = spark.createDataFrame([(None if i % 7 == 0 else i, t, "e\nn" if i % 2 else "") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(5)
    want = defaultdict(lambda: [0, []])
    for i, t in enumerate(texts):
        words = t.translate(LOWER).split()
        for n in (1, 2, 3):
            for at in range(len(words) - n + 1):
                entry = want["e\nn" if i % 2 else "", " ".join(words[at : at + n])]
                entry[0] += 1
                entry[1] += [i] if i % 7 else []
    got = {(r["lang"], r["phrase"]): (r["n"], r["doc_id"]) for r in phrases._written_out(table, 3, Marked, 7).collect() if r["phrase"]}
    assert got == {k: (n, min(ids, default=None)) for k, (n, ids) in want.items()}
    keys = pa.array(sorted(f"en\n{a} {b} {c}" for a in want for b in "xyz" for c in range(20)), pa.large_string())
    rows = pa.table([keys, pa.array(np.arange(len(keys))), pa.array([None, *range(1, len(keys))], pa.int64())], ["key", "n", "doc_id"])
    sent = phrases._listed(*(rows.column(c).combine_chunks() for c in rows.column_names))
    assert sum(map(len, sent)) < 0.3 * rows.nbytes and phrases._unlisted(*sent).equals(rows)


def test_phrases_of_an_empty_table(spark, corpus):
    assert phrase_rows(spark, []) == []
    assert phrase_rows(spark, [(1, None, None), (None, "", "en")]) == []


def test_fingerprints_do_not_depend_on_place_or_run(monkeypatch):
    texts = [b"one two  three", b"x one\ttwo three. one two"]
    salts = np.zeros(2, np.uint64)
    whole = phrases.Words(texts, salts, phrases.Polynomials())
    monkeypatch.setattr(phrases, "RUN_BYTES", 4)
    cut = phrases.Words(texts, salts, phrases.Polynomials())
    for n in (1, 2, 3):
        first, prints = whole.grams(n)
        assert (cut.grams(n)[1] == prints).all()
        grams = [b" ".join(whole.data[whole.starts[i + k] : whole.ends[i + k]] for k in range(n)) for i in first]
        assert all((prints[i] == prints[j]) == (grams[i] == grams[j]) for i in range(len(grams)) for j in range(len(grams)))


def test_phrases_sql(spark, corpus, tiny):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tiny}/documents.parquet'")
    rows = con.execute("select doc_id, text, lang from documents").fetchall()
    assert sorted(con.execute(PHRASES_SQL).fetchall()) == brute_phrases(rows)


# Sentence pieces


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.PieceEncoder(piece_model())


def test_pieces_equal_the_library(pieces, edge_rows):
    rng = random.Random(7)
    vocabulary = list(pieces.ids)
    texts = [t or "" for _, t in edge_rows]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdef0123456789+/") for _ in range(30_000)), " " * 5001 + "a" * 5001, "é" * 3000, "<s></s><unk><0x41>"]
    assert all(pieces.encode(t) == ids for t, ids in zip(texts, pieces.library.encode(texts)))


def test_heap_and_scanned_agendas_agree(pieces, monkeypatch):
    rng = random.Random(8)
    runs = ["".join(rng.choice("etaoinshr ") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    scanned = [pieces.agenda(r) for r in runs]
    monkeypatch.setattr(sentence_pieces, "LONG_RUN", 0)
    assert [pieces.agenda(r) for r in runs] == scanned


def test_forgetting_changes_nothing(pieces, monkeypatch):
    text = " ".join(f"word{i} x{i}y" for i in range(400))
    want = pieces.library.encode(text)
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 5)
    assert pieces.encode(text) == want and pieces.encode(text) == want


def test_piece_digests(spark, corpus, pieces, edge_rows):
    got = sentence_pieces.encoding_digests(corpus(edge_rows, clashing=True), piece_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, text in edge_rows:
        ids = pieces.library.encode(text or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(pieces.library.decode(ids)), True))
    found = [tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees").collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    whole = sentence_pieces.encode_pieces(corpus([(1, "a b"), (2, None)]), piece_model()).orderBy("doc_id").collect()
    assert [(r["piece_ids"], r["decoded"]) for r in whole] == [(pieces.library.encode("a b"), "a b"), ([], "")]
    assert sentence_pieces.encoding_digests(corpus([]), piece_model()).collect() == []


def test_chunks_of_an_older_generation_keep_their_ids(monkeypatch):
    from riskloom.llm import token_ids
    from riskloom.llm.queries import default_tokenizer

    texts = [" ".join(f"word{i * k} don't É{k}" for i in range(30)).encode() for k in range(12)]
    monkeypatch.setattr(token_ids, "REMEMBERED", 45)
    own = token_ids.TextEncoder(default_tokenizer())
    assert [ids for t in texts * 2 for ids in own.encode_texts([t])] == own.whole([t.decode() for t in texts * 2])
