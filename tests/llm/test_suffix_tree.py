"""The suffix tree's scores against brute force, and what its blocks send."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import suffix_tree_lm

ADDED, WEIGHT, LEAST, RARE, START = 0.1, 20.0, 16, "rare", "start"


def brute_scores(rows):
    """doc_id and score of every row, by dictionaries of the whole corpus."""
    tokens = [(i, [w.lower() for w in (t or "").split()] + [None]) for i, t in rows]
    learned = [words for i, words in tokens if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    counts = Counter(w for words in learned for w in words)
    whole = sum(counts.values()) + ADDED * (len(counts) + 1)
    seldom = [c for c in counts.values() if c < LEAST]
    rare = (sum(seldom) + ADDED * (len(seldom) + 1)) / whole

    def share(word):
        return (counts[word] + ADDED) / whole

    def symbols(words):
        return [START, START] + [("word", w) if counts[w] >= LEAST else RARE for w in words]

    def root(symbol):
        return rare if symbol is RARE else share(symbol[1])

    one, two = defaultdict(Counter), defaultdict(Counter)
    for words in learned:
        s = symbols(words)
        for k in range(2, len(s)):
            one[s[k - 1]][s[k]] += 1
            two[s[k - 2], s[k - 1]][s[k]] += 1

    def inside(context, w, parent):
        return (context[w] + WEIGHT * parent) / (sum(context.values()) + WEIGHT)

    def retained(context, parent):
        gain = sum(c * math.log(inside(context, w, parent(w)) / parent(w)) for w, c in context.items())
        return gain > len(context) + 5

    kept = {v for v, c in one.items() if retained(c, root)}
    kept_two = {(u, v) for (u, v), c in two.items() if v in kept and retained(c, lambda w: inside(one[v], w, root(w)))}
    found = []
    for i, words in tokens:
        s, score = symbols(words), 0.0
        for k, word in enumerate(words, 2):
            chance = inside(one[s[k - 1]], s[k], root(s[k])) if s[k - 1] in kept else root(s[k])
            if (s[k - 2], s[k - 1]) in kept_two:
                chance = inside(two[s[k - 2], s[k - 1]], s[k], chance)
            score += math.log10(chance * (share(word) / rare if s[k] is RARE else 1))
        found.append((i, score))
    return found, len(kept), len(kept_two)


@pytest.mark.parametrize("block_bytes", [1 << 24, 6_000])
def test_scores_equal_brute_force(corpus, edge_rows, block_bytes):
    rng = random.Random(4)
    words = [f"W{i}" for i in range(60)]
    rows = [(i, t if t is None or t.isascii() and "\x1c" not in t else "x") for i, t in edge_rows if i != 8]
    for i in range(100, 260):
        at, text = rng.randrange(60), []
        for _ in range(rng.randrange(90)):
            at = rng.choice([(at * 7 + 3) % 60, (at + len(text)) % 60, rng.randrange(60)])
            text.append(words[at] if rng.random() < 0.95 else f"seldom{rng.randrange(400)}")
        rows.append((i, " ".join(text)))
    want, kept, kept_two = brute_scores(rows)
    assert kept > 20 and kept_two > 10
    got = [(r["doc_id"], r["score"]) for r in suffix_tree_lm.score_documents(corpus(rows), block_bytes=block_bytes).collect()]

    def in_order(found):
        return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    assert [i for i, _ in in_order(got)] == [i for i, _ in in_order(want)]
    assert [x for _, x in in_order(got)] == pytest.approx([x for _, x in in_order(want)], rel=1e-10)


def test_packets_are_whole_and_small():
    rng = np.random.default_rng(2)
    columns = [np.cumsum(rng.integers(0, 300, 5000)), rng.integers(0, 3, 5000), np.zeros(0, np.int64), np.zeros(9, np.int64), np.array([(1 << 63) + 5], np.uint64)]
    data = suffix_tree_lm.packed(*columns)
    assert all((a.astype(np.uint64) == b).all() and len(a) == len(b) for a, b in zip(columns, suffix_tree_lm.unpacked(data), strict=True))
    assert len(suffix_tree_lm.packed(suffix_tree_lm._steps(columns[0]), columns[1])) < 3 * 5000
    down = np.array([5, 3, 900, 0, 7])
    assert suffix_tree_lm._unstepped(suffix_tree_lm._steps(down)).tolist() == down.tolist()


def test_blocks_ask_only_about_contexts_that_may_be_retained():
    texts = [b" ".join([b"a b", b"c d"][i % 2] for i in range(40)) + b" " + b" ".join(f"x{k}".encode() for k in range(30)) for _ in range(4)]
    ids = [i for i in range(1, 60) if suffix_tree_lm.in_training(i)][: len(texts)]
    counted = suffix_tree_lm._answer_counts({0: suffix_tree_lm._ask_counts(1)(ids, texts, {})[0]})
    pairs = suffix_tree_lm._ask_pairs(1)(ids, texts, {0: counted[0]})
    told = suffix_tree_lm._answer_contexts(1)({0: pairs[0]})
    answers = {0: told[0], -1: pairs[-1]}
    asked = suffix_tree_lm._ask_grams(1)(ids, texts, answers)
    grams = suffix_tree_lm.Grams(suffix_tree_lm.Tokens(ids, texts), suffix_tree_lm.Root.unpacked(pairs[-1]))
    known = suffix_tree_lm.Pairs(grams, 1, answers)
    # the block is the whole corpus: what it asks about is what is retained
    kept = suffix_tree_lm._gram_cut(grams, 1, known).told({0: suffix_tree_lm._answer_contexts(2)({0: asked[0]})[0]})[0] if 0 in asked else np.zeros(0, bool)
    assert kept.sum() == len(known.open_rows(grams)) < len(grams.w)
    # half the corpus elsewhere: nothing that training has more than once is known
    other = suffix_tree_lm._answer_contexts(1)({0: pairs[0], 1: pairs[0]})
    half = suffix_tree_lm.Pairs(grams, 1, {0: other[0], -1: pairs[-1]})
    assert (half.counts == 2 * known.counts).all()
    assert len(half.open_rows(grams)) == half.kept[grams.pair].sum() > kept.sum()
