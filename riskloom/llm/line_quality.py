"""Quality rules: line labels by a linear-chain conditional random field.

Every line with a word is a node of its document's chain, labelled content or
boilerplate by Viterbi decoding.  The share of words in content lines decides
whether the document stays.  Base counts of the text fail a document on their
own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import map_slices, set_aside

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
#: The field is fitted on at most so many labelled documents, and so many segments of their lines.
FIT_DOCUMENTS = 2_000
FIT_SEGMENTS = 3_000
SEGMENT_LINES = 64

_SPACE_AND_CONTINUATION = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_NOTICE = re.compile(rb"(?i)cookie|click here|subscribe|sign (?:in|up)|log ?in|all rights reserved|privacy policy|terms of (?:use|service)|share this|read more")

FEATURES = (
    "bias", "up to 2 words", "3 to 7 words", "8 to 19 words", "symbols over 2 %", "symbols over 10 %", "bars", "shouts",
    "capitals", "digits", "few distinct words", "closing mark", "repeats a line", "notice words",
)
#: Weights of the boilerplate label before any fitting; content has weight 0.
PRIOR = np.array([-2.5, 1.0, 0.3, 0.0, 1.5, 2.0, 3.0, 3.0, 2.0, 1.0, 1.0, -1.0, 1.5, 2.0])
PRIOR_STAY = 1.0


@dataclass(frozen=True)
class LineField:
    """Weights of the boilerplate label per feature, and of two neighbours with labels (before, after)."""

    weights: np.ndarray
    links: np.ndarray


def prior_field() -> LineField:
    return LineField(PRIOR.copy(), np.array([[PRIOR_STAY, 0.0], [0.0, PRIOR_STAY]]))


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text.translate(None, _SPACE_AND_CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += bool(line.split())
        seen.add(line)
    return chars, symbols, repeated, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that stands twice or more in the text."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    size = len(ids)
    pairs = codes[:-2] * size + codes[1:-1]
    if size >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * size + codes[2:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= again
    return int(covered.sum())


def line_measures(text: bytes) -> list[tuple[int, ...]]:
    """One tuple per line with a word: words, bytes, symbols, bars, shouts, capitals, small letters, digits, distinct words, closing mark, repeats, notice."""
    rows, seen = [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        size = len(line)
        rows.append(
            (
                len(words), size, size - len(line.translate(None, SYMBOLS)), words.count(b"|"), line.count(b"!!"),
                size - len(line.translate(None, _UPPER)), size - len(line.translate(None, _LOWER)), size - len(line.translate(None, _DIGITS)),
                len(set(words)), words[-1][-1:] in (b".", b"!", b"?"), line in seen, _NOTICE.search(line) is not None,
            )
        )
        seen.add(line)
    return rows


def feature_rows(measures: np.ndarray) -> np.ndarray:
    """Binary features of lines, one row each."""
    words, size, symbols, bars, shouts, upper, lower, digits, distinct, closing, repeats, notice = measures.T.astype(np.float64)
    return np.stack(
        [
            np.ones(len(words)), words <= 2, (words > 2) & (words <= 7), (words > 7) & (words <= 19), symbols > 0.02 * size, symbols > 0.1 * size,
            bars > 0.1 * words, shouts > 0.3 * words, upper > 0.5 * (upper + lower), digits > 0.3 * size, (words >= 8) & (distinct < 0.6 * words),
            closing > 0, repeats > 0, notice > 0,
        ],
        axis=1,
    ).astype(np.float64)


def viterbi(scores: list[float], links: np.ndarray) -> list[int]:
    """The best label sequence (1 boilerplate); of equal ones, content."""
    if not scores:
        return []
    (cc, cb), (bc, bb) = links.tolist()
    back: list[tuple[int, int]] = []
    content, boiler = 0.0, scores[0]
    for score in scores[1:]:
        from_c, from_b = content + cc, boiler + bc
        to_c, to_b = content + cb, boiler + bb
        back.append((int(from_b > from_c), int(to_b > to_c)))
        content, boiler = max(from_c, from_b), max(to_c, to_b) + score
    label = int(boiler > content)
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]


def fit_field(segments: list[tuple[int, np.ndarray]], *, steps: int = 60, rate: float = 0.1, ridge: float = 0.02) -> LineField:
    """Maximum conditional likelihood of label chains, drawn towards the prior weights.

    A segment is (1 for boilerplate, line measures); all its lines carry the label.
    """
    field = prior_field()
    if not segments:
        return field
    n, longest, width = len(segments), max(len(m) for _, m in segments), len(FEATURES)
    x, mask, y = np.zeros((n, longest, width)), np.zeros((n, longest)), np.zeros((n, longest))
    for i, (label, measures) in enumerate(segments):
        x[i, : len(measures)], mask[i, : len(measures)], y[i, : len(measures)] = feature_rows(measures), 1, label
    total = mask.sum()
    pair = mask[:, 1:] * mask[:, :-1]
    seen_weights = np.einsum("ntf,nt->f", x, y * mask)
    seen_links = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & (pair > 0)).sum() for b in (0, 1)] for a in (0, 1)], float)
    prior = np.concatenate([PRIOR, field.links.ravel()])
    theta, first, second = prior.copy(), np.zeros(len(prior)), np.zeros(len(prior))
    for step in range(1, steps + 1):
        weights, links = theta[:width], theta[width:].reshape(2, 2)
        node = np.stack([np.ones((n, longest)), np.exp(x @ weights)], axis=2)
        moves = np.exp(links)
        ahead, behind, scale = np.empty((longest, n, 2)), np.ones((longest, n, 2)), np.ones((longest, n, 1))
        ahead[0] = node[:, 0] / node[:, 0].sum(1, keepdims=True)
        for t in range(1, longest):
            moved = (ahead[t - 1] @ moves) * node[:, t]
            scale[t] = np.where(mask[:, t, None] > 0, moved.sum(1, keepdims=True), 1.0)
            ahead[t] = np.where(mask[:, t, None] > 0, moved / scale[t], ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            moved = ((node[:, t + 1] * behind[t + 1]) @ moves.T) / scale[t + 1]
            behind[t] = np.where(mask[:, t + 1, None] > 0, moved, behind[t + 1])
        marginal = (ahead[:, :, 1] * behind[:, :, 1]).T * mask
        after = node.transpose(1, 0, 2)[1:] * behind[1:] / scale[1:] * pair.T[:, :, None]
        joint = moves * np.einsum("tna,tnb->ab", ahead[:-1], after)
        gradient = np.concatenate([seen_weights - np.einsum("ntf,nt->f", x, marginal), (seen_links - joint).ravel()]) / total
        gradient -= ridge * (theta - prior) / len(prior)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LineField(theta[:width], theta[width:].reshape(2, 2))


def learn_field(docs: DataFrame, labels: DataFrame) -> LineField:
    """Fit the field on a bounded sample of documents labelled by quality (0 or 1).

    The lines of a document carry its label.  Without labelled rows the prior
    weights stand.  The sample is the labelled ids with the smallest hashes.
    """
    chosen = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(FIT_DOCUMENTS)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def work(rows, texts):
        made = {"at": [], "segment": [], "quality": [], "measures": []}
        for doc, quality, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), texts):
            lines = line_measures(text)
            for start in range(0, len(lines), SEGMENT_LINES):
                made["at"].append(doc)
                made["segment"].append(start)
                made["quality"].append(quality)
                made["measures"].append(np.array(lines[start : start + SEGMENT_LINES], "<i8").tobytes())
        return made

    rows = (
        map_slices(texts.select("doc_id", "text", "quality"), work, "at bigint, segment bigint, quality int, measures binary")
        .orderBy(F.xxhash64("at", "segment"), "at", "segment", "measures")
        .limit(FIT_SEGMENTS)
        .collect()
    )
    return fit_field([(1 - r["quality"], np.frombuffer(r["measures"], "<i8").reshape(-1, 12)) for r in rows])


VERDICT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, content_share double"


def measure_documents(docs: DataFrame, field: LineField, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base counts and the share of words in content lines (0 without words), beside the ``carry`` columns."""

    def work(rows, texts):
        made = {name: rows.column(rows.schema.get_field_index(name)) for name in carry}
        counts, chains = [], []
        for text in texts:
            words = text.split()
            counts.append((len(words), *base_counts(text, words)))
            chains.append(line_measures(text))
        flat = [line for chain in chains for line in chain]
        scores = (feature_rows(np.array(flat, np.int64)) @ field.weights).tolist() if flat else []
        shares, at = [], 0
        for chain in chains:
            labels = viterbi(scores[at : at + len(chain)], field.links)
            at += len(chain)
            words = sum(line[0] for line in chain)
            shares.append(sum(line[0] for line, label in zip(chain, labels) if not label) / words if words else 0.0)
        columns = list(zip(*counts)) or [()] * 5
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return made | {n: pa.array(c, pa.int64()) for n, c in zip(names, columns)} | {"content_share": shares}

    chosen = docs.select(*carry, *([] if "text" in carry else ["text"]))
    shape = docs.select(*carry).schema.simpleString()[len("struct<") : -1]
    return map_slices(chosen, work, f"{shape}, {VERDICT}")


def _verdict(measured: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= MIN_CONTENT_SHARE))


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the base counts, base_failed, content_share and kept.

    A null or empty text has no words and fails the base.  Equal rows are judged
    one by one; a null doc_id stays null; other columns are ignored.
    """
    return _verdict(measure_documents(docs, learn_field(docs, labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents; columns as they were."""
    renamed = set_aside(docs)
    measured = measure_documents(renamed, learn_field(docs, labels), tuple(renamed.columns))
    return _verdict(measured).where("kept").select(*renamed.columns).toDF(*docs.columns)
