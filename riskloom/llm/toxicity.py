"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import map_slices, plain_words
from riskloom.session import stage

THRESHOLD = 0.3
#: Labelled rows that the trees and the calibration are fitted on, at most; those with the smallest hashes.
FIT_ROWS = 20_000
#: Words learned from the labelled rows: toxic documents they are in, and how much likelier they are there.
LEARNED_DOCUMENTS, LEARNED_LIFT, LEARNED_WORDS = 8, 4.0, 400
#: Words to either side of a hit in which a second person counts as near.
NEAR = 5
WINDOW = 50

#: General insult, contempt and threat words of the corpus languages, and second-person words.
INSULTS = frozenset("idiot idiots moron morons stupid dumb fool fools loser losers clown clowns jerk scum trash garbage pathetic worthless imbecile coward cretin dimwit halfwit bastard dummkopf trottel depp vollidiot blöd arschloch schwachkopf imbécile crétin abruti connard débile nul imbécil estúpido tonto gilipollas cabrón inútil".split())
CONTEMPT = frozenset("hate despise disgusting disgust shut pig pigs rat rats vermin filthy ugly sick crap damn hell nasty hasse ekelhaft widerlich halt dreck déteste dégoûtant merde ordure odio asco asqueroso basura mierda".split())
THREATS = frozenset("kill die murder hurt destroy burn hang shoot beat punch töten stirb umbringen tuer crève mourir matar muere morir".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes".split())

FEATURES = ("insults", "contempt", "threats", "learned", "hits", "kinds", "densest", "near_second", "capitals", "shouts", "marks", "disguised", "log_words", "word_chars")
_LEXICA = tuple(frozenset(w.encode() for w in lexicon) for lexicon in (INSULTS, CONTEMPT, THREATS))
_SECOND = frozenset(w.encode() for w in SECOND)
_DISGUISED = re.compile(rb"[A-Za-z]+[0-9@$*!#]+[A-Za-z]+")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def text_features(text: bytes, learned: frozenset[bytes]) -> tuple[float, ...]:
    """The values of ``FEATURES``; all zero for a text without words."""
    words = plain_words(text)
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    kinds = set(words)
    lexica = (*_LEXICA, learned)
    found = [kinds & lexicon for lexicon in lexica]
    every = frozenset().union(*found)
    counts, hits, near, densest = [0] * len(lexica), 0, 0, 0
    if every:
        places = [i for i, w in enumerate(words) if w in every]
        hits = len(places)
        counts = [sum(words[i] in f for i in places) if f else 0 for f in found]
        near = sum(any(w in _SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in places)
        low = 0
        for high, place in enumerate(places):
            while place - places[low] >= WINDOW:
                low += 1
            densest = max(densest, high - low + 1)
    size = len(text)
    upper, lower = size - len(text.translate(None, _UPPER)), size - len(text.translate(None, _LOWER))
    return (
        *(100.0 * c / n for c in counts), float(min(hits, 20)), float(len(every)), float(densest), 100.0 * near / n, upper / max(1, upper + lower), 100.0 * text.count(b"!") / n,
        100.0 * (text.count(b"?") + text.count(b"...")) / n, 100.0 * len(_DISGUISED.findall(text)) / n, math.log1p(n), size / n,
    )


def feature_table(docs: DataFrame, learned: frozenset[bytes]) -> DataFrame:
    """doc_id and one column per feature; a null text has the features of an empty one."""

    def work(rows, texts):
        grid = np.array([text_features(t, learned) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return {"doc_id": rows.column(0)} | {name: grid[:, k] for k, name in enumerate(FEATURES)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), work, f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES))


def fold(doc_id: str) -> F.Column:
    """crc32 of the id as text, modulo 4; null without an id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fit_sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic) that may be learned from, the held-out fold left out."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(fold("doc_id") != 2)
    return usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def learn_words(docs: DataFrame, sample: DataFrame) -> frozenset[bytes]:
    """Words that are much likelier in toxic documents of the sample."""
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def work(rows, texts):
        toxic, words = [], []
        for label, text in zip(rows.column(2).to_pylist(), texts):
            for word in set(plain_words(text)):
                words.append(word.decode(errors="replace"))
                toxic.append(label)
        return {"word": words, "toxic": toxic}

    totals = sample.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    if not totals["bad"] or totals["bad"] == totals["n"]:
        return frozenset()
    counted = map_slices(texts.select("doc_id", "text", "toxic"), work, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    share = totals["bad"] / totals["n"]
    best = (
        counted.where((F.col("bad") >= LEARNED_DOCUMENTS) & (F.col("bad") >= LEARNED_LIFT * share * F.col("n")))
        .orderBy(F.desc(F.col("bad") * F.log(F.col("bad") / (F.col("n") * share))), "word")
        .limit(LEARNED_WORDS)
    )
    return frozenset(r["word"].encode() for r in best.collect())


class ToxicityModel:
    """Trees and calibration; without labels of both classes, a fixed curve over lexicon densities."""

    def __init__(self, learned: frozenset[bytes], trees: GBTClassificationModel | None, curve: IsotonicRegressionModel | None):
        self.learned, self.trees, self.curve = learned, trees, curve

    def scored(self, features: DataFrame) -> DataFrame:
        """doc_id and score from 0 to 1."""
        if self.trees is None:
            return features.select("doc_id", (1 - F.exp(-(F.col("insults") + F.col("contempt") + F.col("threats")) / 2)).alias("score"))
        raw = self.trees.transform(_assembled(features)).select("doc_id", vector_to_array("probability")[1].alias("margin"))
        if self.curve is None:
            return raw.select("doc_id", F.col("margin").alias("score"))
        # A thousandth of the trees' own score keeps the order inside a step of the curve.
        return self.curve.transform(raw).select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("curve") + 0.001 * F.col("margin"))).alias("score"))


def _assembled(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)


def fit(features: DataFrame, sample: DataFrame, learned: frozenset[bytes], *, trees: int = 20, depth: int = 3) -> ToxicityModel:
    """Trees on folds 0 and 1, calibration on fold 3."""
    rows = stage(features.join(F.broadcast(sample), "doc_id").withColumn("fold", fold("doc_id")).repartition(2, "doc_id"), "fit")
    have = {(r["fold"] == 3, r["toxic"]) for r in rows.select("fold", "toxic").distinct().collect()}
    if not {(False, 0), (False, 1)} <= have:
        return ToxicityModel(learned, None, None)
    model = GBTClassifier(labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(_assembled(rows.where("fold <> 3")))
    if not {(True, 0), (True, 1)} <= have:
        return ToxicityModel(learned, model, None)
    margins = model.transform(_assembled(rows.where("fold = 3"))).select(vector_to_array("probability")[1].alias("margin"), F.col("toxic").cast("double").alias("toxic"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="curve").fit(margins)
    return ToxicityModel(learned, model, curve)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Scores come from the text alone.  A null or empty text has a score, too.
    Rows that share a doc_id are scored one by one; a label repeated for an id
    counts once, as toxic if one says so; a row without doc_id is not held out.
    Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sample = stage(fit_sample(labels), "sample")
    learned = learn_words(docs, sample)
    features = stage(feature_table(docs, learned), "features")
    scored = fit(features, sample, learned).scored(features)
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
