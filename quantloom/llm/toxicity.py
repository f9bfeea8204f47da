"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words and four-letter stems) is learned from labelled training rows by smoothed odds. Every whole text is
turned into a short vector of densities and rates; Spark ML's boosted trees score it and an isotonic regression maps the
score to a probability. Only the text enters a score: no label, language, source or id.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import UPPER, materialize, read, set_aside

#: At most about this many labelled rows train the lexicon, the trees and the calibration.
MAX_TRAINING_ROWS = 20_000
MAX_LEXICON = 600
REJECT_AT = 0.5
FEATURES = (
    "lexicon_per_word", "stem_per_word", "lexicon_log", "distinct_log", "second_person_near", "second_person_per_word",
    "caps_share", "shouted_per_word", "exclaim_per_word", "punctuation_share", "repeated_mark_rate", "obfuscated_rate", "disguised_per_word", "length_log",
)
#: Second-person words of the four languages, and the characters that stand for letters.
SECOND_PERSON = frozenset(
    w.encode() for w in "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
)
DISGUISE = bytes.maketrans(b"0134578@$!", b"oieastbasi")
NEAR = 5
_BYTES = bytes(b + 32 if chr(b) in UPPER else b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else 0x20 for b in range(256))
_LETTERS = UPPER.encode()
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_SHOUTED = re.compile(rb"\b[A-Z]{3,}\b").findall
_REPEATED = re.compile(rb"[!?*]{2,}").findall
_DISGUISED = re.compile(rb"[A-Za-z]+[0-9@$!*][A-Za-z0-9@$!*]*[A-Za-z]").findall
STEM = 4


def stem(word: bytes) -> bytes:
    return b"^" + word.decode("utf-8", "ignore")[:STEM].encode()


def text_units(text: str | None) -> set[str]:
    """The distinct words of a text and their stems (marked by ^). Words of more than 40 bytes (links, encoded data) give their stem
    only: they can not enter the lexicon, though they count as words in every feature."""
    words = set((text or "").encode().translate(_BYTES).split())
    return {w.decode("utf-8", "ignore") for w in words if len(w) <= 40} | {stem(w).decode("utf-8", "ignore") for w in words if len(w) >= STEM + 2}


def text_features(text: str | None, words_in: frozenset[bytes], stems_in: frozenset[bytes]) -> list[float]:
    """Numbers in the order of FEATURES; all 0 for a null text or one without words."""
    raw = (text or "").encode()
    words = raw.translate(_BYTES).split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [i for i, w in enumerate(words) if w in words_in]
    stems = sum(1 for w in words if w[:3] in stems_in and stem(w) in stems_in) if stems_in else 0
    near = sum(1 for i in hits if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    disguised = _DISGUISED(raw)
    known = sum(1 for w in disguised if w.translate(DISGUISE).lower() in words_in)
    return [
        len(hits) / n,
        stems / n,
        math.log1p(len(hits)),
        math.log1p(len({words[i] for i in hits})),
        near / max(1, len(hits)),
        sum(map(words.count, SECOND_PERSON)) / n if n < 64 else sum(1 for w in words if w in SECOND_PERSON) / n,
        (len(raw) - len(raw.translate(None, _LETTERS))) / len(raw),
        len(_SHOUTED(raw)) / n,
        raw.count(b"!") / n,
        (len(raw) - len(raw.translate(None, _MARKS))) / len(raw),
        len(_REPEATED(raw)) / n,
        len(disguised) / n,
        known / n,
        math.log1p(n),
    ]


class Toxicity:
    """A fitted scorer. ``prior`` is the score of every text where the labels do not hold both classes."""

    def __init__(self, spark: SparkSession, lexicon: list[str], trees=None, calibration=None, prior: float = 0.0):
        words = frozenset(u.encode() for u in lexicon if u[0] != "^")
        stems = frozenset(u.encode() for u in lexicon if u[0] == "^")
        # the first three bytes stand beside the stems: a cheap test before the stem is cut at a character
        self.sent = spark.sparkContext.broadcast((words, stems | {s[1:4] for s in stems}))
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def features(self, text: Column) -> Column:
        sent = self.sent

        @F.pandas_udf("array<double>")
        def of(texts: pd.Series) -> pd.Series:
            words, stems = sent.value
            return pd.Series([text_features(t, words, stems) for t in texts])

        return of(text)

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs``, all columns, with the calibrated probability in a column ``name``."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(float(self.prior)))
        own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
        scored = docs.withColumnsRenamed(own).withColumn("features", array_to_vector(self.features(F.col(own["text"]))))
        scored = self.trees.transform(scored).withColumn("raw", vector_to_array("probability")[1])
        scored = self.calibration.setFeaturesCol("raw").setPredictionCol("calibrated").transform(scored)
        kept = [F.col(o).alias(c) for c, o in own.items() if c != name]
        return scored.select(*kept, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")).alias(name))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Toxicity:
    """Fit on labelled rows whose crc32(doc_id as text) mod 5 is not 0: folds 1 to 3 train lexicon and trees, fold 4 the
    calibration (all folds, if fold 4 has under 20 rows of either class). Null labels and ids are left out; a document
    with several labels counts as toxic if one says so. Above ``max_rows`` labelled rows, the rows with the smallest id
    hashes are taken, so many that about ``max_rows`` remain.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("double").alias("label"))
    known = known.withColumn("fold", fold(F.col("_id"))).where("fold > 0")
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "label", "fold")
    rows = materialize(rows)
    counts = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    of = lambda label, folds: sum(v for (f, y), v in counts.items() if y == label and f in folds)
    positive, negative = of(1.0, (1, 2, 3)), of(0.0, (1, 2, 3))
    if not positive or not negative:
        everything = sum(counts.values())
        return Toxicity(spark, [], prior=of(1.0, range(5)) / everything if everything else 0.0)

    @F.pandas_udf("array<string>")
    def units(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(text_units(t)) for t in texts])

    in_label = rows.where("fold < 4").select("label", F.explode(units("text")).alias("unit")).groupBy("unit").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    odds = ((F.col("a") + 0.5) / (positive + 1)) / ((F.col("b") + 0.5) / (negative + 1))
    least = max(3, math.ceil(0.005 * positive))
    lexicon = in_label.where((F.col("a") >= least) & (odds >= 12)).orderBy(F.desc(F.log(odds) * F.col("a")), "unit").limit(MAX_LEXICON)
    model = Toxicity(spark, sorted(r["unit"] for r in lexicon.collect()))
    seen = materialize(rows.select("label", "fold", model.features(F.col("text")).alias("x")).coalesce(4)).select("label", "fold", array_to_vector("x").alias("features"))
    model.trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=7, featureSubsetStrategy="all", maxMemoryInMB=64).fit(seen.where("fold < 4"))
    own = seen.where("fold = 4") if min(of(1.0, (4,)), of(0.0, (4,))) >= 20 else seen
    own = model.trees.transform(own).select(vector_to_array("probability")[1].alias("raw"), "label")
    model.calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(own)
    return model


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = REJECT_AT) -> DataFrame:
    """``docs``, all columns under any names, without the documents that score ``threshold`` or more. Null and empty texts have a
    score too. Without labels of both kinds every document has the share of toxic labels as its score (none: 0, all stay).
    """
    own, back = set_aside(docs, "doc_id", "text")
    return fit_toxicity(own, labels).score(own, "score").where(F.col("score") < threshold).select(*back)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit_toxicity(docs, read(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))
