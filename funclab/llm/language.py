"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased whole text. Document
frequencies come from all training texts. The weights are fitted by follow-the-regularised-leader
with elastic-net penalties on a bounded sample of the training texts, a part of which is held back
to set the temperature of the scores.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funclab.llm.common import tidy
from funclab.plans.settle import settle

BITS = 16
WIDTH = 1 << BITS
#: The classifier is fitted on about this many training texts, never more than twice as many, dealt
#: evenly over the languages. Counts of documents are not sampled.
FIT_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.01
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and their counts."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        one = c * np.uint32(0x9E3779B1) + np.uint32(1)
        two = (one[:-1] * np.uint32(0x85EBCA77)) ^ (c[1:] * np.uint32(0xC2B2AE3D))
        three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (c[2:] * np.uint32(0x165667B1)) if len(c) > 2 else two[:0]
        grams = np.concatenate([x ^ (x >> np.uint32(15)) for x in (one, two, three)]) * np.uint32(0x2C1B3C6D)
    counts = np.bincount(grams >> np.uint32(32 - BITS), minlength=WIDTH)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(text: str, idf: np.ndarray):
    at, counts = features(text)
    values = (1 + np.log(counts)) * idf[at]
    return at, values / max(np.sqrt(values @ values), 1e-12)


def _shares(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader for a multinomial model; weights exist only through z and n."""

    def __init__(self, width, classes):
        self.z, self.n = np.zeros((width, classes)), np.zeros((width, classes))

    def weights(self, at=slice(None)):
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, at, values, label):
        w = self.weights(at)
        error = _shares(values @ w)
        error[label] -= 1
        g = values[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which held-back labels are most likely, between 1/32 and 32."""
    if not len(labels):
        return 1.0
    grid = 2.0 ** np.linspace(-5, 5, 161)
    losses = [-np.log(np.maximum(_shares(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(rows, labels, classes, idf):
    """Weights and temperature from feature rows; every fifth row is held back for the temperature."""
    order = np.random.default_rng(7).permutation(len(rows))
    held, used = order[::5], np.setdiff1d(order, order[::5], assume_unique=True)
    if not len(used) or not set(labels[held]) <= set(labels[used]):
        held, used = order[:0], order
    model, rng = Ftrl(WIDTH, classes), np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            model.step(*rows[i], labels[i])
    w = model.weights()
    logits = np.array([v @ w[at] for at, v in (rows[i] for i in held)]).reshape(len(held), classes)
    return w, temperature(logits, labels[held])


def _frequencies(batches):
    import pyarrow as pa

    counts, n = np.zeros(WIDTH, np.int64), 0
    for b in batches:
        for text in b.column(0):
            counts[features(text.as_py())[0]] += 1
            n += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], n))], names=["feature", "n"])


def _fit_group(classes, idf):
    def run(table):
        import pandas as pd

        rows = [weighted(t, idf) for t in table.sort_values("_order")["text"]]
        labels = np.array([classes.index(x) for x in table.sort_values("_order")["lang"]])
        w, t = fit(rows, labels, len(classes), idf)
        at = np.flatnonzero(w.any(axis=1))
        return pd.DataFrame({"features": [at.astype(np.int32).tobytes()], "weights": [w[at].astype(np.float32).tobytes()], "temperature": [t]})

    return run


class LanguageModel:
    """A fitted model: ``classes``, ``idf``, ``weights`` and ``temperature``."""

    def __init__(self, classes, idf, weights, temperature):
        self.classes, self.idf, self.weights, self.temperature = classes, idf, weights, temperature

    @classmethod
    def train(cls, docs: DataFrame, fit_rows=FIT_ROWS) -> LanguageModel:
        """Learn from columns text and lang; rows without a letter or a language are not used.

        The number of languages is taken to be small: a row of weights has a number for each.
        """
        rows = docs.select("text", "lang").filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
        per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        classes = sorted(per)
        counted = rows.select("text").mapInArrow(tidy(_frequencies), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        found = {r["feature"]: r["n"] for r in counted.collect()}  # a row for each of WIDTH features
        n = found.pop(-1, 0)
        df = np.zeros(WIDTH)
        df[list(found)] = list(found.values())
        idf = np.log((1 + n) / (1 + df)) + 1
        if len(classes) < 2:
            return cls(classes, idf.astype(np.float32), np.zeros((WIDTH, len(classes)), np.float32), 1.0)
        share = F.create_map(*[F.lit(x) for k in classes for x in (k, fit_rows / len(classes) / per[k])])
        order = F.xxhash64("text", "lang", F.lit(5))
        drawn = rows.withColumn("_order", order).filter(F.pmod("_order", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
        drawn = settle(drawn.orderBy("_order").limit(2 * fit_rows))
        made = drawn.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_fit_group(classes, idf), "features binary, weights binary, temperature double").first()
        weights = np.zeros((WIDTH, len(classes)), np.float32)
        weights[np.frombuffer(made["features"], np.int32)] = np.frombuffer(made["weights"], np.float32).reshape(-1, len(classes))
        return cls(classes, idf.astype(np.float32), weights, made["temperature"])

    def scores(self, text: str | None):
        """The most likely language and its share; ``und`` and 0 for a text without a letter."""
        if not self.classes or not text or not _LETTER.search(text):
            return "und", 0.0
        at, values = weighted(text, self.idf)
        p = _shares((values @ self.weights[at]) / self.temperature)
        k = int(np.argmax(p))
        return self.classes[k], float(min(max(p[k], 0.0), 1.0))

    def predict(self, docs: DataFrame, text="text", names=("lang_pred", "score")) -> DataFrame:
        """``docs`` with two more columns, from whole texts alone. Existing columns of these names are replaced."""
        import pyarrow as pa
        from pyspark.sql import types as T

        kept = [c for c in docs.columns if c not in names]
        schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
        spark, at, columns = docs.sparkSession, kept.index(text), [*kept, *names]
        held = spark.sparkContext.broadcast((self.classes, self.idf, self.weights, self.temperature))

        def run(batches):
            model = LanguageModel(*held.value)
            for b in batches:
                pairs = [model.scores(x.as_py()) for x in b.column(at)]
                more = [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=columns)

        return docs.select(*kept).mapInArrow(tidy(run), schema)


def held_out(key="doc_id"):
    """True for rows that no model may learn from. A null key is neither learnt from nor held out."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1
