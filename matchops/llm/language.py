"""Language of a text by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3) under TF-IDF with unit
length; document frequencies come from all rows that may teach.  The model
is trained on a bounded sample of them with follow-the-regularised-leader
and an elastic-net penalty; part of the sample is set aside to calibrate a
temperature for the probabilities.

Contract: a null text, or one without a letter, is ``und`` with score 0;
a null lang teaches nothing; with no teaching rows every text is ``und``;
repeated rows are alike; ties go to the first lang in sort order; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchops.llm.common import held_out
from matchops.session import materialize

BITS = 15
SAMPLE = 8000  # teaching rows that the weights are fitted on, at most
LONGEST = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5


def grams(text: str) -> np.ndarray:
    """Counts of the text's hashed n-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h, keys = np.zeros(len(c), np.uint32), []
    for n in range(1, LONGEST + 1):
        if len(c) < n:
            break
        h = (h[:len(c) - n + 1] ^ c[n - 1:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        keys.append((h * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - BITS))
    return np.bincount(np.concatenate(keys), minlength=1 << BITS) if keys else np.zeros(1 << BITS, np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of unit length."""
    counts = grams(text)
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


def _docs(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many teaching rows each feature is found, and their number."""
    size = 1 << BITS

    def run(batches):
        found = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found[:size] += grams(text) > 0
                found[size] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect()  # at most 2^15 + 1
    out = np.zeros(size + 1, np.int64)
    for at, n in rows:
        out[at] = n
    return out[:size], int(out[size])


def train(rows: DataFrame, idf: np.ndarray) -> tuple[list[str], np.ndarray, float]:
    """(languages, weights, temperature) from (text, lang)."""
    def fit(batches):
        data = [(lang, *weighted(t, idf)) for b in batches
                for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)]
        langs = sorted({d[0] for d in data})
        if not langs:
            return
        order = np.random.default_rng(7).permutation(len(data))
        kept, fifth = (order, order) if len(order) < 50 else (order[len(order) // 5:], order[:len(order) // 5])
        shape = len(langs), (1 << BITS)
        z, n = np.zeros(shape), np.zeros(shape)

        def weights(at):
            zz = z[:, at]
            w = (np.sign(zz) * L1 - zz) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2)
            return np.where(np.abs(zz) > L1, w, 0)

        for i in kept:
            lang, at, x = data[i]
            w = weights(at)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[langs.index(lang)] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
        w = weights(slice(None))
        s = np.array([w[:, at] @ x for _, at, x in (data[i] for i in fifth)])
        y = np.array([langs.index(data[i][0]) for i in fifth])

        def loss(t):
            q = s / t
            q = q - q.max(axis=1, keepdims=True)
            return (np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]).mean()

        temperature = min(np.geomspace(0.02, 5, 60), key=loss)
        for k, lang in enumerate(langs):
            yield pa.RecordBatch.from_pydict({"lang": [lang], "w": [w[k].astype("<f4").tobytes()], "t": [float(temperature)]})

    found = sorted(rows.select("text", "lang").coalesce(1).mapInArrow(fit, "lang string, w binary, t double").collect())
    if not found:
        return [], np.zeros((0, 1 << BITS), np.float32), 1.0
    return [r[0] for r in found], np.stack([np.frombuffer(r[1], "<f4") for r in found]), found[0][2]


def fit(docs: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, float]:
    """(idf, languages, weights, temperature), learned without held-out rows."""
    teaching = _docs(docs, "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    df, n = document_frequencies(teaching)
    idf = np.log((1 + n) / (1 + df)) + 1
    ids = teaching.select("doc_id").dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = teaching.join(F.broadcast(materialize(ids, "sample")), "doc_id").dropDuplicates(["doc_id"])
    return idf, *train(sample, idf)


def predictor(spark: SparkSession, model: tuple):
    """A column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(text: pd.Series) -> pd.DataFrame:
        idf, langs, w, temperature = shared.value
        preds, scores = [], []
        for t in text:
            if not langs or not has_letter(t):
                preds.append("und")
                scores.append(0.0)
                continue
            at, x = weighted(t, idf)
            s = w[:, at] @ x / temperature
            p = np.exp(s - s.max())
            preds.append(langs[int(np.argmax(p))])
            scores.append(float(p.max() / p.sum()))
        return pd.DataFrame({"lang_pred": pd.Series(preds, dtype=object), "score": pd.Series(scores, dtype=float)})

    return of


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    of = predictor(docs.sparkSession, fit(docs))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of("text").alias("p"))
    return found.select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score")
