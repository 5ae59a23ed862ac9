"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Follow-the-regularised-leader with elastic-net penalties fits the weights on a bounded sample of
labelled rows (`sample_rows`); document frequencies come from all labelled training rows; one
temperature, fitted on a part of the sample kept apart, calibrates the scores. Prediction is one
pass over whole texts against a model of `BUCKETS` x languages floats, which is all that is
broadcast (its size doesn't depend on the data; every label of the sample is learned).

Defined results: a null or empty text, or one without a letter, is `und` with score 0; without
labelled rows every text is `und`. Repeated rows and ids are predicted row by row. A row without a
doc_id is never trained on and counts as held out. Extra columns are ignored, or kept where asked
for; those named held_out, lang_pred or score are replaced by the results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.tokens import chunks, held

BUCKETS = 1 << 15
_LETTER = re.compile(r"[^\W\d_]")
#: Between two texts, twice: marks a text's start and end in the longer grams. A text may hold it too.
_SEP = "\U0010ffff\U0010ffff"
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def features(texts: list[str]):
    """For each text the distinct buckets of its character 1- to 3-grams (lower case) and their counts."""
    texts = [x.lower() for x in texts]
    codes = np.frombuffer((_SEP.join(["", *texts, ""])).encode("utf-32-le"), np.uint32)
    one = codes * _MIX[0]
    one ^= one >> np.uint32(15)
    two = (one[:-1] * _MIX[1]) ^ one[1:]
    two = (two ^ (two >> np.uint32(13))) * _MIX[2]
    three = (two[:-1] * _MIX[1]) ^ one[2:]
    three = (three ^ (three >> np.uint32(13))) * _MIX[2]
    grams = [(h >> np.uint32(17)).astype(np.int32) for h in (one * _MIX[2], two, three)]
    ends = np.cumsum([len(x) + 2 for x in texts])
    for a, b in zip((ends - [len(x) for x in texts] - 1).tolist(), ends.tolist(), strict=True):
        counts = np.bincount(np.concatenate([grams[0][a + 1 : b], grams[1][a:b], grams[2][a - 1 : b]]), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS + 1 rows (the last is the bias), a column per language
    temperature: float = 1.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return tfidf(at, counts, self.idf) @ self.weights[at] + self.weights[-1]

    def probabilities(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(at, counts) / self.temperature)


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows, n_languages: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """FTRL-proximal: z and n by coordinate; weights are zero while |z| <= l1 (sparse), shrunk by l2."""
    z, n = np.zeros((BUCKETS + 1, n_languages)), np.zeros((BUCKETS + 1, n_languages))

    def weights(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            g = softmax(x @ w)
            g[y] -= 1
            grad = np.outer(x, g)
            new = nn + grad * grad
            z[at] = zz + grad - (np.sqrt(new) - np.sqrt(nn)) / alpha * w
            n[at] = new
    return weights(z, n)


def calibrated(model: Model, rows) -> float:
    """The temperature of least log loss on rows that weren't trained on (golden-section search)."""
    if not rows:
        return 1.0
    z = np.array([model.logits(at, counts) for at, counts, _ in rows])
    y = np.array([y for *_, y in rows])

    def loss(log_t):
        s = z / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    lo, hi, g = np.log(0.25), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 3000) -> Model | None:
    """A model from labelled rows. sample_rows bounds the rows that the weights and the temperature are fitted on."""
    rows = labelled.select(F.col(id_col).cast("string").alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).filter("_lang is not null and _text is not null")

    def df_pass(batches):
        held("sets")
        seen, n, columns = np.zeros(BUCKETS, np.int64), 0, ["_text"]
        for batch in batches:
            for part in chunks(batch.select(columns)):
                for at, _ in features(part.column(0).to_pylist()):
                    seen[at] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"at": pa.array([*at, -1], pa.int32()), "n": pa.array([*seen[at], n], pa.int64())})

    # a bucket's count per partition, summed by Spark: at most BUCKETS + 1 rows come to the driver
    df = dict(rows.select("_text").mapInArrow(df_pass, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect())
    total = df.pop(-1, 0)
    if not total:
        return None
    seen = np.zeros(BUCKETS)
    seen[list(df)] = list(df.values())
    idf = np.log((1 + total) / (1 + seen)) + 1

    def sample_pass(batches):
        held("sets")
        for batch in batches:
            for part in chunks(batch):
                got = list(features(part.column("_text").to_pylist()))
                yield pa.RecordBatch.from_pydict({"_id": part.column("_id"), "_lang": part.column("_lang"), "at": pa.array([a.astype("<u2").tobytes() for a, _ in got], pa.binary()), "n": pa.array([n.astype("<u4").tobytes() for _, n in got], pa.binary())})

    share = min(1.0, sample_rows / total)
    picked = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    sample = picked.mapInArrow(sample_pass, "_id string, _lang string, at binary, n binary").toLocalIterator()
    got = sorted((r["_id"] or "", r["_lang"], bytes(r["at"]), bytes(r["n"])) for _, r in zip(range(2 * sample_rows), sample, strict=False))
    languages = sorted({x for _, x, *_ in got})
    place = {x: i for i, x in enumerate(languages)}
    data = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(n, "<u4").astype(np.float64), place[x]) for _, x, a, n in got if a]
    if not data:
        return None
    apart = data[::5] if len(data) >= 50 else []
    kept = [x for i, x in enumerate(data) if i % 5] if apart else data
    # the bias is a feature of value 0.1 at row BUCKETS
    rows_ = [(np.append(at, BUCKETS), np.append(tfidf(at, n, idf), 0.1), y) for at, n, y in kept]
    weights = ftrl(rows_, len(languages))
    weights[-1] *= 0.1
    model = Model(languages, idf, weights)
    model.temperature = calibrated(model, apart)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of keep, lang_pred and score of every whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    cols = [c for c in dict.fromkeys([id_col, *keep]) if c not in (text_col, "lang_pred", "score")]
    kept = text_col in keep  # the text goes through the workers once

    def run(batches):
        held("sets")
        model = shared.value
        for batch in batches:
            for part in chunks(batch):
                texts = part.column(part.num_columns - 1).to_pylist()
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                if model is not None:
                    told = [i for i, x in enumerate(texts) if x and _LETTER.search(x)]
                    for i, (at, counts) in zip(told, features([texts[i] for i in told]), strict=True):
                        p = model.probabilities(at, counts)
                        best = int(p.argmax())
                        lang[i], score[i] = model.languages[best], min(1.0, float(p[best]))
                yield pa.RecordBatch.from_arrays([*(part.columns if kept else part.columns[:-1]), pa.array(lang, pa.string()), pa.array(score)], names=[*cols, *([text_col] if kept else []), "lang_pred", "score"])

    source = docs.select(*cols, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *([f"`{text_col}` string"] if kept else [])])
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """The fold that is never trained on: crc32 of the id as text, mod 5, is 0; a null id too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def language_id(docs: DataFrame, train: DataFrame | None = None, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predictions for docs by a model learned from the rows of train (docs if none) outside the held-out fold."""
    labelled = docs if train is None else train
    model = fit(labelled.filter(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs.withColumn("held_out", held_out(id_col)), model, id_col, text_col, keep=(*keep, "held_out"))
