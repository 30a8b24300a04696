"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters, everything else one separator; n-grams of 1 to 3 characters are hashed into ``BINS``
bins. A document's features are each bin's share of its n-grams times the bin's inverse document frequency, which is
counted over all rows that may be learned from. The weights are trained with follow-the-regularised-leader and an
elastic net (L1 keeps them sparse), on at most ``PER_LANGUAGE`` rows a language, those with the smallest hashes of
id and text, and ``SAMPLE`` rows in all: with more languages than fit, each gives fewer, one at least. A fifth of that sample isn't trained on: it fixes
the temperature by which the scores are divided. Prediction reads every whole text once, without a shuffle; it adds
whole numbers, so neither batches nor order change a score.

Cases: a null text or one without a letter is ``und`` with score 0; so is every row if nothing can be learned; a null
language doesn't train; repeated rows are predicted alike; an empty table gives an empty result. Language, source and id
never enter a prediction.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold_of, python_ready, stash, text_runs, unstash

ORDERS = (1, 2, 3)
BINS = 1 << 15
PER_LANGUAGE = 400
SAMPLE = 51_200
EPOCHS = 4
BATCH = 8
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
SHARE = 100.0  # features are shares in hundredths
FIXED = 1 << 16  # weights in whole numbers
RUN = 256 << 10
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(0x30000):
        s = chr(c)
        if unicodedata.category(s)[0] in "LM":
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letters())
    return _LETTERS[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For a run of texts: the bins of the n-grams that start at each character, for each order; the texts' limits in characters; which characters are letters."""
    block = data[int(offsets[0]) : int(offsets[-1])]
    points = np.frombuffer(block.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((block & 0xC0) != 0x80)])
    limits = heads[offsets - offsets[0]]
    chars = letters()[points]
    bins, h = [], np.zeros(len(chars), np.uint32)
    with np.errstate(over="ignore"):
        for n in ORDERS:
            moved = np.zeros_like(chars)
            if n <= len(chars):
                moved[: len(chars) - n + 1] = chars[n - 1 :]
            h = (h * np.uint32(0x01000193) ^ (moved + np.uint32(n))) * np.uint32(0x9E3779B1)
            bins.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int32))
    return bins, limits, chars != 0


def spans(limits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the n-grams that lie within each text."""
    a = limits[:-1]
    return a, np.maximum(a, limits[1:] - n + 1)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # int32, bins x languages
    bias: np.ndarray
    temperature: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float]]:
        bins, limits, is_letter = grams(data, offsets)
        n = len(limits) - 1
        sums, total = np.zeros((n, len(self.languages)), np.int64), np.zeros(n, np.int64)
        for order, f in zip(ORDERS, bins, strict=True):
            a, b = spans(limits, order)
            for k in range(len(self.languages)):
                run = np.concatenate([[0], np.cumsum(self.table[f, k], dtype=np.int64)])
                sums[:, k] += run[b] - run[a]
            total += b - a
        has = np.concatenate([[0], np.cumsum(is_letter)])
        known = has[limits[1:]] > has[limits[:-1]]
        logits = (sums / FIXED * SHARE / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)], np.where(known, p[np.arange(n), best], 0.0).tolist()


def document_frequencies(learnable: DataFrame) -> tuple[np.ndarray, int]:
    """In how many learnable documents each bin occurs, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs = np.zeros(BINS + 1, np.int64), 0
        mark = np.zeros(BINS, bool)
        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column("text"), RUN):
                bins, limits, _ = grams(data, offsets)
                for d in range(len(limits) - 1):
                    mark[:] = False
                    for n, f in zip(ORDERS, bins, strict=True):
                        mark[f[limits[d] : max(limits[d], limits[d + 1] - n + 1)]] = True
                    found[:BINS] += mark
                    docs += 1
        found[BINS] = docs
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], ["bin", "n"])

    rows = learnable.select("text").mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS + 1 rows at most
    out = np.zeros(BINS + 1, np.int64)
    for r in rows:
        out[r["bin"]] = r["n"]
    return out[:BINS], int(out[BINS])


def sample(learnable: DataFrame, per_language: int, most: int) -> list:
    """Rows lang, key, bins and counts of the bounded sample: ``per_language`` rows a language, or fewer, so that ``most`` are enough for all.

    A language's counted rows tell below which hash its sample lies; only rows below it are ranked, so what is ranked doesn't grow.
    """
    keyed = learnable.select("lang", F.xxhash64("doc_id", "text").alias("key"), "text")
    known = keyed.select("lang", "key")
    counts = stash(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    each = max(1, min(per_language, most // max(1, counts.count())))
    room = each + 10 * math.sqrt(each) + 20
    limits = counts.orderBy(F.desc("n"), "lang").limit(most).select("lang", (F.lit(room) / F.col("n")).alias("share"))
    below = F.shiftrightunsigned("key", 11) / float(1 << 53) < F.col("share")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    few = known.join(F.broadcast(limits), "lang").filter(below).select("lang", "key").distinct()
    ids = few.withColumn("_rank", rank).filter(F.col("_rank") <= each).select("lang", "key")
    chosen = keyed.join(F.broadcast(ids), ["lang", "key"], "left_semi")  # ``most`` keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, key = batch.column("lang"), batch.column("key")
            for first, end, data, offsets in text_runs(batch.column("text"), RUN):
                bins, limits, _ = grams(data, offsets)
                ids, counts = [], []
                for d in range(end - first):
                    every = np.concatenate([f[limits[d] : max(limits[d], limits[d + 1] - n + 1)] for n, f in zip(ORDERS, bins, strict=True)])
                    u, c = np.unique(every, return_counts=True)
                    ids.append(u.astype("<i4").tobytes())
                    counts.append(c.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([lang.slice(first, end - first), key.slice(first, end - first), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["lang", "key", "bins", "counts"])

    found = chosen.select("lang", "key", "text").mapInArrow(run, "lang string, key bigint, bins binary, counts binary")
    rows = found.groupBy("lang", "key").agg(F.first("bins").alias("bins"), F.first("counts").alias("counts")).collect()  # equal rows are one
    unstash(counts)
    return sorted(rows, key=lambda r: (r["key"], r["lang"]))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bins x classes) and bias by follow-the-regularised-leader on rows (class, bins, features)."""
    w, z, n = (np.zeros((BINS + 1, classes), np.float32) for _ in range(3))
    for _ in range(EPOCHS):
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            bins = np.unique(np.concatenate([b for _, b, _ in some] + [[BINS]]))
            x = np.zeros((len(some), len(bins)))
            for i, (_, b, v) in enumerate(some):
                x[i, np.searchsorted(bins, b)] = v
            x[:, -1] = 1
            logits = x @ w[bins]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), [c for c, _, _ in some]] -= 1
            g = x.T @ p / len(some)
            grown = n[bins] + g * g
            z[bins] += g - (np.sqrt(grown) - np.sqrt(n[bins])) / ALPHA * w[bins]
            n[bins] = grown
            zb = z[bins]
            w[bins] = np.where(np.abs(zb) <= L1, 0, -(zb - np.sign(zb) * L1) / ((BETA + np.sqrt(grown)) / ALPHA + L2))
    return w[:BINS], w[BINS]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, of a fixed grid, with the smallest cross-entropy."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    return float(min(np.geomspace(0.1, 10, 81), key=loss))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> Model | None:
    """Learn from rows with a language outside the held-out fold (crc32 of the id, modulo 3, is 1)."""
    python_ready(docs.sparkSession)
    learnable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), 3) != 1))
    rows = sample(learnable, per_language, most)
    names = sorted({r["lang"] for r in rows})
    if not names:
        return None
    found, docs_seen = document_frequencies(learnable)
    idf = np.log((1 + docs_seen) / (1 + found)) + 1
    every = []
    for r in rows:
        b, c = np.frombuffer(r["bins"], "<i4"), np.frombuffer(r["counts"], "<i4")
        if len(b):
            every.append((names.index(r["lang"]), b, c * idf[b] * SHARE / c.sum()))
    held, used = every[::5], [r for i, r in enumerate(every) if i % 5]
    weights, bias = train(used or every, len(names))
    logits = np.array([v @ weights[b] + bias for _, b, v in held]).reshape(-1, len(names))
    table = np.round(weights * idf[:, None] * FIXED).astype(np.int32)
    return Model(names, table, bias, calibrate(logits, np.array([c for c, _, _ in held], int)))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            if known is not None:
                for first, end, data, offsets in text_runs(batch.column("text"), RUN):
                    names[first:end], scores[first:end] = known.predict(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text").mapInArrow(run, SCHEMA)
