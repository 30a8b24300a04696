"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is a position of a chain with two labels, good and bad. What speaks for a label are the line's own
shares of character classes, its length, its words and whether it repeats an earlier line, and the same of the lines
before and after it; a 2 x 2 matrix ties neighbours. Forward and backward passes give each line's marginal probability
of being good, and a text's quality is their mean, weighted by the lines' bytes.

Training: lines have no labels, only documents have. At first a document's label stands for each of its lines. Then lines get labels of their
own: a good document's mean marginal must reach ``MEANS[1]``, a bad one's must not exceed ``MEANS[0]``, and within that the model itself says
which lines are good. Where the mean is off, one number added to all lines of the document brings it there; the marginals of lines and of
neighbouring pairs under that are what the next steps learn (posterior regularisation). So ties learn how labels change inside documents.

At most ``PER_LABEL`` documents a label of at most ``LINES`` lines, those with the smallest hashes of their ids, are fetched as line features (not texts)
and fitted on the driver; these bounds are the only sample, and scoring reads every whole text once, without a shuffle.

Cases: a null or empty text is one empty line; rows without a label, or with one that isn't 0 or 1, don't train; several
labels of a document each count; without labels of both kinds every score is 0.5; repeated rows score alike; an empty
table gives an empty result; labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold_of, python_ready, text_runs

PER_LABEL = 600
LINES = 400
MEANS = (0.02, 0.98)  # of bad documents at most, of good ones at least
WARM = 200  # rounds in which lines have their document's label
THRESHOLD = 0.3
ROUNDS = 250

#: Classes of bytes: lower case and all bytes beyond ASCII, upper case, digits, white space, sentence marks, symbols, bars, exclamation marks, the rest.
_CLASS = np.full(256, 8, np.int64)
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[list(b".,;:?'\"()-")] = 4
_CLASS[list(b"#*$%&<>^~=+@\\/{}[]_`")] = 5
_CLASS[ord("|")] = 6
_CLASS[ord("!")] = 7
CLASSES = 9
OWN = CLASSES + 4
WIDTH = 3 * OWN + 1


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines of a run of texts, the first line of each text (and one beyond), and the lines' bytes."""
    base = int(offsets[0])
    block = data[base : int(offsets[-1])]
    limits = offsets - base
    breaks = np.flatnonzero(block == 10)
    begins = np.concatenate([limits[:-1], breaks + 1])
    ends = np.concatenate([breaks, limits[1:]])
    begins.sort()
    ends.sort()
    # an empty text and a break at a text's end share limits; a stable order keeps each line's own pair
    first = np.searchsorted(breaks, limits, side="left") + np.arange(len(limits))
    lens = ends - begins
    n = len(lens)
    turns = np.bincount(breaks + 1, minlength=len(block) + 1) + np.bincount(limits[1:-1], minlength=len(block) + 1)
    line = np.cumsum(turns[: len(block)])
    kept = block != 10
    counts = np.bincount(line[kept] * CLASSES + _CLASS[block[kept]], minlength=n * CLASSES)[: n * CLASSES].reshape(n, CLASSES).astype(np.float64)
    space = _CLASS[block] == 3
    word_start = ~space & kept
    word_start[1:] &= (space | ~kept)[:-1] | (line[1:] != line[:-1])
    words = np.bincount(line[word_start], minlength=n)[:n].astype(np.float64)
    own = np.zeros((n, OWN))
    size = np.maximum(lens, 1)[:, None]
    own[:, :CLASSES] = np.sqrt(counts / size)
    own[:, CLASSES] = np.log1p(lens)
    own[:, CLASSES + 1] = np.log1p(words)
    own[:, CLASSES + 2] = np.log1p(lens / np.maximum(words, 1))
    raw = block.tobytes()
    again = own[:, CLASSES + 3]
    at = begins.tolist()
    to = ends.tolist()
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a > 1:
            seen: set[bytes] = set()
            for i in range(a, b):
                text = raw[at[i] : to[i]]
                if text in seen:
                    again[i] = 1.0
                elif text:
                    seen.add(text)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([own, before, after, np.ones((n, 1))]), first, lens


def chains(scores: np.ndarray, first: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good against bad that reach each line from before it (its own score included) and from after it. tie[i, j]: of label j after i."""
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    starts, sorted_lens = first[:-1][order], lens[order]
    ahead, behind = scores.copy(), np.zeros_like(scores)
    longest = int(sorted_lens[0]) if len(sorted_lens) else 0
    active = np.searchsorted(-sorted_lens, -np.arange(1, longest + 1), side="right")
    for t in range(1, longest):
        i = starts[: active[t]] + t
        a = ahead[i - 1]
        ahead[i] = scores[i] + np.logaddexp(a + tie[1, 1], tie[0, 1]) - np.logaddexp(a + tie[1, 0], tie[0, 0])
    for t in range(longest - 2, -1, -1):
        i = starts[: active[t + 1]] + t
        c = scores[i + 1] + behind[i + 1]
        behind[i] = np.logaddexp(tie[1, 1] + c, tie[1, 0]) - np.logaddexp(tie[0, 1] + c, tie[0, 0])
    return ahead, behind


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    tie: np.ndarray

    def line_marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        ahead, behind = chains(((x - self.mean) / self.scale) @ self.weights, first, self.tie)
        return sigmoid(ahead + behind)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The quality of each text of a run."""
        x, first, lens = lines_of(data, offsets)
        weight = np.maximum(lens, 1).astype(np.float64)
        good = self.line_marginals(x, first) * weight
        return np.clip(np.add.reduceat(good, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1) if len(first) > 1 else np.zeros(0)


def mean_marginals(scores: np.ndarray, first: np.ndarray, tie: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each document's mean marginal, weighted by its lines' bytes."""
    ahead, behind = chains(scores, first, tie)
    return np.add.reduceat(sigmoid(ahead + behind) * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def tilts(scores: np.ndarray, first: np.ndarray, tie: np.ndarray, weight: np.ndarray, labels: np.ndarray, steps: int = 10) -> np.ndarray:
    """For each document what its lines' scores need so that its mean marginal is on its label's side of ``MEANS``; 0 if it is."""
    lens = np.diff(first)
    now = mean_marginals(scores, first, tie, weight)
    off = np.where(labels == 1, now < MEANS[1], now > MEANS[0])
    low, high = np.where(labels == 1, 0.0, -16.0), np.where(labels == 1, 16.0, 0.0)
    goal = np.where(labels == 1, MEANS[1], MEANS[0])
    for _ in range(steps):
        middle = (low + high) / 2
        under = mean_marginals(scores + np.repeat(middle, lens), first, tie, weight) < goal
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return np.where(off, (low + high) / 2, 0)


def train(x: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, decay: float = 1e-3, tied: bool = True) -> Model:
    """Fit by gradient ascent on the mean log likelihood of a line, each document counting once. ``tied``: whether neighbours are tied, for comparison."""
    lens = np.diff(first)
    y = np.repeat(labels, lens).astype(np.float64)
    share = np.repeat(1 / (np.maximum(lens, 1) * len(lens)), lens)
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale < 1e-6] = 0, 1
    z = (x - mean) / scale
    theta = np.zeros(z.shape[1] + 4)
    theta[-4:] = [0.5, 0, 0, 0.5] if tied else 0
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    now = np.flatnonzero(inner)
    sure = np.zeros((4, len(now)))
    sure[(2 * y[now - 1] + y[now]).astype(np.int64), np.arange(len(now))] = 1

    def expected(s: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of lines and of pairs of neighbours."""
        ahead, behind = chains(s, first, tie)
        a, c = ahead[now - 1], s[now] + behind[now]
        pair = np.stack([np.full_like(a, tie[0, 0]), tie[0, 1] + c, a + tie[1, 0], a + tie[1, 1] + c])
        pair = np.exp(pair - pair.max(0))
        return sigmoid(ahead + behind), pair / pair.sum(0)

    moment, square, tilt = np.zeros_like(theta), np.zeros_like(theta), None
    for k in range(1, rounds + 1):
        tie = theta[-4:].reshape(2, 2)
        s = z @ theta[:-4]
        line, pair = expected(s, tie)
        if k <= WARM:
            wanted, wanted_pair = y, sure
        else:
            if tilt is None or k % 10 == 0:
                tilt = np.repeat(tilts(s, first, tie, weight, labels), lens)
            wanted, wanted_pair = expected(s + tilt, tie)
        grad = np.zeros_like(theta)
        grad[:-4] = z.T @ (share * (wanted - line))
        if tied:
            grad[-4:] = ((wanted_pair - pair) * share[now]).sum(1)
        grad -= decay * theta
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        theta += 0.1 * (moment / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """Train on labelled documents outside the held-out fold (crc32 of the id, modulo 5, is 0); None without both labels."""
    known = labels.select("doc_id", "quality").filter("quality IN (0, 1)").filter(fold_of(F.col("doc_id"), 5) != 0)
    parts = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * per_label rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) < LINES).select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality = batch.column("quality").to_pylist()
            for at, end, data, offsets in text_runs(batch.column("text"), 1 << 20):
                x, first, lens = lines_of(data, offsets)
                packed = [x[first[i] : first[i + 1]].astype(np.float32).tobytes() for i in range(end - at)]
                sizes = [lens[first[i] : first[i + 1]].astype(np.float32).tobytes() for i in range(end - at)]
                yield pa.RecordBatch.from_arrays([pa.array(quality[at:end], pa.int32()), pa.array(packed, pa.binary()), pa.array(sizes, pa.binary())], ["quality", "lines", "bytes"])

    python_ready(docs.sparkSession)
    rows = texts.mapInArrow(run, "quality int, lines binary, bytes binary").collect()
    rows.sort(key=lambda r: (r["quality"], bytes(r["lines"])))  # the fit doesn't depend on the order of tasks
    marks = np.array([r["quality"] for r in rows])
    if len(set(marks.tolist())) < 2:
        return None
    blocks = [np.frombuffer(r["lines"], np.float32).reshape(-1, WIDTH).astype(np.float64) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    weight = np.maximum(np.concatenate([np.frombuffer(r["bytes"], np.float32) for r in rows]), 1).astype(np.float64)
    return train(np.vstack(blocks), first, marks, weight)


def _scored(model: Model | None, texts: pa.Array) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    if model is not None:
        for first, end, data, offsets in text_runs(texts):
            out[first:end] = model.scores(data, offsets)
    return out


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(_scored(model, batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), scores], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def label_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, line (from 0), n_bytes, marginal (of being good) and good of every line of every row."""
    model = fit(docs, labels)
    names = ["doc_id", "line", "n_bytes", "marginal", "good"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for at, _, data, offsets in text_runs(batch.column("text")):
                x, first, lens = lines_of(data, offsets)
                good = np.full(len(lens), 0.5) if model is None else model.line_marginals(x, first)
                of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + of)), pa.array(np.arange(len(lens)) - first[of]), pa.array(lens), pa.array(good), pa.array(good >= 0.5)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, line bigint, n_bytes bigint, marginal double, good boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose quality reaches the threshold."""
    model, column = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(model, batch.column(column)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
