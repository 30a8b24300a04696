"""Quality rules by distribution divergence.

Per language a reference is summed over all its documents that pass the base rules: a histogram of character classes
and one of common words. The common words of a language are learned: the ``COMMON`` short words that most of its documents
hold. Junk blurs such sums, so they are made twice, the second time over the documents that the
first references keep. A document is held against its own language's reference by the Jensen-Shannon distance (the square root of
the divergence in bits, 0 to 1).

What is far is learned as well. Over the documents of a reference the distances have a median and a spread (the median absolute
deviation, as a standard deviation). A document goes if it lies ``FAR`` spreads beyond the median in either histogram, or ``BOTH_FAR`` in
both. Few words scatter more, so from the distance of words goes first what chance alone makes of as many words. Guards:
a text with fewer than ``MIN_CHARS`` characters isn't judged by its characters, one with fewer than ``MIN_WORDS`` words not by its words.

The text is read twice, for the words and for what is counted; that goes to a narrow table in the shared folder, from which the references are
summed and all rows judged. A language has a reference with ``REFERENCE_DOCS`` documents and ``REFERENCE_WORDS`` words or more, so that a few
documents of junk make none; documents of other languages, or of none, are held against one reference, whose two distances sum to the least.

Cases: a null or empty text has no words and fails the base rules; without any reference only the base rules hold;
repeated rows are judged alike and each count in a reference; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import python_ready, stash, unstash

MIN_CHARS = 300
MIN_WORDS = 50
COMMON = 40
COMMON_SHARE = 0.1  # of a language's documents hold a common word at least
LONGEST = 12  # bytes of a common word
FAR = (40.0, 4.0)  # spreads, for characters and for words
BOTH_FAR = (12.0, 1.0)
LEAST_SPREADS = (0.004, 0.01)
REFERENCE_DOCS, REFERENCE_WORDS = 20, 5000
SYMBOLS = "#*$%&|<>"
HELD = 200_000  # words that a task counts before it passes them on
BROADCAST_LANGUAGES = 100_000

N_WORDS = COMMON + 1  # and all others
N_CLASSES = 13
_EDGE = b".,;:!?'\"()-"
FEATURES = "doc_id bigint, lang string, own int, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, classes array<int>, common array<int>"


def _class_of(c: str) -> int:
    if c in " \t\n\r\x0b\x0c":
        return 0
    if c == "|":
        return 12
    if c in SYMBOLS:
        return 8
    if c in ".,;:?'\"-()":
        return 6
    if c == "!":
        return 7
    kind = unicodedata.category(c)
    if kind == "Ll":
        return 1 if c < "\x80" else 3
    if kind == "Lu":
        return 2 if c < "\x80" else 4
    if kind[0] in "LM":
        return 5
    return {"N": 9, "P": 10, "S": 10}.get(kind[0], 11)


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(np.array([_class_of(chr(c)) for c in range(0x10000)] + [11] * (sys.maxunicode + 1 - 0x10000), np.uint8))
    return _CLASSES[0]


def repeated(words: list[bytes]) -> int:
    """How many words lie in a window of three words that the text holds twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


class Plain(dict):
    """Of a word the form that is compared: without marks at its ends, in lower case; None for longer ones. Forms are kept, ``HELD`` at most."""

    def __missing__(self, word: bytes) -> str | None:
        if len(self) > HELD:
            self.clear()
        found = self[word] = word.strip(_EDGE).decode().lower() or None if len(word) <= LONGEST else None
        return found


class Places(dict):
    """Of a word the (language, place) pairs at which its form is a common word; kept likewise."""

    def __init__(self, of_form: dict[str, list[tuple[int, int]]]):
        super().__init__()
        self.of_form, self.plain = of_form, Plain()

    def __missing__(self, word: bytes) -> list[tuple[int, int]]:
        if len(self) > HELD:
            self.clear()
        found = self[word] = self.of_form.get(self.plain[word], [])
        return found


def describe(text: str | None) -> tuple[int, int, int, int, int, list[int], Counter]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the histogram of classes and how often each word is there."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = Counter(x for x in raw.split(b"\n") if x and not x.isspace())
    spaces = sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    histogram = np.bincount(classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=N_CLASSES).tolist()
    return len(words), len(text) - spaces, sum(text.count(c) for c in SYMBOLS), sum(lines.values()) - len(lines), repeated(words), histogram, Counter(words)


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """Of each language with enough documents and words its common words: the short ones that most of its documents of ``MIN_WORDS`` words or more hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, sums = Plain(), defaultdict(Counter)

        def counted() -> pa.RecordBatch:
            langs, words, numbers = [], [], []
            for lang, counts in sums.items():
                langs += [lang] * len(counts)
                words += counts
                numbers += counts.values()
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(numbers, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held = text.as_py().encode().split()
                if len(held) >= MIN_WORDS:
                    forms = set(map(plain.__getitem__, set(held)))
                    forms.add(None)  # counts documents
                    sums[lang].update(forms)
                    sums[lang][""] += len(held)
            if sum(map(len, sums.values())) > HELD:
                yield counted()
        yield counted()

    python_ready(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = stash(known.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "divergence-words")
    totals = counts.filter("word IS NULL OR word = ''").groupBy("lang").agg(F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("docs"), F.max(F.when(F.col("word") == "", F.col("n"))).alias("words"))
    many = stash(totals.filter((F.col("docs") >= REFERENCE_DOCS) & (F.col("words") >= REFERENCE_WORDS)).select("lang", "docs"), "divergence-languages")
    rows = many.select("lang").collect()  # a row a language with enough documents
    many = F.broadcast(many) if len(rows) <= BROADCAST_LANGUAGES else many
    often = counts.filter("word <> ''").join(many, "lang").filter(F.col("n") >= COMMON_SHARE * F.col("docs"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    found: dict[str, list[str]] = {r["lang"]: [] for r in rows}
    for r in often.withColumn("_r", rank).filter(F.col("_r") <= COMMON).orderBy("lang", "_r").collect():  # COMMON rows each
        found[r["lang"]].append(r["word"])
    unstash(counts)
    return dict(sorted(found.items()))


def features(docs: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """One narrow row a document. own: the place of its language, null if that has no reference; common: the histogram of its own language's common words, or those of all languages."""
    own = {lang: i for i, lang in enumerate(common)}
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for lang, words in common.items():
        for at, word in enumerate(words):
            places[word].append((own[lang], at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places_of = Places(places)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [describe(t) for t in part.column("text").to_pylist()]
                mine = [own.get(x) for x in part.column("lang").to_pylist()]
                histograms = []
                for (n, *_, counts), language in zip(columns, mine, strict=True):
                    every = np.zeros((len(own), N_WORDS), np.int32) if language is None else np.zeros((1, N_WORDS), np.int32)
                    for word, times in counts.items():
                        for k, place in places_of[word]:
                            if language is None or k == language:
                                every[k if language is None else 0, place] += times
                    every[:, -1] = n - every[:, :-1].sum(1)
                    histograms.append(every.ravel())
                numbers = [pa.array([c[i] for c in columns], pa.int64()) for i in range(5)]
                lists = [pa.array([c[5] for c in columns], pa.list_(pa.int32())), pa.array(histograms, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("lang"), pa.array(mine, pa.int32()), *numbers, *lists], [f.split()[0] for f in FEATURES.split(", ")])

    python_ready(docs.sparkSession)
    return docs.select("doc_id", "lang", "text").mapInArrow(run, FEATURES)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


References = tuple[np.ndarray, np.ndarray]
Limits = dict[int, tuple[float, float, float, float]]


def references(good: DataFrame, languages: int) -> References:
    """Histograms of classes and of common words of each language, over its documents that pass the base rules."""
    counted = good.filter(F.col("own").isNotNull() & ~base_failed())
    sums = counted.select("own", F.posexplode(F.concat("classes", "common")).alias("at", "n")).groupBy("own", "at").agg(F.sum("n").alias("n")).collect()  # languages * bins rows at most
    out = np.zeros((languages, N_CLASSES + N_WORDS))
    for r in sums:
        out[r["own"], r["at"]] = r["n"]
    return out[:, :N_CLASSES], out[:, N_CLASSES:]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of histograms p from histograms q along the last axis. An empty histogram p is at distance 0."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip(d / 2, 0, 1)) * (p.sum(-1) > 0)


def by_chance(n: np.ndarray) -> np.ndarray:
    """About the distance of n words drawn from a reference to it."""
    return np.sqrt((N_WORDS - 1) / (8 * math.log(2) * np.maximum(n, 1)))


def distances(rows: DataFrame, refs: References) -> DataFrame:
    """The rows with ref (the language whose reference they are held against), char_distance, word_distance and word_excess, what is beyond chance; all null without references."""
    class_refs, word_refs = refs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, known = part.num_rows, part.column("own").is_valid().to_numpy(zero_copy_only=False)
                chars = np.array(part.column("classes").to_pylist(), float).reshape(n, N_CLASSES)
                common = part.column("common")
                near, char_d, word_d, excess = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
                some = np.flatnonzero(known)
                own = near[some] = part.column("own").filter(pa.array(known)).to_numpy()
                words = np.array(common.filter(pa.array(known)).to_pylist(), float).reshape(len(some), N_WORDS)
                char_d[some], word_d[some] = distance(chars[some], class_refs[own]), distance(words, word_refs[own])  # row by row
                excess[some] = word_d[some] - by_chance(words.sum(1))
                for i in np.flatnonzero(~known) if len(class_refs) else []:
                    words = np.array(common[i].as_py(), float).reshape(-1, N_WORDS)
                    by_class, by_word = distance(chars[i], class_refs), distance(words, word_refs)
                    near[i] = best = (by_class + by_word).argmin()
                    char_d[i], word_d[i] = by_class[best], by_word[best]
                    excess[i] = by_word[best] - by_chance(words[best].sum())
                none = np.full(n, not len(class_refs))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.int32(), mask=none), *[pa.array(x, mask=none) for x in (char_d, word_d, excess)]], names=[*part.schema.names, "ref", "char_distance", "word_distance", "word_excess"])

    return rows.mapInArrow(run, FEATURES + ", ref int, char_distance double, word_distance double, word_excess double")


def spreads(judged: DataFrame) -> Limits:
    """Per reference the median and the spread of its own documents' distances: of characters, then of words beyond chance."""
    own = judged.filter(F.col("own").isNotNull() & ~base_failed())
    middle = own.groupBy("own").agg(*[F.percentile_approx(c, 0.5, 2000).alias(f"m_{c}") for c in ("char_distance", "word_excess")])
    off = own.join(F.broadcast(middle), "own")  # a row a language
    rows = off.groupBy("own").agg(*[F.first(f"m_{c}").alias(f"m_{c}") for c in ("char_distance", "word_excess")], *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 2000).alias(f"s_{c}") for c in ("char_distance", "word_excess")]).collect()
    return {r["own"]: (r["m_char_distance"], max(LEAST_SPREADS[0], 1.4826 * r["s_char_distance"]), r["m_word_excess"], max(LEAST_SPREADS[1], 1.4826 * r["s_word_excess"])) for r in rows}


def near(limits: Limits) -> F.Column:
    """Whether a row lies within the limits of its reference; without one it does."""
    if not limits:
        return F.lit(True)

    def spread(column: str, k: int) -> F.Column:
        middle = F.create_map(*[F.lit(x) for own, v in limits.items() for x in (own, float(v[k]))])
        width = F.create_map(*[F.lit(x) for own, v in limits.items() for x in (own, float(v[k + 1]))])
        return (F.col(column) - F.try_element_at(middle, F.col("ref"))) / F.try_element_at(width, F.col("ref"))

    chars = F.when(F.aggregate("classes", F.lit(0), lambda a, x: a + x) >= MIN_CHARS, spread("char_distance", 0))
    words = F.when(F.col("n_words") >= MIN_WORDS, spread("word_excess", 2))
    far = [F.coalesce(x > limit, F.lit(False)) for x, limit in ((chars, FAR[0]), (words, FAR[1]), (chars, BOTH_FAR[0]), (words, BOTH_FAR[1]))]
    return ~(far[0] | far[1] | (far[2] & far[3]))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance and word_distance of every row."""
    common = common_words(docs)
    rows = stash(features(docs, common), "divergence")
    first = stash(distances(rows, references(rows, len(common))), "divergence-first")
    kept = first.filter(near(spreads(first))).select(*rows.columns)
    judged = stash(distances(rows, references(kept, len(common))), "divergence-judged")
    unstash(rows, first)
    limits = spreads(judged)
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(*counts, base_failed().alias("base_failed"), (~base_failed() & near(limits)).alias("kept"), "char_distance", "word_distance")
