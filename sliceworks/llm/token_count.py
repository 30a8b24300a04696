"""Token counts of whole texts by overlap resynchronisation.

A text of at most ``CHUNK`` bytes is encoded as it is. A longer one is cut into overlapping chunks with known offsets,
each encoded alone. Two neighbours are spliced at a byte where both encodings have a token boundary and which is
proven stable: a blank after a non-blank. No piece of the vocabulary holds a blank after another character (this is
checked when the model loads), so no merge ever spans such a byte, and what lies right of it is encoded alike whatever
lies left. If the overlap has no such byte, it is widened; where a whole chunk has none, the chunk grows once, to the next such byte.

Offsets come from the pieces' lengths in bytes, so nothing but ids leaves the tokenizer. A literal U+2581 gives the same
pieces as a blank (checked when the model loads), so a long text is cut with blanks in its place. Where the lengths
don't add up to a chunk's end, the offsets are unknown and the text is encoded whole. Memory: one chunk's ids, or one text's.

Cases: a null or empty text has no tokens; a text without blanks ends as one chunk; repeated rows count each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import python_ready

CHUNK = 16_384
OVERLAP = 512
LIMIT = 4096
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

BLANK = "▁"  # how pieces spell a blank


_STABLE = re.compile(rb"[^ ] ")


class _UnknownOffsets(Exception):
    """The pieces' lengths don't add up to the bytes of a chunk."""


class Counter:
    """A sentencepiece model with the lengths of its pieces in bytes of text."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        for i, piece in enumerate(pieces):
            if BLANK in piece.lstrip(BLANK) and not self.model.is_control(i):
                raise ValueError(f"piece {piece!r} holds a blank after another character: no byte is proven stable")
        if any(self.model.encode(t) != self.model.encode(t.replace(BLANK, " ")) for t in (f"{BLANK}a{BLANK}b {BLANK}", f"a {BLANK}{BLANK}b", f"x{BLANK}{BLANK}{BLANK}")):
            raise ValueError("a literal U+2581 is encoded otherwise than a blank: offsets are not known")
        self.lengths = np.array([1 if self.model.is_byte(i) else len(p.replace(BLANK, " ").encode()) for i, p in enumerate(pieces)], np.int64)

    def ends(self, raw: bytes, start: int, end: int, stable: bool) -> np.ndarray:
        """Where the tokens of raw[start:end] end, in bytes of ``raw``, which has no U+2581.

        The model puts a blank in front. At a stable start it stands for the blank that is there; elsewhere it has no byte.
        """
        text = raw[start + 1 : end] if stable else raw[start:end]
        sizes = self.lengths[np.array(self.model.encode(text.decode(), num_threads=1), np.int64)]
        found = start + np.cumsum(sizes) - (0 if stable else 1)
        if len(found) and found[-1] != end:
            raise _UnknownOffsets
        return found

    def long(self, raw: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of a long text, chunk by chunk. ``start`` is 0 or a stable byte; what lies before it is counted."""
        total, start, end = 0, 0, _cut(raw, chunk)
        left = self.ends(raw, start, end, False)
        while end < len(raw):
            last = _last_stable(raw, start + 1, end)
            if last is None:  # nothing to splice at: this stretch grows to the next stable byte and is encoded again as one
                end = _cut(raw, min(len(raw), _next_stable(raw, end) + overlap))
                left = self.ends(raw, start, end, start > 0)
                continue
            wide = max(overlap, end - last + 8)
            while True:
                begin = _cut(raw, max(start, end - wide))
                new_end = _cut(raw, max(begin + chunk, end + overlap))
                right = self.ends(raw, begin, new_end, False)
                both = np.intersect1d(left, right[(right < end) & (right > begin)])
                at = next((int(p) for p in both[::-1] if raw[p] == 32 and raw[p - 1] != 32), None)
                if at is not None or begin == start:
                    break
                wide *= 2
            if at is None:  # nothing stable between start and end: this stretch grows, and is encoded again as one
                end = _cut(raw, end + max(chunk, end - start))
                left = self.ends(raw, start, end, start > 0)
                continue
            total += int(np.searchsorted(left, at, side="right"))
            start, end, left = at, new_end, right[right > at]
        return total + len(left)

    def counts(self, texts: list[str | None], chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
        raws = [(t or "").encode() for t in texts]
        short = [i for i, r in enumerate(raws) if len(r) <= chunk]
        out = [0] * len(raws)
        for at in range(0, len(short), 64):
            some = short[at : at + 64]
            for i, ids in zip(some, self.model.encode([texts[i] or "" for i in some], num_threads=1), strict=True):
                out[i] = len(ids)
        for i, r in enumerate(raws):
            if len(r) > chunk:
                try:
                    out[i] = self.long(texts[i].replace(BLANK, " ").encode(), chunk, overlap)
                except _UnknownOffsets:
                    out[i] = len(self.model.encode(texts[i], num_threads=1))
        return [len(r) for r in raws], out


def _last_stable(raw: bytes, low: int, high: int) -> int | None:
    """The last blank after a non-blank in raw[low:high]."""
    blank = raw.rfind(b" ", low, high)
    if blank < 0:
        return None
    at = low + len(raw[low : blank + 1].rstrip(b" "))
    return at if at > low else None


def _next_stable(raw: bytes, at: int) -> int:
    """The first such blank from ``at`` on, or the end."""
    found = _STABLE.search(raw, at - 1)
    return found.start() + 1 if found else len(raw)


def _cut(raw: bytes, at: int) -> int:
    """The first place from ``at`` on that does not split a character."""
    at = min(at, len(raw))
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. ``model_path`` must exist on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size, n = counter.counts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    python_ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
