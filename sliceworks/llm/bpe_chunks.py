"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts texts where its value, not the place, says so; hence a passage that many documents
share is cut alike in all of them. A chunk is encoded once for each Python worker that meets it and then reused: the
ids of its inside, from its first to its last white space, are kept under its bytes. The ends of a chunk are only
provisional: the join between two chunks is repaired by encoding again the stretch around the cut, widened chunk by
chunk until white space on both sides bounds it. There both encodings agree exactly, since the tokenizer splits
off white space before any merge, so no token, normalisation or special string reaches across it.

Inside a chunk the ids of single words are reused as well. Both memories belong to the Python worker, outlast its tasks
and are bounded: a full one becomes the old one, from which what is met again is taken over. Words are learned for
``CHUNKS_AT_ONCE`` new chunks at a time, between which a full memory gives way. So a task's memory doesn't
grow with its input, and a run of nothing but new words is no exception; nothing is shuffled. The worker goes on to other stages
with what it keeps, beside the executor's heap. An executor that is lost costs its tasks alone.

Cases: a null or empty text has no ids and decodes to the empty text; a text without white space is one stretch,
encoded as a whole; repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import python_ready, text_runs

RUN = 2 << 20  # bytes of text that are encoded at once
MASK_BITS = 10  # a cut every 1024 bytes on average
WINDOW = 16
WORDS_KEPT = 160_000
CHUNKS_KEPT = 4_096
CHUNKS_AT_ONCE = 256  # the words of so many new chunks are learned together
LONG_WORD = 64
SPACES = b" \t\n\r\x0b\x0c"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where the rolling hash of the ``WINDOW`` bytes before them cuts; never within a character."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    at = np.flatnonzero((h >> np.uint32(16)) & np.uint32((1 << MASK_BITS) - 1) == 0) + 1
    at = at[at < len(data)]
    for _ in range(3):
        inside = (data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80
        at = at + inside
    return np.unique(at[at < len(data)])


class Codec:
    """A tokenizer with its memories of words and chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None:
            raise ValueError("decoding by joining tokens with blanks holds for tokenizers without a decoder")
        self.names = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes | None, bytes]] = {}

    def _learn(self, words: set[bytes]) -> None:
        new = list(words)
        for word, got in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            self.words[word] = np.array(got.ids, dtype="<u4").tobytes()

    def _stretch(self, raw: bytes) -> bytes:
        """Ids of a stretch that starts and ends at white space or at the text's ends."""
        kept = self.words.get(raw) or self.old_words.get(raw)
        if kept is not None:
            return kept
        if len(raw) > LONG_WORD:
            return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        self._learn({raw})
        return self.words[raw]

    def _split(self, chunk: bytes) -> tuple[bytes, list[bytes] | None, bytes]:
        """The stretch before a chunk's first white space, the words inside, the stretch after its last; no inside without white space."""
        tail = chunk.rsplit(None, 1)
        if len(chunk) and chunk[-1:] in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"):
            words, end = chunk.split(), b""
        else:
            words, end = chunk.split(), tail[-1]
            if len(end) == len(chunk):
                return chunk, None, b""
            words = words[:-1]
        if chunk[0] in SPACES:
            return b"", words, end
        return (words[0], words[1:], end) if words else (b"", [], end)

    def _enter(self, new: list[bytes]) -> None:
        """Keep the ids of the insides of new chunks."""
        if len(self.words) > WORDS_KEPT:
            self.words, self.old_words = {}, self.words
        split = {c: self._split(c) for c in new}
        known = self.words
        missing = {w for _, inside, _ in split.values() for w in inside or () if w not in known and len(w) <= LONG_WORD}
        known |= {w: self.old_words[w] for w in missing if w in self.old_words}
        self._learn({w for w in missing if w not in known})
        for c, (head, inside, end) in split.items():
            ids = None if inside is None else b"".join([known[w] if w in known else self._stretch(w) for w in inside])
            self.chunks[c] = head, ids, end

    def encode(self, texts: list[bytes], chunked: list[list[bytes]]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, given as its chunks."""
        if len(self.chunks) > CHUNKS_KEPT:
            self.chunks.clear()
        new = [c for c in {c for cs in chunked for c in cs} if c not in self.chunks]
        for at in range(0, len(new), CHUNKS_AT_ONCE):
            self._enter(new[at : at + CHUNKS_AT_ONCE])
        out = []
        for cs in chunked:
            parts: list[bytes] = []
            open_end = b""
            for c in cs:
                head, ids, end = self.chunks[c]
                open_end += head
                if ids is None:  # no white space: the stretch around the cut widens
                    continue
                if open_end:
                    parts.append(self._stretch(open_end))
                parts.append(ids)
                open_end = end
            if open_end:
                parts.append(self._stretch(open_end))
            out.append(b"".join(parts))
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text of ids, special tokens included."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The Python worker's codec, kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(codec: Codec, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows: the first row's place, and the ids of each."""
    for first, _, data, offsets in text_runs(column, RUN):
        base = int(offsets[0])
        block = data[base : int(offsets[-1])]
        places = cuts(block) + base
        raw = block.tobytes()
        texts, chunked = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            inner = places[np.searchsorted(places, a + WINDOW) : np.searchsorted(places, b)].tolist()
            limits = [a, *inner, b]
            texts.append(raw[a - base : b - base])
            chunked.append([raw[x - base : y - base] for x, y in zip(limits[:-1], limits[1:], strict=True) if y > x])
        yield first, codec.encode(texts, chunked)


def _coded(docs: DataFrame, tokenizer_path: str, with_ids: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for batch in batches:
            for first, ids in encoded(codec, batch.column("text")):
                columns = [
                    batch.column("doc_id").slice(first, len(ids)).cast(pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(i)).hexdigest() for i in ids], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, NAMES[: len(columns)])
        pa.default_memory_pool().release_unused()  # the worker stays, and other stages use it

    python_ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids array<int>" if with_ids else SCHEMA)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (array of int) of every row. ``tokenizer_path`` must exist on every executor."""
    return _coded(docs, tokenizer_path, True)


def decode_documents(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text that ``ids`` decode to, special tokens included; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [codec.decode(np.array(i or [], "<u4").tobytes()).decode() for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    python_ready(rows.sparkSession)
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, without moving ids out of the task."""
    return _coded(docs, tokenizer_path, False)
