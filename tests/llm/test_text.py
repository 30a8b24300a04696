"""Quality, language, rules, tokens: libraries, brute force, held-out accuracy, edge cases."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sliceworks.llm import bpe_chunks, divergence, langid, quality_crf, token_count
from sliceworks.llm.queries import QUERIES, tokenizer_file
from sliceworks.llm.shared import text_runs

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, score string, n_words int"
ODD = [None, "", " ", "\n\n", "a", "Ünï", "same", "same", "x" * 30000, "word " * 8000, "日本語" * 2000, "1234 !!"]


def odd(spark):
    return spark.createDataFrame([(i, t, [None, "en", "fr"][i % 3], "s", "clash", 1) for i, t in enumerate(ODD)] + [(None, "no id", "en", None, "clash", 1)], DOCS)


@pytest.fixture(scope="module")
def counter():
    return token_count.Counter(tokenizer_file("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return bpe_chunks.Codec(tokenizer_file("word_bpe_49k.json"))


TEXTS = ["", " ", "  a  b ", "a\x0bb\x0cc\td\x1ce\x85f\xa0g h", "<s> </s> <unk> <|startoftext|> hi<|endoftext|>there", "it's we've I'LL", "İSTANBUL ΣΑΣ", "日本語テキスト" * 300, "x" * 40000, "a b" * 3000, "  " * 4000, "ab  cd\n" * 3000, "q" * 20000 + " " + "z" * 20000, "ﬁ①²½ é", "▁ x▁y"]


@pytest.mark.parametrize("chunk,overlap", [(16384, 512), (200, 8), (64, 2)])
def test_counts_equal_the_library(counter, chunk, overlap):
    texts = TEXTS if chunk > 64 else [t[:3000] for t in TEXTS]
    _, n = counter.counts(texts, chunk, overlap)
    assert n == [len(x) for x in counter.model.encode(texts)]


def test_counts_with_literal_blank_marks(counter):
    """U+2581 before, in and after an overlap, in texts of 40 KB: it is one byte to a piece and three to the text."""
    rng = random.Random(5)
    wrong = []
    for at in (0, 8000, 15800, 15900, 16000, 16200, 16380, 16500, 20000, 32000):
        for mark in ("piece ▁the ", "▁", "▁▁ ", "a▁b▁c "):
            for n in (1, 2, 3):
                prose = " ".join("".join(rng.choice("etaoinsr") for _ in range(rng.randrange(1, 5))) for _ in range(13000))[:40000]
                text = prose[:at] + mark * n + prose[at:]
                if counter.counts([text])[1] != [len(counter.model.encode(text))]:
                    wrong.append((at, mark, n))
    assert wrong == []


def test_counts_without_blanks_are_spliced_once(counter, monkeypatch):
    """A text of a megabyte with few blanks or none: right, and each byte is encoded a few times at most."""
    rng, encoded = random.Random(6), []
    run = "".join(rng.choice("abcdefgh日") for _ in range(700_000))
    ends = token_count.Counter.ends
    monkeypatch.setattr(token_count.Counter, "ends", lambda self, raw, start, end, stable: encoded.append(end - start) or ends(self, raw, start, end, stable))
    for text in (run, run[:300_000] + " " + run[300_000:], run[:20_000] + "▁" * 9000 + run[20_000:90_000], "a " + run[:100_000] + " b " * 30_000):
        encoded.clear()
        assert counter.counts([text])[1] == [len(counter.model.encode(text))]
        assert sum(encoded) < 3 * len(text.encode())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" a bcé\n日x.▁", max_size=400))
def test_counts_of_any_text(counter_text):
    counter = _kept(lambda: token_count.Counter(tokenizer_file("piece_bpe_32k.model")))
    assert counter.counts([counter_text], 32, 4)[1] == [len(counter.model.encode(counter_text))]


_KEPT: list = []


def _kept(make):
    if not _KEPT:
        _KEPT.append(make())
    return _KEPT[0]


def test_ids_equal_the_library(codec):
    got = [i for _, ids in bpe_chunks.encoded(codec, pa.array(TEXTS)) for i in ids]
    expected = codec.tokenizer.encode_batch(TEXTS, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in expected]
    assert [codec.decode(g).decode() for g in got] == codec.tokenizer.decode_batch([e.ids for e in expected], skip_special_tokens=False)


def test_a_run_of_new_words_stays_within_the_memory_of_words(monkeypatch):
    codec, learn, most = bpe_chunks.Codec(tokenizer_file("word_bpe_49k.json")), bpe_chunks.Codec._learn, []
    monkeypatch.setattr(bpe_chunks, "WORDS_KEPT", 5_000)
    monkeypatch.setattr(bpe_chunks.Codec, "_learn", lambda self, words: (learn(self, words), most.append((len(words), len(self.words)))))
    texts = [" ".join(f"w{i:x}" for i in range(at, at + 1_000)) for at in range(0, 200_000, 1_000)]
    got = [i for _, ids in bpe_chunks.encoded(codec, pa.array(texts)) for i in ids]
    at_once, kept = map(max, zip(*most, strict=True))
    assert at_once < 60_000 and kept < 65_000 and len(codec.words) + len(codec.old_words) < 130_000  # of 200,000 words in one run of 1.3 MB
    expected = codec.tokenizer.encode_batch(texts[::20], add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got[::20]] == [e.ids for e in expected]


def test_shared_passages_are_cut_alike_and_reused(codec):
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(999)}" for _ in range(3000))
    cut = [set(passage[a:b] for a, b in itertools.pairwise(bpe_chunks.cuts(np.frombuffer((x + passage).encode(), np.uint8)) - len(x)) if a > 20) for x in ("", "another start ")]
    assert len(cut[0] & cut[1]) > 5
    before = len(codec.chunks)
    list(bpe_chunks.encoded(codec, pa.array([passage, "another start " + passage])))
    first = len(codec.chunks) - before
    list(bpe_chunks.encoded(codec, pa.array([passage] * 5)))
    assert len(codec.chunks) - before == first


def test_token_queries_on_odd_rows(spark):
    model, words = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")
    counted = token_count.count_tokens(odd(spark), model).collect()
    coded = bpe_chunks.digests(odd(spark), words).collect()
    assert len(counted) == len(coded) == len(ODD) + 1
    assert {r["doc_id"]: r["n_tokens"] for r in counted}[0] == 0
    assert {r["doc_id"]: r["ids_sha256"] for r in coded}[1] == hashlib.sha256(b"").hexdigest()
    none = odd(spark).limit(0)
    assert token_count.count_tokens(none, model).count() == 0 and bpe_chunks.digests(none, words).count() == 0
    back = bpe_chunks.decode_documents(bpe_chunks.encode_documents(odd(spark), words), words)
    assert {r["doc_id"]: r["text"] for r in back.collect()}[4] == "a</w>"


def test_runs_cover_all_rows():
    column = pa.array(["ab", None, "c" * 50, "", "d"])
    runs = list(text_runs(column.slice(1), 10))
    assert [r[:2] for r in runs] == [(0, 1), (1, 2), (2, 4)] or sum(e - f for f, e, *_ in runs) == 4
    assert b"".join(bytes(d[int(o[0]) : int(o[-1])]) for _, _, d, o in runs) == b"c" * 50 + b"d"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    scores, tie = rng.normal(size=6), rng.normal(size=(2, 2))
    weight = np.zeros(6)
    whole = 0.0
    for y in itertools.product((0, 1), repeat=6):
        p = np.exp(sum(s for s, v in zip(scores, y, strict=True) if v) + sum(tie[a, b] for a, b in itertools.pairwise(y)))
        whole += p
        weight += p * np.array(y)
    ahead, behind = quality_crf.chains(np.concatenate([[0.4], scores]), np.array([0, 1, 7]), tie)
    assert np.allclose(quality_crf.sigmoid(ahead + behind)[1:], weight / whole)


def test_lines_are_those_of_split():
    texts = ["a b\nCC", "", "\n", "x\n", None, "\n\nq q", "é!|\n", "a\na\n\na"]
    for first, end, data, offsets in text_runs(pa.array(texts)):
        x, starts, lens = quality_crf.lines_of(data, offsets)
        assert lens.tolist() == [len(line.encode()) for t in texts[first:end] for line in (t or "").split("\n")]
        assert x[:, quality_crf.CLASSES + 3].sum() == 2  # a repeated line, twice
        assert len(starts) == len(texts) + 1


def test_quality_on_held_out_rows(spark):
    scored = QUERIES["op2_line_crf"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.93 * len(rows)
    assert scored.count() == 1000


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (99, 1), (None, 1), (8, None), (9, 3)], "doc_id bigint, quality int")
    rows = quality_crf.score_documents(odd(spark), labels).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    unlabelled = quality_crf.score_documents(odd(spark), labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    assert quality_crf.score_documents(odd(spark).limit(0), labels).count() == 0
    assert quality_crf.keep_good(odd(spark), labels).columns == odd(spark).columns


def test_languages_on_held_out_rows(spark):
    found = QUERIES["op4_language_id"](spark, DATA).filter("held_out")
    lang = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = found.join(lang, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.97 * len(rows)


def test_languages_of_odd_rows(spark):
    rows = {r["doc_id"]: r for r in langid.identify(odd(spark)).collect()}
    assert len(rows) == len(ODD) + 1
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (0, 1, 2, 3, 11))
    assert rows[6]["lang_pred"] == rows[7]["lang_pred"]
    assert langid.identify(odd(spark).limit(0)).count() == 0


def test_many_languages_and_one_repeated_row(spark):
    """300 languages are all learned; a row that is there a thousand times counts once in the sample."""
    rng = random.Random(4)

    def word(k):
        return chr(0x4E00 + 7 * k) + rng.choice("abcdef") + chr(0x4E00 + 7 * k + 1 + rng.randrange(5))

    rows = [(k * 10 + i, " ".join(word(k) for _ in range(30)), f"l{k}") for k in range(300) for i in range(6)]
    rows += [(7, "always the same row", "l0")] * 1000
    docs = spark.createDataFrame([(i, t, k, "s", "x", 1) for i, t, k in rows], DOCS).repartition(4)
    found = langid.identify(docs).filter("held_out").join(docs.select("doc_id", "lang").distinct(), "doc_id").collect()
    assert len({r["lang_pred"] for r in found if r["doc_id"] != 7}) > 0.95 * len({r["lang"] for r in found}) > 250
    assert sum(r["lang_pred"] == r["lang"] for r in found) > 0.9 * len(found)


def test_training_finds_separable_classes():
    rng = np.random.default_rng(1)
    rows = [(c, np.arange(c * 50, c * 50 + 40), rng.random(40) + 1) for c in range(3) for _ in range(20)]
    rng.shuffle(rows)
    weights, bias = langid.train(rows, 3)
    assert all((v @ weights[b] + bias).argmax() == c for c, b, v in rows)
    assert (weights == 0).mean() > 0.9


def brute_rules(text):
    words = (text or "").encode().split()
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_rules_against_brute_force():
    for text in [*ODD[:8], "a b c a b c a b", "x\ny\nx\n\nx \nx", "# * $|<>& %", "a\xa0b\x1cc d"]:
        assert divergence.describe(text)[:5] == brute_rules(text)


def test_distances():
    p = np.array([[1.0, 0, 0], [0, 0, 0], [1, 1, 0]])
    assert np.allclose(divergence.distance(p, np.array([[0, 0, 5.0]])), [1, 0, 1])
    assert divergence.distance(p, p).tolist() == [0, 0, 0]


def test_rules_keep_clean_documents(spark):
    judged = QUERIES["op5_divergence_rules"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = judged.filter("NOT base_failed").join(labels, "doc_id").collect()
    clean, junk = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(clean) > 0.99 * len(clean) and sum(junk) < 0.1 * len(junk)


def test_rules_on_odd_rows(spark):
    rows = divergence.judge(odd(spark)).collect()
    assert len(rows) == len(ODD) + 1 and not any(r["kept"] for r in rows if r["base_failed"])
    assert divergence.judge(odd(spark).limit(0)).count() == 0


def test_each_language_has_its_own_reference(spark):
    """Neither another language without common words nor a few documents of junk keep what English would drop."""
    rng = random.Random(8)

    def text(common, chars="etaoinsrhld", n=300):
        made = ["".join(rng.choice(chars) for _ in range(rng.randrange(3, 9))) for _ in range(n)]
        return " ".join(rng.choice("the of and to in is that it for was".split()) if rng.random() < common else w for w in made)

    rows = [(i, text(0.4), "en") for i in range(40)] + [(100 + i, text(0), "xx") for i in range(40)]
    rows += [(200, text(0), "en"), (201, text(0.4), None)] + [(300 + i, text(0, "#*$%&|<>"), "zz") for i in range(3)]
    kept = {r["doc_id"]: r["kept"] for r in divergence.judge(spark.createDataFrame([(i, t, k, "s", "x", 1) for i, t, k in rows], DOCS)).collect()}
    assert all(kept[i] for i in [*range(40), *range(100, 140), 201])
    assert not any(kept[i] for i in (200, 300, 301, 302))


def test_tilts_bring_means_to_their_sides():
    rng = np.random.default_rng(3)
    first = np.array([0, 5, 6, 14])
    scores, weight, tie, labels = rng.normal(size=14), rng.random(14) + 0.5, np.array([[1.0, -1], [-1, 1.0]]), np.array([1, 0, 0])
    tilt = quality_crf.tilts(scores, first, tie, weight, labels, 30)
    after = quality_crf.mean_marginals(scores + np.repeat(tilt, np.diff(first)), first, tie, weight)
    assert np.allclose(after, [quality_crf.MEANS[1], *[quality_crf.MEANS[0]] * 2], atol=1e-4)
    assert (quality_crf.tilts(np.repeat([9.0, -9.0, -9.0], np.diff(first)), first, tie, weight, labels) == 0).all()


def test_ties_help_on_held_out_documents(spark):
    """The chain ranks held-out documents no worse than the same features without ties, and is right as often."""
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    known = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and (r["text"] or "").count("\n") < 400]
    known = [r for q in (0, 1) for r in [r for r in known if r["quality"] == q][:600]]

    def lines(some):
        x, first, lens = [], [0], []
        for *_, data, offsets in text_runs(pa.array([r["text"] for r in some])):
            f, at, n = quality_crf.lines_of(data, offsets)
            x.append(f)
            lens.append(n)
            first += (first[-1] + at[1:]).tolist()
        return np.vstack(x), np.array(first), np.maximum(np.concatenate(lens), 1).astype(float)

    x, first, weight = lines(known)
    hx, hfirst, hweight = lines(held)
    truth = np.array([r["quality"] for r in held])
    right = {}
    for tied in (True, False):
        model = quality_crf.train(x, first, np.array([r["quality"] for r in known]), weight, tied=tied)
        score = np.add.reduceat(model.line_marginals(hx, hfirst) * hweight, hfirst[:-1]) / np.add.reduceat(hweight, hfirst[:-1])
        right[tied] = ((score >= quality_crf.THRESHOLD) == truth).mean()
    assert right[True] > 0.98 and right[True] > right[False]


def test_lines_have_labels(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id bigint, quality int")
    rows = quality_crf.label_lines(odd(spark), labels).collect()
    assert len(rows) == sum((t or "").count("\n") + 1 for t in ODD) + 1
    assert all(0 <= r["marginal"] <= 1 and r["good"] == (r["marginal"] >= 0.5) for r in rows)
    assert sum(r["n_bytes"] for r in rows if r["doc_id"] == 8) == 30000
