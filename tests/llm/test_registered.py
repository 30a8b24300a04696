"""The registered queries over whole small tables, against libraries and brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_native import brute as brute_spans
from test_search import brute as brute_components
from test_text import brute_rules

from sliceworks.llm import mixing, vafile
from sliceworks.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name,sql", [("op1_source_mix", mixing.REPORT_SQL), ("op8_vafile_topk", vafile.SEARCH_SQL)])
def test_queries_with_sql(spark, name, sql):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.sql(sql)
    found = QUERIES[name](spark, SF).select(*expected.columns).collect()
    rounded = lambda some: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in some)
    assert rounded(found) == rounded(expected.fetchall())


def test_components(spark, texts):
    expected = brute_components(list(texts.items()), 2)
    found = rows(spark, "op3_bottom_k_dedup")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected and len(found) == len(texts)


def test_rules(spark, texts):
    found = rows(spark, "op5_divergence_rules")
    assert len(found) == len(texts)
    for r in found:
        base = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert base == brute_rules(texts[r["doc_id"]])
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r["kept"] and r["base_failed"])


def test_token_counts(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    found = rows(spark, "op6_token_counts")
    assert len(found) == len(texts)
    for r in found:
        n = len(model.encode(texts[r["doc_id"]] or ""))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 4096)


def test_shards(spark, texts):
    places, load = defaultdict(list), Counter()
    for r in rows(spark, "op7_virtual_slots"):
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "bytes")
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert sum(map(len, places.values())) == len(texts) and set(places) <= set(range(40))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_digests(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    found = rows(spark, "op9_bpe_digests")
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_personal_data(spark, texts):
    found = rows(spark, "op10_weak_pii")
    assert len(found) == len(texts)
    for r in found:
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) == brute_spans(texts[r["doc_id"]])
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert r["n_spans"] == len(spans)
        base = [s for s in spans if s[0] in ("email", "ip", "card", "phone")]
        assert hashlib.sha256(",".join(":".join(s) for s in base).encode()).hexdigest() == r["base_sha256"]


def test_predictions(spark, texts):
    quality, languages = rows(spark, "op2_line_crf"), rows(spark, "op4_language_id")
    assert len(quality) == len(languages) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in quality)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in languages)
