"""Near-duplicates, top-k search and the pipeline, against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sliceworks.llm import near_dedup, vafile
from sliceworks.llm.queries import tokenizer_file

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows, width):
    sets = {}
    for i, text in rows:
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        sets[i] = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    shared = defaultdict(int)
    for found in lists.values():
        for a in range(len(found)):
            for b in range(a):
                shared[found[b], found[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def groups():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for size in (1, 2, 3, 5, 10, 30, 60, 80, 150, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(25):
            text = list(base)
            for _ in range(int(size * rng.choice([0, 0.02, 0.05, 0.08, 0.12]))):
                text[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rows += [None, "", "  \n", "One", "one", "É", "é", "x\x85y z\x1cq"]
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_components(spark, width):
    rows = groups()
    found = near_dedup.dedup(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), width).collect()
    assert len(found) == len(rows)
    expected = brute(rows, width)
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_pairs_at_the_threshold(spark):
    """Sets of about the sketch's size, each with one partner that is just similar enough or just not: none is lost."""
    rows, pairs = [], []
    for p in range(3000):
        a = 40 + p % 25
        b = min(64, a + p // 25 % 9)
        common = min(a, -(-80 * (a + b) // 180) - (p % 10 == 0))
        pairs.append((len(rows), 100 * common >= 80 * (a + b - common)))
        rows.append(" ".join(f"p{p}w{i}" for i in range(a)))
        rows.append(" ".join([f"p{p}w{i}" for i in range(common)] + [f"p{p}x{i}" for i in range(b - common)]))
    found = near_dedup.dedup(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], DOCS), 1)
    component = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert sum(alike for _, alike in pairs) > 2000 and sum(not alike for _, alike in pairs) >= 300
    assert [i for i, alike in pairs if (component[i + 1] == i) != alike] == []


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words are in this one"), (4, None), (5, ""), (None, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_decided_by_their_texts(spark):
    copy, near = "a b c d e f g", " ".join(f"n{i}" for i in range(60))
    rows = [(1, copy), (None, copy), (None, "words that no other row has here"), (None, "and these are once more others"), (None, ""), (None, None)]
    rows += [(5, copy), (5, "this text of a repeated id is alone"), (7, near), (7, near + " end"), (8, "x y z"), (8, "x y z"), (None, "p q r s t u"), (None, "p q r s t u")]
    kept = near_dedup.keep_one(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)).collect()
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept if r["doc_id"] != 7)
    assert found == [(0, ""), (0, ""), (0, "and these are once more others"), (0, "p q r s t u"), (0, "words that no other row has here"), (1, copy), (5, "this text of a repeated id is alone"), (8, "x y z")]
    assert sum(r["doc_id"] == 7 for r in kept) == 1


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(60)]  # a class of equal vectors, larger than k
    rows += [(400, None), (420, [None] * 16), (440, [float("nan")] * 16), (460, [float("inf")] * 16), (480, []), (500, [0.5] * 4)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score int")
    whole = {i: [int(np.floor(np.float64(x) * 64)) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = set()
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)[:20]
            expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    found = [tuple(r) for r in vafile.search(frame, block=7).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_top_k_of_long_vectors(spark):
    """Components of 2^40 and more, of floats' largest, and of repeated query ids take part; order is exact."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 1, 4) * 10.0 ** rng.integers(0, 14, 4)).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100, [1e13, 0.0]), (101, [float(2**41), 1.0]), (102, [3e38, -3e38, 1.0]), (103, [-3e38]), (104, [1e13, 0.0, 0.0, 0.0]), (40, [0.25, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = [(i, [math.floor(float(np.float32(x)) * 64) for x in v]) for i, v in rows]
    queries = {}
    for i, v in whole:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    expected = set()
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:20]
        expected |= {(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)}
    found = [tuple(r) for r in vafile.search(frame).collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in vafile.search(few).collect()] == [(0, 1, 1, 64 * 128)]
    assert vafile.search(few.limit(0)).count() == 0


def test_pipeline_stages(spark):
    """Each stage on its predecessor's rows: columns stay, decisions take effect, ids are the library's."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "pii", "source_mix", "bpe"]
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
        sizes.append(docs.count())
        if stage is corpus_pipeline.dedup:
            kept = {i: c for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in before.collect()], 5).items()}
            assert {r["doc_id"] for r in docs.collect()} == {c for c in kept.values()}
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    coded = {r["doc_id"]: r["ids"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    for r in docs.limit(20).collect():
        assert coded[r["doc_id"]] == library.encode(r["text"], add_special_tokens=False).ids


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_hot_lists_and_groups_in_small_blocks(spark, monkeypatch):
    """With blocks of a few nodes, lists and groups are dealt into many cells, and no link between blocks is lost."""
    monkeypatch.setattr(near_dedup, "LIST_CELL", 7)
    monkeypatch.setattr(near_dedup, "CELL", 900)
    rows = groups()
    found = near_dedup.dedup(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), 2).collect()
    expected = brute(rows, 2)
    assert all((r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] for r in found) and len(found) == len(rows)


def test_rows_of_a_hot_group_grow_with_it(spark, monkeypatch):
    """Twice the near copies of one text, in blocks of a few: twice the rows in cells and edges, not four times; no link is lost."""
    monkeypatch.setattr(near_dedup, "LIST_CELL", 16)
    inside, made = near_dedup.inside, []

    def counted(cells, *rest):
        edges = inside(cells, *rest)
        made[-1] += cells.count() + edges.count()
        return edges

    monkeypatch.setattr(near_dedup, "inside", counted)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    for size in (100, 200):
        rows = []
        for i in range(size):
            text = list(base)
            text[rng.randrange(90)] = f"x{i}"
            rows.append((i, " ".join(text)))
        made.append(0)
        found = near_dedup.dedup(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), 2).collect()
        expected = brute(rows, 2)
        assert len(found) == size and all((r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] for r in found)
    assert made[1] < 2.6 * made[0]


def test_small_tables_have_few_files(spark, monkeypatch):
    stash, files = near_dedup.stash, []

    def counted(df, name):
        files.append((name, df.rdd.getNumPartitions()))
        return stash(df, name)

    monkeypatch.setattr(near_dedup, "stash", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    rows = [(i, f"text {i // 3} " + " ".join(f"w{i // 3 * 50 + j}" for j in range(30)) + f" {i % 3}", "en", "s", 1) for i in range(60)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert near_dedup.keep_one(spark.createDataFrame(rows, DOCS).coalesce(2), 2).count() == 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    large = {name for name, n in files if n > 8} - {"dedup-result", "dedup-again", "dedup-stays", "dedup-blocks", "dedup-apart", "dedup-narrow", "dedup-rows", "dedup-shared"}
    assert len(files) > 15 and not large  # of 60 rows, and of what is written once a list, group or round


def test_columns_with_inner_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 6, 7), (2, "a b c d e f", 5, 6, 7), (2, "a b c d e f", 5, 6, 7), (None, "z", 5, 6, 7)], "doc_id bigint, text string, _id int, _N int, _fa int")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["_id"], r["_N"], r["_fa"]) for r in kept.collect()) == [(0, 5, 6, 7), (1, 5, 6, 7)]


def test_whole_groups_over_batches():
    import pyarrow as pa

    from sliceworks.llm.shared import whole_groups

    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4, 5]
    for width in (1, 2, 3, 11):
        batches = [pa.record_batch({"k": keys[i : i + width], "x": list(range(i, min(i + width, 11)))}) for i in range(0, 11, width)]
        found = []
        for table, starts in whole_groups(iter(batches), ["k"]):
            ends = [*starts[1:].tolist(), table.num_rows]
            found += [tuple(table.column("k")[a:b].to_pylist()) for a, b in zip(starts.tolist(), ends, strict=True)]
        assert found == [(1, 1), (2,) * 5, (3,), (4, 4), (5,)]
