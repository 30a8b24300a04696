"""Near-duplicates by bottom-k sketches, with exact Jaccard similarity on whole shingle sets.

1. Each text becomes its set of hashed word shingles, of which a row keeps only the size, a 126-bit fingerprint and the
   ``K`` smallest hashes: a bottom-k sketch from one hash function. Texts with equal sets are one class; from here on
   a class is one node, so copies cost nothing however many there are.
2. Inverted lists of the ``LISTED`` smallest values find overlaps. Two sets that are similar enough share at least ``need(n)``
   of these values (for sets larger than that: but for about one pair in 10^7, as the binomial tail has it), so under one
   order of all values, rarest first, they share one of the first ``kept - need + 1`` values of each. Only those are listed.
3. The nodes of a list are compared with each other inside a task, by sizes and by bit signatures of their sketches, and give a
   spanning forest of what may be similar, never the pairs. What hangs together is a group of candidates.
4. Inside each group the union-sketch estimate (the share of the k smallest values of both sketches that are in both)
   is taken between sketches and again gives a spanning forest, hence smaller groups; inside those, whole sets from whole
   texts are intersected exactly and give a spanning forest of links.
5. Forests join to groups by rounds that contract edges to their smallest nodes; a component is named by its smallest doc_id.

A list or a group of more than ``LIST_CELL`` nodes or ``CELL`` values is dealt into blocks by a hash. First each block is compared by itself, a row a node; then
up to ``DEPUTIES`` nodes of each part that hangs together are compared across blocks; last, blocks of nodes that are still apart from a group's main part meet each
other and the blocks of the main part in cells of their own, so no two nodes are left out but those known to be connected. A task holds two blocks at most (or one longer
text), and no step makes a row for each pair. Near copies that hang together cost a row each in the first two steps; only what stays apart though it shares a large list
or group goes to as many cells as there are blocks. Nodes of one block that are found connected aren't compared again.
Texts are fetched again only for groups of candidates that passed the estimate. Steps between shuffles are written tables, deleted as soon as
nothing reads them, and have as many files as their rows need. Nothing is collected but counts.

Cases: a null or empty text, or one without words, has the empty set and no links; a text with fewer words than a
shingle is one shingle; A-Z are lower-cased and nothing else; repeated rows with one id are linked like others; a null id is
never a component's name unless all ids are null; an empty table gives an empty result; columns of any name may be there besides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import python_ready, stash, text_runs, unstash, unused, whole_groups

WORDS = 5
PERCENT = 80
K = 64
LISTED = 32  # values of a sketch that may be listed
OVERLAP = 12  # of those, sets larger than LISTED share so many at least
SLACK = 0.25  # the estimate may lie so far under the similarity: 5 standard deviations
SIGNATURE = 4  # longs
LIST_CELL = 2048  # nodes of a list in one block
CELL = 200_000  # values of a group in one block
DEPUTIES = 32  # nodes that stand for what is found connected in a group of several blocks
BROADCAST_IDS = 1_000_000
ROWS_A_FILE = 8_192  # of tables between steps, however many partitions a shuffle has

Links = Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text of a run the sorted distinct hashes, of 63 bits, of its shingles."""
    base = int(offsets[0])
    block = _LOWER[data[base : int(offsets[-1])]]
    limits = offsets - base
    solid = ~_SPACE[block]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    starts_here = np.zeros(len(block) + 1, bool)
    starts_here[limits[:-1]] = True
    begins |= solid & starts_here[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return [np.zeros(0, np.uint64)] * (len(limits) - 1)
    chars = _BYTE[block[solid]]
    first = np.flatnonzero(begins[solid])
    lens = np.diff(np.append(first, len(chars)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lens.max()), _STEP, np.uint64))
        place = np.arange(len(chars)) - np.repeat(first, lens)
        hashes = mixed(np.add.reduceat(chars * powers[place], first) + lens.astype(np.uint64))
        n = len(hashes)
        joined = np.zeros(n, np.uint64)
        for j in range(words):
            moved = np.zeros(n, np.uint64)
            moved[: n - j] = hashes[j:]
            joined = mixed(joined * _STEP + moved + _U(j + 1))
        limits_w = np.searchsorted(at, limits)
        out = []
        for a, b in zip(limits_w[:-1].tolist(), limits_w[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(joined[a : b - words + 1] >> _U(1)))
            elif b > a:
                whole = _U(b - a)
                for h in hashes[a:b]:
                    whole = mixed(np.array([whole * _STEP + h + _U(77)]))[0]
                out.append(np.array([whole >> _U(1)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two sums of 63 bits that only equal sets share."""
    with np.errstate(over="ignore"):
        a = mixed(hashes + _U(0x1234567)).sum(dtype=np.uint64)
        b = mixed(hashes * _STEP + _U(0x7654321)).sum(dtype=np.uint64)
    return int(a >> _U(1)), int(b >> _U(1))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, fa, fb (fingerprint), sketch and sig0.. (the sketch's values as bits) of every row."""
    names = ["doc_id", "n", "fa", "fb", "sketch", *SIGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                prints = [fingerprint(s) for s in sets]
                low = [s[:K].astype(np.int64) for s in sets]
                marks = np.zeros((len(sets), 64 * SIGNATURE), np.uint8)
                for i, s in enumerate(low):
                    marks[i, (s >> 7) % (64 * SIGNATURE)] = 1
                bits = np.packbits(marks, axis=1).view(np.int64)
                columns = [
                    batch.column("doc_id").slice(first, end - first).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array(low, pa.list_(pa.int64())),
                    *[pa.array(bits[:, i]) for i in range(SIGNATURE)],
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    python_ready(docs.sparkSession)
    kinds = ["bigint"] * 4 + ["array<bigint>"] + ["bigint"] * SIGNATURE
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(names, kinds, strict=True)))


SIGS = [f"sig{i}" for i in range(SIGNATURE)]


def need(n: Column) -> Column:
    """How many listed values a set of n shingles shares at least with any set similar to it.

    Of the shared shingles each side leaves out those beyond its ``LISTED`` smallest hashes. That is least for the largest or
    an equal partner; for large sets the binomial tail says more.
    """

    def surely(m: Column) -> Column:
        over = [F.greatest(x - LISTED, F.lit(0)) for x in (n, m)]
        return F.ceil(F.greatest(n, m) * PERCENT / 100 - 1e-6) - over[0] - over[1]

    found = F.least(surely(n), surely(F.floor(n * 100 / PERCENT + 1e-6)))
    return F.when(n <= LISTED, found).otherwise(F.greatest(found, F.lit(OVERLAP))).cast("int")


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows at most, in no more partitions than these need: each file that is written starts processes for its mode, on every executor."""
    return df.coalesce(max(1, math.ceil(rows / ROWS_A_FILE)))


def postings(nodes: DataFrame) -> DataFrame:
    """v, node, n and signature: a row for each value under which a node is listed."""
    count = nodes.count()
    entries = nodes.select("node", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    often = stash(entries.groupBy("v").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").transform(few, 2 * count), "dedup-values")
    shared = entries.join(often, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("m", "v"))).alias("shared"))  # LISTED values a node at most
    kept = F.least(F.col("n"), F.lit(LISTED)).cast("int")
    room = kept - need(F.col("n")) + 1 - (kept - F.size("shared"))  # values that no other sketch has come first
    listed = nodes.select("node", "n", *SIGS).join(shared, "node").withColumn("prefix", F.slice("shared.v", 1, F.greatest(room, F.lit(0))))
    found = stash(listed.select("node", "n", *SIGS, F.explode("prefix").alias("v")).transform(few, 4 * count), "dedup-postings")
    unstash(often)
    return found


def weighed(rows: DataFrame, group: str, weight: Column, most: int) -> DataFrame:
    """Written group and _blocks of the groups of a weight over ``most``."""
    large = rows.groupBy(group).agg(F.sum(weight).alias("_weight")).filter(F.col("_weight") > most)
    return stash(large.select(group, F.ceil(F.col("_weight") / most).cast("int").alias("_blocks")), "dedup-blocks")


def blocked(rows: DataFrame, group: str, large: DataFrame, seed: int) -> DataFrame:
    """``rows`` in cells (``group``, lo, hi), each in one: a block of a large group, or a whole other group. Blocks of one node differ from group to group."""
    dealt = rows.join(_small(large), group, "left")
    own = F.pmod(F.xxhash64(F.lit(seed), "node", group), F.coalesce("_blocks", F.lit(1))).cast("int")
    return dealt.withColumns({"lo": own, "hi": own}).drop("_blocks")


def deputies(rows: DataFrame, group: str) -> DataFrame:
    """``DEPUTIES`` nodes, at most, of what hangs together (``_at``) in each group."""
    place = F.row_number().over(Window.partitionBy(group, "_at").orderBy(F.xxhash64(F.lit(11), "node"), "node"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= DEPUTIES).drop("_place", "_at")


def apart(rows: DataFrame, group: str, weight: Column, most: int) -> DataFrame:
    """Written group, main (the heaviest of its ``_at``) and the numbers of blocks of it and of the rest, of groups that don't hang together yet."""
    parts = rows.groupBy(group, "_at").agg(F.sum(weight).alias("_weight"))
    sums = parts.groupBy(group).agg(F.max(F.struct("_weight", "_at")).alias("_top"), F.sum("_weight").alias("_all"), F.count(F.lit(1)).alias("_parts")).filter("_parts > 1")
    blocks = [F.ceil(w / most).cast("int").alias(c) for w, c in ((F.col("_top._weight"), "_mains"), (F.col("_all") - F.col("_top._weight"), "_rests"))]
    return stash(sums.select(group, F.col("_top._at").alias("_main"), *blocks), "dedup-apart")


def crossed(rows: DataFrame, group: str, split: DataFrame) -> DataFrame:
    """``rows`` of the groups of ``split`` in cells that hold each two nodes together, but for two of the main part: blocks of the rest meet each other and those of the main part."""
    dealt = rows.join(_small(split), group)
    main = F.col("_at") == F.col("_main")
    own = F.xxhash64(F.lit(7), "node")
    own = F.when(main, F.col("_rests") + F.pmod(own, F.col("_mains"))).otherwise(F.pmod(own, F.col("_rests"))).cast("int")
    others = F.sequence(F.lit(0), F.when(main, F.col("_rests")).otherwise(F.col("_rests") + F.col("_mains")) - 1)
    spread = dealt.withColumn("_own", own).withColumn("_other", F.explode(others))
    return spread.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")}).drop("_own", "_other", "_at", *split.columns[1:])


def linked(rows: DataFrame, group: str, weight: Column, most: int, links: Links, name: str, filled: Callable[[DataFrame], DataFrame] = lambda cells: cells) -> DataFrame:
    """Written node and comp: what ``links`` finds to hang together between any two rows of one group. ``filled`` gives cells the columns that only ``links`` reads."""
    large, count = weighed(rows, group, weight, most), rows.count()
    cells = blocked(rows, group, large, 7)
    edges = inside(filled(cells), group, links, name, count)
    known = components(edges)
    unstash(edges)
    for step in ("deputies", "all"):
        if large.limit(1).count() == 0:
            break
        at = known.select("node", F.col("comp").alias("_at"))
        held = rows.join(_small(large.select(group)), group, "left_semi").join(_small(at), "node", "left")
        held = stash(held.withColumn("_at", F.coalesce("_at", "node")), "dedup-held")
        split = apart(held, group, weight, most)
        if split.limit(1).count() == 0:
            unstash(held, split)
            break
        if step == "deputies":
            some = stash(deputies(held.join(_small(split.select(group)), group, "left_semi"), group).transform(few, held.count()), "dedup-deputies")
            again = weighed(some, group, weight, most)
            edges = inside(filled(blocked(some, group, again, 13)), group, links, name, count)
            unstash(some, again)
        else:
            edges = inside(filled(crossed(held, group, split)), group, links, name, count)
        unstash(held, split)
        before, known = known, components(edges.unionByName(known.select(F.col("comp").alias("a"), F.col("node").alias("b")).filter("a < b")))
        unstash(edges, before)
    unstash(large)
    return known


def inside(cells: DataFrame, group: str, links: Links, name: str, rows: int) -> DataFrame:
    """Written edges a, b: what ``links`` finds in tables of whole cells, whose first rows it is given. Of ``rows`` rows, which cells may hold again."""
    keys = [group, "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            a, b = links(table, starts)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    python_ready(cells.sparkSession)
    found = cells.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a bigint, b bigint")
    return stash(few(found.filter("a < b").distinct(), rows), name)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(root, members) of what hangs together among 0..n-1; ``near(i, left)`` marks those of ``left`` that are near i. Each is asked for once, against those that no root has yet."""
    left, out = np.arange(n), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            hit = near(queue.pop(), left)
            new = left[hit]
            if len(new):
                out.append((root, new))
                queue.extend(new.tolist())
                left = left[~hit]
    return out


def sizes_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT)


def maybe_alike(na: np.ndarray, nb: np.ndarray, siga: np.ndarray, sigb: np.ndarray) -> np.ndarray:
    """Sizes and signatures allow similarity; no pair that the estimate would keep fails here.

    A bit that only one sketch sets stands for at least one value that the other lacks, so neither sketch has more such bits
    than values beyond the shared ones. Whole sketches share what the sizes ask for; others share what the estimate's limit asks for.
    """
    whole = -(-PERCENT * (na + nb) // (100 + PERCENT))
    shared = np.where(np.maximum(na, nb) <= K, whole, math.ceil(K * (PERCENT / 100 - SLACK) - 1e-6))
    lone_a = np.bitwise_count(siga & ~sigb).sum(-1)
    lone_b = np.bitwise_count(sigb & ~siga).sum(-1)
    return sizes_alike(na, nb) & (lone_a + shared <= np.minimum(na, K)) & (lone_b + shared <= np.minimum(nb, K))


def list_links(table: pa.Table, starts: np.ndarray, few: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of what may be alike in each list. Lists of a few nodes are compared all at once, place by place."""
    node, n = (table.column(c).to_numpy().astype(np.int64) for c in ("node", "n"))
    sig = np.stack([table.column(c).to_numpy() for c in SIGS], axis=1).view(np.uint64)
    size = np.diff(np.append(starts, len(node)))
    ends = np.repeat(starts + size, size)
    open_rows = np.flatnonzero(np.repeat(size <= few, size))
    from_, to = [], []
    for d in range(1, few):
        open_rows = open_rows[open_rows + d < ends[open_rows]]
        if not len(open_rows):
            break
        other = open_rows + d
        hit = maybe_alike(n[open_rows], n[other], sig[open_rows], sig[other])
        from_.append(open_rows[hit])
        to.append(other[hit])
    for k in np.flatnonzero(size > few):
        at = int(starts[k])
        own_n, own_sig = n[at : at + size[k]], sig[at : at + size[k]]
        for root, members in forest(int(size[k]), lambda i, left, n=own_n, s=own_sig: maybe_alike(n[i], n[left], s[i], s[left])):
            from_.append(np.full(len(members), at + root))
            to.append(at + members)
    if not from_:
        return node[:0], node[:0]
    return _stars(node, np.concatenate(from_), np.concatenate(to))


def _stars(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows as edges from each row to the first that it hangs together with."""
    low = np.arange(len(node))
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            moved = np.flatnonzero(low != np.arange(len(node)))
            return node[moved], node[low[moved]]


class Estimates:
    """Union-sketch estimates between the sketches of one cell."""

    def __init__(self, sketches: list[np.ndarray], n: np.ndarray):
        self.n, self.kept = n, np.array([len(s) for s in sketches])
        self.values = np.full((len(sketches), K), np.iinfo(np.int64).max)
        for i, s in enumerate(sketches):
            self.values[i, : len(s)] = s

    def near(self, i: int, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), bool)
        fits = np.flatnonzero(sizes_alike(self.n[i], self.n[left]))
        own, rows = self.values[i, : self.kept[i]], self.values[left[fits]]
        place = np.searchsorted(own, rows)
        both = (own[np.minimum(place, len(own) - 1)] == rows) & (np.arange(K) < self.kept[left[fits]][:, None])
        rank = place + np.arange(1, K + 1) - np.cumsum(both, axis=1) + both  # in the union
        union = np.minimum(K, len(own) + self.kept[left[fits]] - both.sum(1))
        out[fits] = (both & (rank <= K)).sum(1) >= (PERCENT / 100 - SLACK) * union - 1e-9
        return out


class Exact:
    """Similarity of the whole sets of one cell, by an inverted index over those that are still asked about."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(s) for s in sets])
        self._index(np.arange(len(sets)))

    def _index(self, ids: np.ndarray) -> None:
        values = np.concatenate([self.sets[i] for i in ids])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(ids)), self.size[ids])[order]
        self.indexed = len(ids)
        self.slot = np.full(len(self.sets), -1)
        self.slot[ids] = np.arange(len(ids))

    def near(self, i: int, left: np.ndarray) -> np.ndarray:
        if 2 * len(left) < self.indexed:
            self._index(left)
        own = self.sets[i]
        low, high = np.searchsorted(self.values, own), np.searchsorted(self.values, own, side="right")
        n = high - low
        hits = self.owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        inter = np.bincount(hits, minlength=self.indexed)[self.slot[left]]
        return inter * 100 >= (self.size[left] + len(own) - inter) * PERCENT


def _by_cell(table: pa.Table, starts: np.ndarray, near: Callable[[pa.Table], tuple[np.ndarray, Callable]]) -> tuple[np.ndarray, np.ndarray]:
    """Forests of one cell after the other."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
        if end - at > 1:
            node, asked = near(table.slice(at, end - at))
            for root, members in forest(len(node), asked):
                a.append(np.full(len(members), node[root]))
                b.append(node[members])
    return np.concatenate(a), np.concatenate(b)


def sketch_links(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    def near(cell: pa.Table) -> tuple[np.ndarray, Callable]:
        sketch = cell.column("sketch").combine_chunks()
        values, limits = sketch.flatten().to_numpy(), np.cumsum([0, *sketch.value_lengths().to_pylist()])
        return cell.column("node").to_numpy(), Estimates([values[x:y] for x, y in zip(limits[:-1], limits[1:], strict=True)], cell.column("n").to_numpy()).near

    return _by_cell(table, starts, near)


def set_links(words: int) -> Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    def near(cell: pa.Table) -> tuple[np.ndarray, Callable]:
        sets = [s for *_, data, offsets in text_runs(cell.column("text").combine_chunks()) for s in shingle_sets(data, offsets, words)]
        return cell.column("node").to_numpy(), Exact(sets).near

    return lambda table, starts: _by_cell(table, starts, near)


def texts_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The rows of ``wanted`` (class_id, fa, fb and others) with the text of each class, once."""
    ids = wanted.select(F.col("class_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(_small(ids, wanted.count()), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    return printed(texts, words, ["n", "fa", "fb"]).groupBy("fa", "fb").agg(F.first("text").alias("text")).join(wanted, ["fa", "fb"])


def _small(df: DataFrame, count: int | None = None) -> DataFrame:
    """A written table of a few numbers a row, broadcast if its count allows."""
    return F.broadcast(df) if (df.count() if count is None else count) <= BROADCAST_IDS else df


def components(links: DataFrame) -> DataFrame:
    """Written node and comp, the smallest node that is reachable, of every linked node.

    In each round a node gives way to the smallest neighbour of its smallest neighbour, and edges between what is then one node go; so each round joins
    only the edges that the one before has left, and their number falls fast.
    """
    edges, rounds = links.select("a", "b"), []
    while (left_over := edges.count()) or not rounds:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stash(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")).transform(few, 2 * left_over), "dedup-up")
        nodes = up.count()
        jump = up.join(_small(up.select(F.col("node").alias("up"), F.col("up").alias("comp")), nodes), "up").select("node", "comp")
        rounds.append(stash(few(jump, nodes), "dedup-labels"))
        at = [_small(rounds[-1].select(F.col("node").alias(c), F.col("comp").alias(f"_{c}")), nodes) for c in ("a", "b")]
        moved = edges.join(at[0], "a").join(at[1], "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        left = stash(few(moved.distinct(), left_over), "dedup-edges")
        unstash(up, *[edges] * (len(rounds) > 1))
        edges = left
    unstash(edges)
    comps = rounds.pop()
    while rounds:
        to = rounds.pop()
        last = _small(comps.select(F.col("node").alias("up"), F.col("comp").alias("last")))
        named = to.select("node", F.col("comp").alias("up")).join(last, "up", "left").select("node", F.coalesce("last", "up").alias("comp"))
        named = stash(few(named, to.count()), "dedup-labels")
        unstash(to, comps)
        comps = named
    return comps


def linked_nodes(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Written node and comp of what links hold together, of every linked node: by lists, then by estimates, then by whole sets."""
    posts, count = postings(nodes), nodes.count()  # joins with all nodes are dealt by their number, however few are in groups
    groups = linked(posts, "v", F.lit(1), LIST_CELL, list_links, "dedup-listed")
    unstash(posts)
    members = stash(groups.select("node", F.col("comp").alias("held")).join(nodes.select("node", "n", "sketch"), "node").transform(few, count), "dedup-members")
    unstash(groups)
    groups = linked(members, "held", F.lit(K), CELL, sketch_links, "dedup-estimated")
    unstash(members)
    wanted = stash(groups.select("node", F.col("comp").alias("held")).join(nodes.select("node", "n", "class_id", "fa", "fb"), "node").transform(few, count), "dedup-wanted")
    unstash(groups)

    def filled(cells: DataFrame) -> DataFrame:
        dealt = stash(cells, "dedup-cells")
        written.append(dealt)
        return texts_of(docs, dealt, words).select("held", "lo", "hi", "node", "text")

    written: list[DataFrame] = []
    found = linked(wanted, "held", F.col("n"), CELL, set_links(words), "dedup-links", filled)
    unstash(wanted, *written)
    return found


def resolved(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, fa, fb, component_id and chosen (the row's set is the one that stands for its component) of every row; the last two are null for the empty set."""
    rows = stash(sketches(docs, words), "dedup-rows")
    firsts = [F.first(c).alias(c) for c in ("n", "sketch", *SIGS)]
    classes = rows.filter("n > 0").groupBy("fa", "fb").agg(F.min("doc_id").alias("class_id"), *firsts)
    count = rows.count()
    nodes = stash(few(classes, count).withColumn("node", F.monotonically_increasing_id()), "dedup-nodes")
    narrow = stash(rows.select("doc_id", "n", "fa", "fb"), "dedup-narrow")
    unstash(rows)
    comps = linked_nodes(nodes, docs, words)
    named = nodes.select("node", "fa", "fb", "class_id").join(comps.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = stash(few(named, count), "dedup-named")
    first = F.min(F.struct(F.col("class_id").isNull().alias("unnamed"), "class_id", "fa", "fb")).alias("first")
    least = named.groupBy("comp").agg(first).select("comp", F.col("first.class_id").alias("component_id"), F.struct("first.fa", "first.fb").alias("stands"))
    chosen = (F.struct("fa", "fb") == F.col("stands")).alias("chosen")
    by_set = stash(named.join(least, "comp").select("fa", "fb", "component_id", chosen).transform(few, count), "dedup-components")
    unstash(nodes, named, comps)
    return narrow.join(by_set, ["fa", "fb"], "left")


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return resolved(docs, words).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def printed(docs: DataFrame, words: int, names: list[str]) -> DataFrame:
    """The rows of ``docs`` with the size and fingerprint of their sets under three names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                prints = [fingerprint(s) for s in sets]
                own = [pa.array(v, pa.int64()) for v in ([len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints])]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, *own], names=[*batch.schema.names, *names])

    python_ready(docs.sparkSession)
    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in names]])
    return docs.mapInArrow(run, schema)


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without all but one document of each group of near-duplicates; of rows with one id and one set one stays.

    A row is decided by its id and its set, so a copy's id takes no other text with it. Ids that one row has are decided by
    narrow tables. Rows whose id is null or repeated get their fingerprints again; rows without words have no
    links, and only those with one id, not null, are merged.
    """
    own_n, own_a, own_b, an_id, an_a, an_b = unused(docs, "n", "fa", "fb", "id", "a", "b")
    found = resolved(docs, words)
    stays = (F.col("n") == 0) | (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = stash(found.select("doc_id", "n", "fa", "fb", stays.alias("stays")), "dedup-result")
    ids = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"), F.min("stays").alias("stays"))
    gone = stash(ids.filter("m = 1 AND NOT stays").select(F.col("doc_id").alias(an_id)).transform(few, found.count()), "dedup-gone")
    again = stash(ids.filter("m > 1").select(F.col("doc_id").alias(an_id)), "dedup-again")
    same_id = F.col("doc_id") == F.col(an_id)
    once = docs.filter("doc_id IS NOT NULL").join(_small(gone), same_id, "left_anti").join(_small(again), same_id, "left_anti")
    shared = docs.filter("doc_id IS NOT NULL").join(_small(again), same_id, "left_semi")
    marked = stash(printed(shared.unionByName(docs.filter("doc_id IS NULL")), words, [own_n, own_a, own_b]), "dedup-shared")
    if marked.limit(1).count() == 0:
        return once
    bare = marked.filter(F.col("doc_id").isNull() & (F.col(own_n) == 0))
    keys = found.filter("stays AND (doc_id IS NULL AND n > 0)").unionByName(found.filter("stays").join(_small(again), same_id, "left_semi"))
    keys = stash(keys.select(F.col("doc_id").alias(an_id), F.col("fa").alias(an_a), F.col("fb").alias(an_b)).distinct(), "dedup-stays")
    same = F.col("doc_id").eqNullSafe(F.col(an_id)) & (F.col(own_a) == F.col(an_a)) & (F.col(own_b) == F.col(an_b))
    rest = marked.filter(F.col("doc_id").isNotNull() | (F.col(own_n) > 0)).join(_small(keys), same, "left_semi").dropDuplicates(["doc_id", own_a, own_b])
    return once.unionByName(rest.unionByName(bare).select(*docs.columns))
