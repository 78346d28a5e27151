"""Groups of texts whose sets of word shingles are alike: Jaccard similarity of a bound or more, exactly.

SimHash links come first: fingerprints over the same shingles that differ in at most three bits, found through pivot
distance tables, name most near copies cheaply. At a similarity of 0.8 fingerprints differ in about ten of 64 bits, though,
and unrelated ones in 32 by four: no block, pivot or threshold tells these apart, so links that remain are found by a
prefix filter: two sets that are alike share one of the first ``n - ceil(bound * n) + 1`` shingles of each, in any order
that all texts agree on; here the rarest come first, so that what very many texts share is nobody's prefix.

Every link is verified on the whole sets. To join groups, not all their pairs are tried: in a few rounds each text
is held against one other that shares a shingle, so that groups grow together; only then are those held against each other that are still in different groups and that
their parity fingerprints allow. Bit k of these tells whether the set has an odd number of shingles of class k, so every
shingle that only one of two sets has flips one bit, and the Hamming distance is never more than their difference,
which is at most (n + m) / 9 at a similarity of 0.8: what is discarded by it is no link for certain. Of all shingles that two
texts share, the first in the order brings them together: all that stand before it are in one of the sets only, so they count
as difference; and where one of the few before it is shared too, it is not the first.

Defined cases: A-Z are lower-cased; a text of fewer words than a shingle is one shingle; texts without words are alike;
texts with equal sets are one node; a row with a null id takes part by its text but never names a group unless all
of its group are null; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.arrays import Rolling, Words, mix, text_chunks
from quadrille.llm.components import stars
from quadrille.llm.simhash import DISTANCE, fingerprint_links, majority
from quadrille.llm.spark_io import frugal, partitions, release_shuffles, written

#: Shingles are ordered by counts in so many hashed buckets: an order, not a filter, so that collisions cost nothing but time.
BUCKETS = 1 << 17
CHUNK = 1 << 20
#: Longs of a parity fingerprint.
PARITY = 8
#: Rounds in which each text is held against one other of a different group, before groups are held against each other.
ROUNDS = 4
#: Shingles before a shared one that two texts compare to know whether it is their first.
BEFORE = 8


@dataclass(frozen=True)
class Likeness:
    shingle: int = 5
    percent: int = 80

    def least_common(self, n):
        """Shingles that a set of n has in common with any that is alike, at least."""
        return -(-self.percent * n // 100)

    def most_apart(self, n, m):
        """Shingles that only one of two sets of n and m has, at most, if they are alike."""
        return (100 - self.percent) * (n + m) / (100 + self.percent)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk, repeats included, and where each document's begin."""
    words = Words(data, offsets)
    counts = words.counts
    number = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.concatenate(([0], np.cumsum(number)))
    start = np.repeat(words.first[:-1], number) + np.arange(first[-1]) - np.repeat(first[:-1], number)
    stop = start + np.repeat(np.minimum(counts, width), number)
    return Rolling(words.hashes(lower=True)).of(start, stop) ^ (stop - start).astype(np.uint64), first


def shingle_counts(df: DataFrame, text_col: str, width: int) -> np.ndarray:
    """By hashed shingle, how often it comes in all texts; summed over all rows before it is collected."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0), CHUNK):
                total += np.bincount((shingles(data, offsets, width)[0] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    found = df.select(text_col).mapInArrow(rows, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[found.b.to_numpy()] = found.n.to_numpy()
    return counts


class Sets:
    """The distinct shingles of each document of a chunk, rarest first, and 64 bits that stand for each set."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, counts: np.ndarray):
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((hashes, counts[(hashes % np.uint64(BUCKETS)).astype(np.int64)], doc))
        hashes, doc = hashes[order], doc[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        self.hashes, self.first = hashes[fresh], np.searchsorted(doc[fresh], np.arange(len(first)))
        self.sizes = np.diff(self.first)
        total = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(self.hashes), out=total[1:])
        self.names = mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)

    def parities(self) -> pa.ListArray:
        """A parity fingerprint for each document; some documents at a time."""
        bits, out = 64 * PARITY, [np.zeros((0, PARITY), np.int64)]
        for lo in range(0, len(self.sizes), 4096):
            hi = min(lo + 4096, len(self.sizes))
            held = self.hashes[self.first[lo] : self.first[hi]]
            doc = np.repeat(np.arange(hi - lo), self.sizes[lo:hi])
            odd = np.bincount(doc * bits + (held % np.uint64(bits)).astype(np.int64), minlength=(hi - lo) * bits) & 1
            out.append(np.packbits(odd.astype(np.uint8).reshape(hi - lo, bits), axis=1).view(np.int64))
        return pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(out).ravel()), PARITY).cast(pa.list_(pa.int64()))

    def lists(self, lengths: np.ndarray) -> pa.ListArray:
        """The first so many shingles of each document."""
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        at = np.arange(offsets[-1]) + np.repeat(self.first[:-1] - offsets[:-1], lengths)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(self.hashes[at].view(np.int64)))


def sketched(df: DataFrame, id_col: str, text_col: str, counts, rule: Likeness) -> DataFrame:
    """(id, t, fp, node, n, prefix, odd): for each row the hash of its text, fingerprint, set, its size, its rarest shingles, its parities."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(2), CHUNK):
                hashes, first = shingles(data, offsets, rule.shingle)
                sets = Sets(hashes, first, counts.value)
                prefix = np.where(sets.sizes > 0, sets.sizes - rule.least_common(sets.sizes) + 1, 0)
                own = batch.slice(row, len(offsets) - 1)
                fp = pa.array(majority(hashes, np.diff(first)).view(np.int64))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), fp, pa.array(sets.names), pa.array(sets.sizes.astype(np.int32)), sets.lists(prefix), sets.parities()], names=["id", "t", "fp", "node", "n", "prefix", "odd"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_key(text_col), F.col(text_col).alias("text")).mapInArrow(rows, f"id {kind}, t long, fp long, node long, n int, prefix array<long>, odd array<long>")


def text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t")


def common_shares(first: pa.Array, second: pa.Array, rule: Likeness) -> np.ndarray:
    """Whether the sets of two texts are alike, pair by pair; some pairs at a time."""
    lengths = np.cumsum([len(x) + len(y) for x, y in zip(first, second)])
    out, lo = np.zeros(len(first), dtype=bool), 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(lengths, (lengths[lo - 1] if lo else 0) + CHUNK, side="right")))
        keys, sizes = [], []
        for side in (first[lo:hi], second[lo:hi]):
            data = np.frombuffer(b"".join(side), np.uint8)
            hashes, begin = shingles(data, np.concatenate(([0], np.cumsum([len(x) for x in side]))), rule.shingle)
            pair = np.repeat(np.arange(hi - lo), np.diff(begin))
            order = np.lexsort((hashes, pair))
            hashes, pair = hashes[order], pair[order]
            fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (pair[1:] != pair[:-1]))[: len(pair)]
            keys.append((pair[fresh], hashes[fresh]))
            sizes.append(np.bincount(pair[fresh], minlength=hi - lo))
        pair, hashes = (np.concatenate([k[i] for k in keys]) for i in range(2))
        order = np.lexsort((hashes, pair))
        pair, hashes = pair[order], hashes[order]
        both = np.bincount(pair[1:][(hashes[1:] == hashes[:-1]) & (pair[1:] == pair[:-1])], minlength=hi - lo)
        out[lo:hi] = 100 * both >= rule.percent * (sizes[0] + sizes[1] - both)
        lo = hi
    return out


def verified(df: DataFrame, text_col: str, docs: DataFrame, edges: DataFrame, rule: Likeness) -> DataFrame:
    """The edges (u, v) whose sets are alike; texts are read once more, one for each set that an edge names, and travel packed."""
    edges = written(edges.select("u", "v").distinct(), "candidates")
    named = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    wanted = docs.select("node", "t").join(named, "node").groupBy("node").agg(F.min("t").alias("t")).select("node", "t")
    texts = df.select(text_key(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(wanted, "t")

    @frugal
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x.encode()) for x in batch.column(1).to_pylist()], pa.binary())], names=["node", "z"])

    # copies of a text leave each task once
    sets = texts.select("node", "text").mapInArrow(packed, "node long, z binary").groupBy("node").agg(F.first("z").alias("z"))

    @frugal
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sides = [[unpack(x.as_py()) for x in batch.column(i)] for i in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array(common_shares(*sides, rule)))

    both = edges.join(sets.select(F.col("node").alias("u"), F.col("z").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("z").alias("b")), "v")
    found = written(both.select("u", "v", "a", "b").mapInArrow(alike, "u long, v long"), "alike")
    release_shuffles(df.sparkSession)
    return found


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the label of their component, their own name where they stand alone."""
    named = stars(links).select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _may_be_alike(rule: Likeness, a: str, b: str, m: str | None = None):
    """Whether sizes and parity fingerprints of two rows allow that they are alike."""
    differing = sum((F.bit_count(F.col(f"{a}.odd{i}").bitwiseXOR(F.col(f"{b}.odd{i}"))) for i in range(PARITY)), F.lit(0))
    n, m = F.col(f"{a}.n").cast("long"), F.col(m or f"{b}.n").cast("long")
    return (100 * F.least(n, m) >= rule.percent * F.greatest(n, m)) & (differing <= rule.most_apart(n, m))


def _first_shared(rule: Likeness, a: str, b: str):
    """Whether the shingle that two rows share, at places i and j of their sets, may be the first they share and they alike."""
    i, j, n, m = (F.col(c).cast("long") for c in (f"{a}.pos", f"{b}.pos", f"{a}.n", f"{b}.n"))
    return (i + j + F.abs((n - i) - (m - j)) <= rule.most_apart(n, m)) & ~F.arrays_overlap(F.col(f"{a}.before"), F.col(f"{b}.before"))


def _across(marked: DataFrame, keys: DataFrame, parity: DataFrame, rule: Likeness) -> DataFrame:
    """Pairs (u, v) of different groups that share one of keys and may be alike: once for each shingle that may be the first they share."""
    still = marked.join(keys, "key", "left_semi").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("at")).join(parity, "node")
    odds = [f"odd{i}" for i in range(PARITY)]
    still = still.select("node", "label", "n", *odds, F.col("at.key").alias("keys"), F.posexplode("at").alias("k", "one"))
    before = F.slice("keys", F.greatest(F.lit(1), F.col("k") + 1 - BEFORE), F.least(F.lit(BEFORE), F.col("k")))
    still = still.select("node", "label", "n", *odds, "one.key", "one.pos", before.alias("before"))
    a, b = still.alias("a"), still.alias("b")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label")) & _first_shared(rule, "a", "b") & _may_be_alike(rule, "a", "b")
    return a.join(b, apart).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def alike_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Likeness = Likeness()) -> DataFrame:
    """(id, component_id) for each row of df: the smallest id of all that links reach."""
    spark = df.sparkSession
    counts = spark.sparkContext.broadcast(shingle_counts(df, text_col, rule.shingle))
    docs = written(sketched(df, id_col, text_col, counts, rule), "sketches")
    release_shuffles(spark)
    nodes = written(docs.groupBy("node").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), *(F.min(F.get("odd", F.lit(i))).alias(f"odd{i}") for i in range(PARITY))), "nodes")

    # what SimHash links: sets of one fingerprint, and fingerprints within reach
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    reach = fingerprint_links(heads, DISTANCE, partitions(df))
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    near = reach.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = verified(df, text_col, docs, same.union(near), rule)

    # what shares a rare shingle: each text against one likely other, round by round, then across groups
    held = docs.select("node", F.explode("prefix").alias("key"))
    shared = written(held.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"), "shared")
    release_shuffles(spark)
    met = written(docs.select("node", "n", F.posexplode("prefix").alias("pos", "key")).join(shared, "key").distinct(), "met")
    release_shuffles(spark)
    odds = [f"odd{i}" for i in range(PARITY)]
    parity = nodes.select("node", *odds)
    for step in range(ROUNDS + 1):
        marked = _labelled(met, links)
        # the first round's heads are the same for all shingles of a group, later ones differ from shingle to shingle
        order = F.col("node") if step == 0 else F.xxhash64("key", "node", F.lit(step))
        heads = marked.groupBy("key").agg(F.min_by(F.struct("node", "label", "n"), order).alias("head"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        heads = heads.where("lo <> hi").select("key", "head")
        if step == ROUNDS:
            pairs = _across(marked, heads.select("key"), parity, rule)
        else:
            pairs = marked.join(heads, "key").where("label <> head.label").select(F.col("node").alias("u"), F.col("head.node").alias("v"), "n", F.col("head.n").alias("m"))
            votes = pairs.groupBy("u", "v", "n", "m").agg(F.count("*").alias("votes")).alias("p")
            a = votes.join(parity.alias("x"), F.col("p.u") == F.col("x.node")).select("p.*", *(F.col(f"x.{c}").alias(f"x{c}") for c in odds))
            a, b = a.select("u", "v", "m", "votes", "n", *(F.col(f"x{c}").alias(c) for c in odds)).alias("a"), parity.withColumnRenamed("node", "w").alias("b")
            likely = a.join(b, F.col("a.v") == F.col("b.w")).where(_may_be_alike(rule, "a", "b", m="a.m"))
            pairs = likely.groupBy("a.u").agg(F.max(F.struct(F.col("a.votes"), F.col("a.v")))["v"].alias("v"))
        links = written(links.union(verified(df, text_col, docs, pairs, rule)), "links")
        release_shuffles(spark)

    groups = _labelled(nodes.select("node", "least"), links)
    named = groups.join(groups.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    return docs.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "component_id")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Likeness = Likeness()) -> DataFrame:
    """The rows of df that name their group, with all their columns, whatever their names; rows of one id are one document."""
    keep = alike_components(df, id_col, text_col, rule).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("the id")).distinct()
    given, kept = df.alias("given"), keep.alias("kept")
    return given.join(kept, F.col(f"given.`{id_col}`").eqNullSafe(F.col("kept.`the id`")), "left_semi")
