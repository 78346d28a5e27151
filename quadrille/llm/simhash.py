"""SimHash near-duplicates, linked through pivot distance tables.

Fingerprints that differ in at most ``distance`` bits agree in some ``distance``-free choice of blocks,
so each distinct fingerprint is dealt to one bucket per choice of two out of five blocks. Inside a bucket a
table holds the Hamming distances to many reference fingerprints; by the triangle inequality a pair
whose coordinates differ by more than ``distance`` anywhere is no link, and only the survivors are
compared bit by bit. A bucket hands on the stars of its components, never its pairs. Buckets that hold very many
fingerprints are first cut along pivot coordinates, so that none is one task's alone.

Defined cases: a null or empty text has no words and fingerprint zero; equal texts share a
fingerprint and are one node; a row with a null id takes part by its text but never names a group
unless all of its group are null; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.arrays import LOWER, Words, gather, text_chunks
from quadrille.llm.components import join_labels, stars
from quadrille.llm.spark_io import frugal, partitions, written

SHINGLE, DISTANCE, SEED, PIVOTS = 3, 3, 42, 24
#: Five blocks cover 64 bits; three differing bits leave at least two blocks alike.
WIDTHS = (13, 13, 13, 13, 12)
BATCH = 1 << 16
#: Buckets of more fingerprints are dealt again by the cells of their first CELL_PIVOTS distances.
LARGE_BUCKET, CELL_PIVOTS = 1 << 16, 3


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    parts = [_fingerprint_chunk(LOWER[data], offsets, shingle) for _, data, offsets in text_chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _fingerprint_chunk(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    words = Words(data, offsets)
    # the words with one space after each: a shingle is then one slice
    joined, at = gather(np.concatenate((data, [np.uint8(0x20)])), words.starts, words.ends + 1)
    joined[at[1:] - 1] = 0x20
    counts = words.counts
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    width = np.minimum(counts, shingle)
    doc = np.repeat(np.arange(len(counts)), shingles)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    first = words.first[doc] + nth
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    starts, ends = at[first].tolist(), (at[first + width[doc]] - 1).tolist()
    hashes = np.fromiter((digest(text[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))
    return majority(hashes, shingles)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document, of so many hashes, the bits that are set in over half of them; zero without any."""
    out = np.zeros(len(counts), dtype=np.uint64)
    held = np.flatnonzero(counts)
    if len(held):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(counts) - counts)[held], axis=0, dtype=np.int32)
        out[held] = np.packbits(2 * ones > counts[held, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long): one row for each row of df, by one scan."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), shingle).view(np.int64))], names=[id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long")


def _block_keys() -> list:
    fp, low, keys = F.col("fp"), 0, []
    blocks = []
    for w in WIDTHS:
        blocks.append(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << w) - 1)))
        low += w
    for k, (a, b) in enumerate(combinations(range(len(WIDTHS)), 2)):
        keys.append(F.lit(k << 26).cast("long") + F.shiftleft(blocks[a], 13) + blocks[b])
    return keys


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, n, dtype=np.uint64)


def _bucket_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fp, smaller fp) of the components inside each bucket of whole buckets."""
    table = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], keys))
    keys, fps, table = keys[order], fps[order], table[order]
    labels = np.arange(len(fps))
    left = np.arange(len(fps))
    lag = 0
    while len(left):
        lag += 1
        left = left[left + lag < len(fps)]
        # in a bucket rows stand by their first coordinate, so once that is too far all later ones are
        left = left[(keys[left] == keys[left + lag]) & (table[left + lag, 0] - table[left, 0] <= distance)]
        a = left[labels[left] != labels[left + lag]]
        for lo in range(0, len(a), BATCH):
            x = a[lo : lo + BATCH]
            x = x[(np.abs(table[x] - table[x + lag]) <= distance).all(axis=1)]
            x = x[np.bitwise_count(fps[x] ^ fps[x + lag]) <= distance]
            if len(x):
                labels = join_labels(labels, x, x + lag)
    tied = np.flatnonzero(labels != np.arange(len(labels)))
    return fps[tied], fps[labels[tied]]


def _recut(dealt: DataFrame, large: int) -> DataFrame:
    """(key, fp) with large buckets cut along pivot coordinates. Linked fingerprints are at most three apart in each, so
    their cells of width four are the same or neighbours: each goes to its own cell and the next one up, and every
    linked pair still meets, in a bucket that each coordinate makes smaller."""
    heavy = dealt.groupBy("key").count().where(F.col("count") > large).select("key", F.lit(True).alias("heavy"))
    cells = F.array(F.lit(0).cast("long"))
    for p in pivots(CELL_PIVOTS).view(np.int64).tolist():
        cell = F.shiftright(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))), 2).cast("long")
        cells = F.flatten(F.transform(cells, lambda c, cell=cell: F.array(c * 32 + cell + 1, c * 32 + cell + 2)))
    cells = F.when(F.col("heavy"), cells).otherwise(F.array(F.lit(0).cast("long")))
    marked = dealt.join(heavy, "key", "left").select("key", "fp", F.explode(cells).alias("cell"))
    return marked.select((F.col("key") * F.lit(1 << 18) + F.col("cell")).alias("key"), "fp")


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, tasks: int | None = None, large: int = LARGE_BUCKET) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints within reach of each other."""
    if distance > 3:
        raise ValueError("five blocks, taken two at a time, find up to three differing bits")

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(k, f):
            u, v = _bucket_links(k, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held_k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
            held_f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            whole = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0
            if whole > BATCH // 4:  # the last bucket may go on
                yield emit(held_k[:whole], held_f[:whole])
                held_k, held_f = held_k[whole:], held_f[whole:]
        if len(held_k):
            yield emit(held_k, held_f)

    dealt = distinct.select("fp", F.explode(F.array(*_block_keys())).alias("key")).select("key", "fp")
    dealt = _recut(dealt, large)
    return dealt.repartition(tasks or partitions(distinct), "key").sortWithinPartitions("key").mapInArrow(rows, "u long, v long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) for each row of df."""
    docs = written(with_fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = docs.groupBy("fp").agg(F.min(id_col).alias("least"))
    star = stars(fingerprint_links(distinct, distance, partitions(df)))
    ends = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(star.select("v", "v").distinct())
    groups = distinct.join(ends, "fp")
    named = groups.join(groups.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    alone = distinct.join(ends, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return docs.join(named.union(alone), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
