"""Language-model scoring: an interpolated modified Kneser-Ney model of word pairs, counted in Spark.

Texts are counted and scored in blocks (cuts of the partitions of the scan, by hash). A block sends its distinct word pairs
and words, as sorted hash arrays with its training counts, to shards by hash. A shard merges what it gets
into its part of the model - sorted hash arrays in a file that the worker maps into memory - and answers
each block from it, in the block's own order, so answers carry counts and no hashes. The texts
are then dealt by block once, next to the answers, and scored.

p(w | v) = max(c(vw) - D(c), 0) / c(v.) + g(v) p(w), and p(w) is the same of continuation counts (in
how many pairs w comes second), above a uniform share for each known token and one unknown one. D is
estimated from counts of counts, for one, two, and three or more.

Pairs whose first word is frequent are spread over shards by their second word as well; which words
that are is decided by document frequencies of the whole corpus. Tokens are compared by 56-bit hashes.

Defined cases: a null or empty text has one token, its end; a null id is in training; equal rows are counted each and
scored alike; an empty table gives an empty one; without training texts every token has the uniform share;
columns besides the id and the text are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.arrays import Words, mix, text_chunks
from quadrille.llm.leaks import BUCKETS, document_frequencies
from quadrille.llm.spark_io import frugal, input_bytes, partitions, release_shuffles, split_bytes, written
from quadrille.llm.windows import from_planes, planes, shard_by_shard, shards

END, BEGIN = np.uint64(1), np.uint64(2)
#: A word in more than this share of the texts has its pairs spread over so many shards.
FREQUENT, SPREAD = 1 / 64, 64
TEXT, PAIRS, WORDS, FOLLOWED, FOLLOWING, PAIR_ANSWERS, WORD_ANSWERS, SUMS = range(8)
BLOBS = ("a", "b", "c", "d", "e")
SUM_COLUMNS = tuple(f"x{i}" for i in range(8))
SCHEMA = "k int, kind int, src int, " + ", ".join(f"{c} binary" for c in BLOBS) + ", " + ", ".join(f"{c} long" for c in SUM_COLUMNS)
CHUNK = 1 << 20
#: Bytes of a scan partition for each of the blocks that it is cut into, which bounds what a task holds.
BLOCK_BYTES = 4 << 20
#: Shards follow the bytes of the input, not the number of tasks: a blob then never gets small because tasks are many.
SHARD_BYTES, LEAST_SHARDS = 4 << 20, 16


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and where each text's begin."""
    parts, first, total = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, data, offsets in text_chunks(texts, CHUNK):
        words = Words(data, offsets)
        hashes = words.hashes(lower=True)
        hashes >>= np.uint64(8)  # the byte left out is a plane of zeros in every shuffle file
        hashes[hashes <= BEGIN] += np.uint64(2)
        parts.append(np.insert(hashes, words.first[1:], END))
        first.append(words.first[1:] + np.arange(1, len(words.first)) + total)
        total += len(parts[-1])
    return np.concatenate(parts), np.concatenate(first)


def digest(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What was asked, in one number: pairs in their order."""
    return np.array([(pair_hash(v, w) * (2 * np.arange(len(v), dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64)])


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + mix(w))


class Tables:
    """A block's distinct words and pairs, in the order in which shards hear of them and answer."""

    def __init__(self, token: np.ndarray, first: np.ndarray, training: np.ndarray, frequent: np.ndarray, parts: int):
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[first[:-1]] = BEGIN
        lengths = np.diff(first)
        counted = np.repeat(training, lengths)
        # pairs: by shard, then by first word, so that a first word stands once for its run
        keys = pair_hash(before, token)
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        fresh = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        del keys
        one = order[fresh]
        group = np.empty(len(order), dtype=np.int32)
        group[order] = np.cumsum(fresh, dtype=np.int32) - 1
        v, w = before[one], token[one]
        del order, fresh, before
        shard = (v % np.uint64(parts)).astype(np.int64)
        often = frequent[(v % np.uint64(BUCKETS)).astype(np.int64)] | (v <= BEGIN)
        shard = np.where(often, (shard + (mix(w) % np.uint64(SPREAD)).astype(np.int64)) % parts, shard)
        sort = np.argsort((shard.astype(np.uint64) << np.uint64(44)) | (v >> np.uint64(20)), kind="stable")
        place = np.empty(len(sort), dtype=np.int32)
        place[sort] = np.arange(len(sort))
        self.pair_of = place[group]
        del group
        self.v, self.w, self.pair_shard = v[sort], w[sort], shard[sort]
        self.pair_count = np.bincount(self.pair_of[counted], minlength=len(sort)).astype(np.uint32)
        # words: those that come, and the mark before a text, whose count is that of texts
        word, word_of = np.unique(np.append(token, BEGIN), return_inverse=True)
        shard = (word % np.uint64(parts)).astype(np.int64)
        sort = np.argsort(shard, kind="stable")
        place = np.empty(len(sort), dtype=np.int64)
        place[sort] = np.arange(len(sort))
        self.word, self.word_shard, self.word_of = word[sort], shard[sort], place[word_of[:-1]]
        self.word_count = np.bincount(self.word_of[counted], minlength=len(sort)).astype(np.uint32)
        self.begin = int(place[word_of[-1]])
        self.word_count[self.begin] = int(training.sum())

    def word_places(self, words: np.ndarray) -> np.ndarray:
        order = np.argsort(self.word)
        return order[np.searchsorted(self.word, words, sorter=order)]


def _row(k: int, kind: int, src: int, blobs: tuple[np.ndarray, ...] = (), sums: tuple[int, ...] = ()) -> dict:
    return {"k": k, "kind": kind, "src": src} | {c: planes(x) for c, x in zip(BLOBS, blobs)} | {c: int(x) for c, x in zip(SUM_COLUMNS, sums)}


ARROW = pa.schema([("k", pa.int32()), ("kind", pa.int32()), ("src", pa.int32()), *((c, pa.binary()) for c in BLOBS), *((c, pa.int64()) for c in SUM_COLUMNS)])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    ks, at = np.unique(shard, return_index=True)
    for k, a, b in zip(ks.tolist(), at, np.append(at[1:], len(shard))):
        yield k, slice(int(a), int(b))


def counted(docs: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """docs (block, held, text): what each block tells each shard."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for block in np.unique(blocks).tolist():
                own = batch.filter(pa.array(blocks == block))
                held.setdefault(block, []).append((*tokens(own.column(2)), ~own.column(1).to_numpy(zero_copy_only=False)))
        for block in sorted(held):
            yield from _told(block, held.pop(block))

    def _told(block: int, parts_of: list) -> Iterator[pa.RecordBatch]:
        token = np.concatenate([t for t, _, _ in parts_of])
        first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(f) for _, f, _ in parts_of]))))
        tables = Tables(token, first, np.concatenate([x for _, _, x in parts_of]), frequent, parts)
        del token, parts_of
        out = []
        for k, at in _cuts(tables.pair_shard):
            v = tables.v[at]
            starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            lengths = np.diff(np.append(starts, len(v))).astype(np.uint32)
            out.append(_row(k, PAIRS, block, (v[starts], lengths, tables.w[at], tables.pair_count[at])))
        for k, at in _cuts(tables.word_shard):
            out.append(_row(k, WORDS, block, (tables.word[at], tables.word_count[at])))
        for lo in range(0, len(out), 64):
            yield _batch(out[lo : lo + 64])

    return docs.mapInArrow(rows, SCHEMA)


def _blobs(shard: list[pa.RecordBatch], kind: int, kinds: tuple) -> list[tuple[int, list[np.ndarray]]]:
    out = []
    for batch in shard:
        for r in np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False) == kind).tolist():
            out.append((batch.column(2)[r].as_py(), [from_planes(batch.column(3 + i)[r].as_py(), t) for i, t in enumerate(kinds)]))
    return out


def mapped(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a file without a name, mapped into memory: pages that are not in use need not stay."""
    out = []
    with tempfile.TemporaryFile() as f:
        spots = []
        for x in arrays:
            spots.append(f.tell())
            x.tofile(f)
        f.flush()
        for x, spot in zip(arrays, spots):
            out.append(np.memmap(f, x.dtype, "r", spot, x.shape) if len(x) else x)
    return out


def pair_shards(told: DataFrame, parts: int, tasks: int) -> DataFrame:
    """Merges pairs and answers; sums for words go on, and what words were told passes through."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            for batch in shard:
                through = batch.filter(pa.array(batch.column(1).to_numpy(zero_copy_only=False) == WORDS))
                if through.num_rows:
                    yield through
            asked = [(src, np.repeat(v, n), w, c) for src, (v, n, w, c) in _blobs(shard, PAIRS, (np.uint64, np.uint32, np.uint64, np.uint32))]
            if not asked:
                continue
            keys = np.concatenate([pair_hash(v, w) for _, v, w, _ in asked])
            v, w, c = (np.concatenate([x[i] for x in asked]) for i in (1, 2, 3))
            order = np.argsort(keys)
            ranked = keys[order]
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            model_keys, model_counts = mapped(ranked[first], np.add.reduceat(c[order].astype(np.uint64), first))
            v, w = v[order[first]], w[order[first]]
            del keys, ranked, order, c
            out = []
            for src, av, aw, _ in asked:
                at = np.searchsorted(model_keys, pair_hash(av, aw))
                out.append(_row(src, PAIR_ANSWERS, shard[0].column(0)[0].as_py(), (np.asarray(model_counts[at]), digest(av, aw))))
            seen = np.asarray(model_counts)
            trained = seen > 0
            v, w, seen = v[trained], w[trained], seen[trained]
            first, which = np.unique(v, return_inverse=True)
            level = np.minimum(seen, 3)
            n = tuple(np.bincount(which[level == i], minlength=len(first)).astype(np.uint64) for i in (1, 2, 3))
            second, after = np.unique(w, return_counts=True)
            for kind, words, sums in ((FOLLOWED, first, n), (FOLLOWING, second, (after.astype(np.uint64),))):
                target = (words % np.uint64(parts)).astype(np.int64)
                sort = np.argsort(target, kind="stable")
                for k, at in _cuts(target[sort]):
                    out.append(_row(k, kind, 0, (words[sort[at]], *(x[sort[at]] for x in sums))))
            out.append(_row(-1, SUMS, 0, (), tuple(int((seen == i).sum()) for i in (1, 2, 3, 4))))
            for lo in range(0, len(out), 64):
                yield _batch(out[lo : lo + 64])

    return shard_by_shard(told, tasks).mapInArrow(rows, SCHEMA)


def word_shards(told: DataFrame, tasks: int) -> DataFrame:
    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            asked = _blobs(shard, WORDS, (np.uint64, np.uint32))
            following, followed = _blobs(shard, FOLLOWING, (np.uint64,) * 2), _blobs(shard, FOLLOWED, (np.uint64,) * 4)
            if not asked:
                continue
            words, which = np.unique(np.concatenate([x[0] for _, x in asked]), return_inverse=True)
            count = np.bincount(which, np.concatenate([x[1] for _, x in asked]), len(words)).astype(np.uint64)
            after_n = [np.zeros(len(words), np.uint64) for _ in range(4)]
            for told_of, first_column in ((following, 0), (followed, 1)):
                if told_of:
                    at = np.searchsorted(words, np.concatenate([x[0] for _, x in told_of]))
                    for i in range(len(told_of[0][1]) - 1):
                        after_n[first_column + i] = np.bincount(at, np.concatenate([x[1 + i] for _, x in told_of]), len(words)).astype(np.uint64)
            model = mapped(words, count, *after_n)
            out = []
            for src, (own, _) in asked:
                at = np.searchsorted(model[0], own)
                out.append(_row(src, WORD_ANSWERS, shard[0].column(0)[0].as_py(), tuple(np.asarray(x[at]) for x in model[1:])))
            token, after = words != BEGIN, after_n[0].astype(np.int64)
            out.append(_row(-2, SUMS, 0, (), (*(int((after == i).sum()) for i in (1, 2, 3, 4)), int(after.sum()), int(count[token].sum()), int((count[token] > 0).sum()), int((after >= 3).sum()))))
            for lo in range(0, len(out), 64):
                yield _batch(out[lo : lo + 64])

    return shard_by_shard(told, tasks).mapInArrow(rows, SCHEMA)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more; where counts of counts are missing, a half of what there is to take."""
    n = [n1, n2, n3, n4]
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2.0 * n2)
    out = [0.0]
    for i in (1, 2, 3):
        out.append(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else out[-1])
    return np.clip(out, [0.0, 0.05, 0.05, 0.05], [0.0, 0.95, 1.95, 2.95])


@dataclass(frozen=True)
class Model:
    pair_d: np.ndarray
    word_d: np.ndarray
    continuations: int  # distinct pairs in training
    levels: tuple[int, int, int]  # words by continuation count: 1, 2, 3 or more
    tokens: int
    known: int

    def word_share(self, after: np.ndarray) -> np.ndarray:
        uniform = 1.0 / (self.known + 1)
        if not self.continuations:
            return np.full(len(after), uniform)
        left = sum(d * n for d, n in zip(self.word_d[1:], self.levels)) / self.continuations
        return np.maximum(after - self.word_d[np.minimum(after, 3)], 0.0) / self.continuations + left * uniform

    def pair_share(self, count: np.ndarray, context: np.ndarray, n: tuple[np.ndarray, ...], share: np.ndarray) -> np.ndarray:
        """context: training count of the first word; n: its pairs seen once, twice, more; share: of the second word alone."""
        total = np.maximum(context, 1).astype(np.float64)
        left = sum(d * x for d, x in zip(self.pair_d[1:], n)) / total
        seen = np.maximum(count - self.pair_d[np.minimum(count, 3)], 0.0) / total
        return np.where(context > 0, seen + left * share, share)


def packed_texts(docs: DataFrame, id_kind: str) -> DataFrame:
    """docs (block, held, text, id) as few rows: the texts of a block in a batch, compressed, and their ids."""
    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for block in np.unique(blocks).tolist():
                own = batch.filter(pa.array(blocks == block))
                raw = [(t or "").encode() for t in own.column(2).to_pylist()]
                lengths = np.array([len(t) for t in raw], np.int64)
                row = {"k": block, "kind": TEXT, "src": 0, "a": own.column(1).to_numpy(zero_copy_only=False).tobytes(), "b": lengths.tobytes(), "c": pack(b"".join(raw))}
                ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column(3))
                yield pa.RecordBatch.from_arrays([*_batch([row]).columns, ids], names=[*ARROW.names, "ids"])

    return docs.mapInArrow(rows, f"{SCHEMA}, ids array<{id_kind}>")


def unpacked_texts(batch: pa.RecordBatch, row: int) -> pa.Array:
    lengths = np.frombuffer(batch.column(4)[row].as_py(), np.int64)
    raw = zstandard.ZstdDecompressor().decompress(batch.column(5)[row].as_py(), max_output_size=int(lengths.sum()) or 1)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def scored(batches: Iterator[pa.RecordBatch], model: Model, frequent: np.ndarray, parts: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for block in shards(batches):
        texts = [b for b in (b.filter(pa.array(b.column(1).to_numpy(zero_copy_only=False) == TEXT)) for b in block) if b.num_rows]
        if not texts:
            continue
        answers = {kind: dict(_blobs(block, kind, (np.uint64,) * n)) for kind, n in ((PAIR_ANSWERS, 2), (WORD_ANSWERS, 5))}
        del block
        ids = pa.concat_arrays([b.column(b.num_columns - 1).flatten() for b in texts])
        held = np.concatenate([np.frombuffer(x.as_py(), bool) for b in texts for x in b.column(3)])
        parts_of = [tokens(unpacked_texts(b, r)) for b in texts for r in range(b.num_rows)]
        del texts
        token = np.concatenate([t for t, _ in parts_of])
        first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts_of]))))
        del parts_of
        tables = Tables(token, first, ~held, frequent, parts)
        cuts = list(_cuts(tables.pair_shard))
        if set(answers[PAIR_ANSWERS]) != {k for k, _ in cuts} or any(answers[PAIR_ANSWERS][k][1] != digest(tables.v[at], tables.w[at]) for k, at in cuts):
            raise RuntimeError("a block changed between two scans: write the table before it is scored")
        pair = np.concatenate([answers[PAIR_ANSWERS][k][0] for k, _ in cuts])
        word = [np.concatenate([answers[WORD_ANSWERS][k][i] for k, _ in _cuts(tables.word_shard)]) for i in range(5)]
        count, after = word[0].astype(np.int64), word[1].astype(np.int64)
        at_v, at_w = tables.word_places(tables.v), tables.word_places(tables.w)
        share = model.pair_share(pair.astype(np.int64), count[at_v], tuple(x[at_v] for x in word[2:]), model.word_share(after)[at_w])
        base = np.log10((count + 1.0) / (model.tokens + (model.known + 1.0)))
        starts = first[:-1]
        yield pa.RecordBatch.from_arrays(
            [
                ids, pa.array(held), pa.array(np.diff(first)),
                pa.array(np.add.reduceat((count > 0)[tables.word_of].astype(np.int64), starts)),
                pa.array(np.full(len(starts), model.tokens)),
                pa.array(np.add.reduceat(base[tables.word_of], starts)),
                pa.array(np.add.reduceat(np.log10(share)[tables.pair_of], starts)),
            ],
            names=names,
        )


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df.

    df must give the same rows in the same partitions when read twice, as scans and written tables do; a block that
    differs is an error, not a wrong score."""
    tasks, parts = partitions(df), max(LEAST_SHARDS, -(-input_bytes(df) // SHARD_BYTES))
    crc = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8"))
    cuts = max(1, -(-split_bytes(df.sparkSession) // BLOCK_BYTES))
    block = F.spark_partition_id() * F.lit(cuts) + F.pmod(F.xxhash64(id_col, text_col), F.lit(cuts)).cast("int")
    docs = df.select(block.alias("block"), (crc % 7 == 2).alias("held"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    frequencies, n_texts = document_frequencies(df, text_col)
    frequent = frequencies > max(64, n_texts * FREQUENT)
    pairs = written(pair_shards(counted(docs.select("block", "held", "text"), frequent, parts), parts, tasks), "pairs")
    release_shuffles(df.sparkSession)
    words = written(word_shards(pairs.where(f"kind in ({WORDS}, {FOLLOWED}, {FOLLOWING})"), tasks), "words")
    release_shuffles(df.sparkSession)
    total = {r.k: [x or 0 for x in r[1:]] for said in (pairs, words) for r in said.where(f"kind = {SUMS}").groupBy("k").agg(*(F.sum(c).alias(c) for c in SUM_COLUMNS)).collect()}
    p, w = total.get(-1, [0] * 8), total.get(-2, [0] * 8)
    model = Model(discounts(*p[:4]), discounts(*w[:4]), w[4], (w[0], w[1], w[7]), w[5], w[6])

    kind = df.schema[id_col].dataType.simpleString()
    body = packed_texts(docs.select("block", "held", "text", "id"), kind)
    answers = pairs.where(f"kind = {PAIR_ANSWERS}").union(words.where(f"kind = {WORD_ANSWERS}"))
    both = answers.unionByName(body, allowMissingColumns=True)
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scored(batches, model, frequent, parts, names)

    dealt = both.repartition(tasks, "k").sortWithinPartitions("k", "kind")
    return dealt.mapInArrow(rows, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
