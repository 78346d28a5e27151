"""Benchmark decontamination by latent semantic retrieval.

Document frequencies are counted over the whole corpus (in a fixed number of hashed buckets).
Benchmark passages become TF-IDF rows; a randomised SVD of them, whose products with the matrix are
summed over Spark partitions, gives the latent space. Every run of 16, 32 and 64 words of every text, at each eighth word, is
folded in; its cosine with a benchmark passage can't exceed the share of its length that the space
keeps, so most are discarded by that bound, and the rest are compared with all passages. Beside these, every stretch
of up to REACH times an item's words that the decision can accept is a candidate whatever the words weigh: it holds
a least number of the item's rarest words, which are looked up word by word. Candidates are
decided by the longest common subsequence of words and a check of the passage's answer part.

The benchmark is taken in blocks of a bounded number of items and words, so that what tasks receive is bounded;
the space of a block has as many dimensions as the block has items, so that it holds each of them whole, and
all blocks are held against all texts.

Defined cases: an item of fewer words than ``Rules.least_words`` is no passage and is never found; a null or empty text or item matches nothing; a null id is passed through; equal
items are each reported; an empty benchmark or table gives an empty result; other columns are not read, and
``drop_leaks`` returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quadrille.llm.arrays import Words, text_chunks
from quadrille.llm.spark_io import frugal

BUCKETS = 1 << 17
STRIDE = 8
#: Lengths of the passages, in strides.
SPANS = (2, 4, 8)
#: A block is of at most so many items and words (but of one item at least); a pass over the texts takes the blocks of about GROUP_ITEMS items.
BLOCK_ITEMS, BLOCK_WORDS, GROUP_ITEMS = 256, 1 << 14, 1024
POWER_STEPS = 2
#: Accepted subsequences that spread over at most so many times the item's words are candidates without fail.
REACH = 2
CHUNK = 1 << 20


@dataclass(frozen=True)
class Rules:
    cosine: float = 0.5
    #: Share of the item's words in the common subsequence: enough alone, or with the answer's share.
    overlap: float = 0.8
    paraphrase: float = 0.55
    answer: float = 0.6
    #: An item of fewer words is no passage.
    least_words: int = 8


def document_frequencies(df: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """By hashed word: in how many texts; and the number of texts. Summed over all rows before it is collected."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            texts += batch.num_rows
            for _, data, offsets in text_chunks(batch.column(0), CHUNK):
                words = Words(data, offsets)
                bucket = (words.hashes(lower=True) % np.uint64(BUCKETS)).astype(np.int64)
                held = np.sort(words.doc * BUCKETS + bucket)
                held = held[np.append(True, held[1:] != held[:-1])] if len(held) else held
                total += np.bincount(held % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts))], names=["b", "n"])

    found = df.select(text_col).mapInArrow(rows, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    real = found[found.b >= 0]
    counts[real.b.to_numpy()] = real.n.to_numpy()
    return counts, int(found.n[found.b < 0].sum())


def randomised_svd(rows: DataFrame, n_columns: int, rank: int) -> np.ndarray:
    """Right singular vectors (columns x rank) of a matrix given as rows (at array<int>, x array<double>):
    subspace iteration, whose products are summed over the partitions of the rows."""
    rng = np.random.Generator(np.random.PCG64(11))
    basis = np.linalg.qr(rng.standard_normal((n_columns, rank)))[0]

    def product(q: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(q.shape)
            for batch in batches:
                for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    x = np.array(x)
                    out[at] += np.outer(x, x @ q[at])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["m"])

        return sum(np.frombuffer(r.m).reshape(q.shape) for r in rows.mapInArrow(part, "m binary").toLocalIterator())

    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(product(basis))[0]
    return basis


class Block:
    """Some benchmark items, ready to be looked for: bounded by BLOCK_ITEMS and BLOCK_WORDS."""

    def __init__(self, benchmark: DataFrame, items: list[tuple], counts: np.ndarray, n_texts: int, rules: Rules):
        self.rules = rules
        self.idf = np.log((n_texts + 1.0) / (counts + 1.0)).astype(np.float32)
        self.ids, self.words, self.answer = [], [], []
        for item_id, text in items:
            texts = pa.array([text or ""])
            for _, data, offsets in text_chunks(texts):
                words = Words(data, offsets)
                if len(words) >= rules.least_words:
                    ends_sentence = np.isin(data[words.ends - 1], np.frombuffer(b".!?", np.uint8))
                    ends_sentence[-1] = False
                    last = int(np.flatnonzero(ends_sentence)[-1]) + 1 if ends_sentence.any() else (3 * len(words)) // 4
                    self.ids.append(item_id)
                    self.words.append(words.hashes(lower=True))
                    self.answer.append(last)
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        if not self.words:
            return
        self._anchor(counts)
        weights = self.weights(self.vocabulary)
        rows = []
        for words in self.words:
            at, tf = np.unique(np.searchsorted(self.vocabulary, words), return_counts=True)
            x = tf * weights[at]
            rows.append((at.tolist(), (x / max(np.linalg.norm(x), 1e-12)).astype(float).tolist()))
        spark = benchmark.sparkSession
        rank = min(len(rows), len(self.vocabulary))
        basis = randomised_svd(spark.createDataFrame(rows, "at array<int>, x array<double>"), len(self.vocabulary), rank)
        self.fold = (basis * weights[:, None]).astype(np.float32)
        latent = np.array([np.array(x) @ basis[at] for at, x in rows])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.masks = [self._masks(w) for w in self.words]

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        return self.idf[(hashes % np.uint64(BUCKETS)).astype(np.int64)]

    def _anchor(self, counts: np.ndarray) -> None:
        """Each item's rarest words, and how many places of them an accepted subsequence holds at least: it has ``need`` of the
        item's words, and not more than ``need // 2`` of them can be other words."""
        frequency = counts[(self.vocabulary % np.uint64(BUCKETS)).astype(np.int64)]
        held, quota = [], []
        for words in self.words:
            n = len(words)
            need = max(1, math.ceil(min(self.rules.overlap, self.rules.paraphrase) * n - 1e-9))
            at, tf = np.unique(np.searchsorted(self.vocabulary, words), return_counts=True)
            order = np.argsort(frequency[at], kind="stable")
            places = np.cumsum(tf[order])
            m = int(np.searchsorted(places, n - need // 2)) + 1
            held.append(at[order[:m]])
            quota.append(need - (n - int(places[m - 1])))
        word = np.concatenate(held)
        order = np.argsort(word, kind="stable")
        self.anchor_items = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])[order]
        self.anchor_first = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))
        self.quota = np.array(quota)
        self.reach = np.array([REACH * len(w) for w in self.words])

    @staticmethod
    def _masks(words: np.ndarray) -> dict[int, int]:
        masks: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        return masks

    def common(self, item: int, words: list[int]) -> tuple[int, int]:
        """Length of the longest common subsequence with the item, and with its answer part."""
        masks, n, at = self.masks[item], len(self.words[item]), self.answer[item]
        full = (1 << n) - 1
        v, a = full, full >> at
        whole = a
        for w in words:
            m = masks.get(w, 0)
            if m:
                u = v & m
                v = (v + u | v - u) & full
                m >>= at
                u = a & m
                a = (a + u | a - u) & whole
        return n - v.bit_count(), n - at - a.bit_count()

    def leaks(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, common words, common answer words) of each document of a chunk and item that match."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, item, a, b in self._candidates(words, hashes):
            found.setdefault((doc, item), []).append((a, b))
        for (doc, item), spans in sorted(found.items()):
            best = max((self._decide(words, hashes, doc, item, a, b) for a, b in self._merged(spans, len(self.words[item]))), default=None)
            if best and best[0]:
                yield doc, item, best[1], best[2]

    @staticmethod
    def _merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1] and b - out[-1][0] <= max(4 * STRIDE * SPANS[-1], 2 * REACH * n):
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def _decide(self, words: Words, hashes: np.ndarray, doc: int, item: int, a: int, b: int) -> tuple[bool, int, int]:
        n = len(self.words[item])
        a, b = max(int(words.first[doc]), a - n), min(int(words.first[doc + 1]), b + n)
        common, answer = self.common(item, hashes[a:b].tolist())
        share, part = common / n, answer / max(1, n - self.answer[item])
        return share >= self.rules.overlap or share >= self.rules.paraphrase and part >= self.rules.answer, common, answer

    def _candidates(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, one past the last) of passages near an item."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes
        yield from self._holding(words, at, known)
        weight = self.weights(hashes)
        strides = -(-words.counts // STRIDE)
        n = int(strides.sum())
        doc = np.repeat(np.arange(len(strides)), strides)
        nth = np.arange(n) - np.repeat(np.cumsum(strides) - strides, strides)
        begin = words.first[doc] + STRIDE * nth
        mass = np.add.reduceat(np.stack((weight * weight, weight * weight * known)), begin, axis=1)
        need = self.rules.cosine**2
        # by Cauchy and Schwarz a passage that holds little of the vocabulary is near no item
        wanted, near = np.zeros(n, dtype=bool), []
        last = np.repeat(np.cumsum(strides), strides)
        for span in SPANS:
            whole, inside = _slid(mass[0], span, last), _slid(mass[1], span, last)
            p = np.flatnonzero(inside >= need * whole)
            near.append(p)
            for k in range(span):
                q = p + k
                wanted[q[q < last[p]]] = True
        slot = np.cumsum(wanted) - 1
        latent = self._folded(at, known, begin, words.first[doc + 1], np.flatnonzero(wanted))
        for span, p in zip(SPANS, near):
            for lo in range(0, len(p), 4096):
                q = p[lo : lo + 4096]
                x = np.zeros((len(q), latent.shape[1]), dtype=np.float32)
                whole = np.zeros(len(q), dtype=np.float32)
                for k in range(span):
                    held = q + k < last[q]
                    x[held] += latent[slot[q[held] + k]]
                    whole[held] += mass[0][q[held] + k]
                norm = np.einsum("ij,ij->i", x, x)
                held = norm >= need * whole
                scores = x[held] @ self.latent.T
                i, item = np.nonzero(scores >= self.rules.cosine * np.sqrt(whole[held])[:, None])
                for s, j in zip(q[held][i].tolist(), item.tolist()):
                    d = int(doc[s])
                    yield d, j, int(begin[s]), min(int(begin[s]) + STRIDE * span, int(words.first[d + 1]))

    def _holding(self, words: Words, at: np.ndarray, known: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The same of stretches that hold enough of an item's rarest words."""
        p = np.flatnonzero(known)
        first = self.anchor_first[at[p]]
        n = self.anchor_first[at[p] + 1] - first
        item = self.anchor_items[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        order = np.argsort(item, kind="stable")
        item, place = item[order].astype(np.int64), np.repeat(p, n)[order]
        i = np.arange(len(item))
        j = i + self.quota[item] - 1
        i, j = i[j < len(item)], j[j < len(item)]
        doc = words.doc
        held = (item[i] == item[j]) & (place[j] - place[i] < self.reach[item[i]]) & (doc[place[i]] == doc[place[j]])
        which, a, b = item[i[held]], place[i[held]], place[j[held]]
        # with the item's length on both sides, as the decision takes it, all stretches that hold both places
        own, rest = doc[a], (REACH - 1) * (self.reach[which] // REACH)
        low, high = np.maximum(b + 1 - rest, words.first[own]), np.minimum(a + rest, words.first[own + 1])
        yield from zip(own.tolist(), which.tolist(), low.tolist(), high.tolist())

    def _folded(self, at: np.ndarray, known: np.ndarray, begin: np.ndarray, end: np.ndarray, strides: np.ndarray) -> np.ndarray:
        """The latent vectors of some strides."""
        out = np.zeros((len(strides), self.fold.shape[1]), dtype=np.float32)
        for k in range(STRIDE):
            w = begin[strides] + k
            held = np.flatnonzero(w < end[strides])
            held = held[known[w[held]]]
            out[held] += self.fold[at[w[held]]]
        return out


def _slid(x: np.ndarray, span: int, last: np.ndarray) -> np.ndarray:
    """Sums of span consecutive strides of one document, fewer at its end."""
    total = np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))
    return total[np.minimum(np.arange(len(x)) + span, last)] - total[:-1]


def cut(items: list[tuple]) -> Iterator[list[tuple]]:
    """The items in runs of at most BLOCK_ITEMS items and, but for a single item, BLOCK_WORDS words."""
    run, size = [], 0
    for item in items:
        n = len((item[1] or "").split())
        if run and (len(run) == BLOCK_ITEMS or size + n > BLOCK_WORDS):
            yield run
            run, size = [], 0
        run.append(item)
        size += n
    if run:
        yield run


def groups(df: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, rules: Rules) -> Iterator[list[Block]]:
    """The blocks of the benchmark, those of one pass together."""
    n_groups = math.ceil(benchmark.count() / GROUP_ITEMS)
    if not n_groups:
        return
    counts, n_texts = document_frequencies(df, text_col)
    which = F.pmod(F.xxhash64(item_col, item_text), F.lit(n_groups))
    for k in range(n_groups):
        items = [tuple(r) for r in benchmark.where(which == k).select(item_col, item_text).collect()]
        made = [Block(benchmark, run, counts, n_texts, rules) for run in cut(items)]
        made = [block for block in made if block.ids]
        if made:
            yield made


def leaks(blocks: list[Block], texts: pa.Array) -> Iterator[tuple[Block, int, int, int, int]]:
    """(block, row, item, common words, common answer words) of each text and item that match."""
    for row, data, offsets in text_chunks(texts, CHUNK):
        words = Words(data, offsets)
        if not len(words):
            continue
        hashes = words.hashes(lower=True)
        for block in blocks:
            for doc, item, common, answer in block.leaks(words, hashes):
                yield block, row + doc, item, common, answer


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(id, item, item_words, common_words, answer_words, overlap): a row for each text and item that match."""
    if id_col in ("item_id", "item_words", "common_words", "answer_words", "overlap"):
        raise ValueError("the id has the name of a column that is added")
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {kind}, item_id {item_kind}, item_words int, common_words int, answer_words int, overlap double"
    spark = df.sparkSession
    out = spark.createDataFrame([], schema)
    for blocks in groups(df, benchmark, text_col, item_col, item_text, rules):
        shared = spark.sparkContext.broadcast(blocks)

        @frugal
        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(leaks(shared.value, batch.column(1)))
                at = [x[1] for x in found]
                n = [len(x[0].words[x[2]]) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array([x[0].ids[x[2]] for x in found], item_type), pa.array(n, pa.int32()), pa.array([x[3] for x in found], pa.int32()), pa.array([x[4] for x in found], pa.int32()), pa.array([x[3] / m for x, m in zip(found, n)], pa.float64())],
                    names=[id_col, "item_id", "item_words", "common_words", "answer_words", "overlap"],
                )

        out = out.union(df.select(id_col, text_col).mapInArrow(rows, schema))
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of df that match no benchmark item, with all their columns."""
    at, source = df.columns.index(text_col), df
    for blocks in groups(source, benchmark, text_col, item_col, item_text, rules):
        shared = df.sparkSession.sparkContext.broadcast(blocks)

        @frugal
        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[x[1] for x in leaks(shared.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(rows, source.schema)
    return df
