"""Windows of a fixed length that start earlier elsewhere, over whole texts, exactly.

A text is a sequence of symbols (bytes or words). The smallest q-gram hash inside a window is its
anchor: it depends on the window alone, so equal windows have equal anchors at equal places, and
consecutive windows mostly share one. What travels is a *run*: the windows around one anchor.

1. Each scan task lists the runs of its texts and keeps one of those that are equal as a whole; the
   others start later than the one kept, so they are repeats for certain. A run that a third of
   all documents hold leaves each task once.
2. Runs meet by anchor. The earliest of each class of equal runs goes on; the rest are repeats. Where
   one anchor has several classes, their windows may still agree in part: those runs are asked for.
3. The texts are dealt by document, each followed by what was asked of it, and hand on the symbols.
4. Shards of these passages, dealt by anchor, are searched by the operator's own method.
5. The texts are dealt again, with their repeats, to the operator's last step.

Rows of the shuffles are sorted arrays of many runs, as bytes; tasks hold arrays, not objects.
Anchors are compared by 48 bits and runs by 64, so 112 bits stand for a run.

The order of windows is (id, hash of the text, start), a null id last. Rows with the same id and
text are one document: they neither repeat each other nor differ in what they get.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.arrays import Rolling, Words, byte_symbols, mix, ranges, text_chunks
from quadrille.llm.spark_io import frugal, partitions, release_shuffles, written

NULL_ID = (1 << 63) - 1
CLASSES, REPEATS, ASKED, PASSAGES, TEXT = 0, 1, 2, 3, 9
BLOBS = {"doc": np.int64, "t": np.int32, "s": np.int32, "e": np.int32, "h": np.uint64, "g": np.uint64}
SCHEMA = "k int, kind int, doc binary, t binary, s binary, e binary, h binary, g binary, c binary"
#: Runs that a scan task holds before it hands on those it has.
HELD_RUNS = 300_000
#: Bytes of passages that a task holds before it hands them on.
HELD_PASSAGES = 8 << 20
CHUNK = 1 << 19
#: Shards are this many times the tasks, so that one is a part of what a task reads.
SHARDS_OF_A_TASK = 4


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, and so on: small numbers leave planes of zeros, which shuffle files compress away."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


@dataclass(frozen=True)
class Windows:
    kind: str  # bytes or words
    length: int
    gram: int

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a chunk and where each document's begin."""
        if self.kind == "bytes":
            return byte_symbols(data), offsets
        words = Words(data, offsets)
        return words.hashes(), words.first

    def code(self, symbols: np.ndarray, data: np.ndarray) -> np.ndarray:
        """What stands for a symbol in a passage: the byte, or the word's hash."""
        return data if self.kind == "bytes" else symbols

    @property
    def code_type(self):
        return np.uint8 if self.kind == "bytes" else np.uint64


def runs(symbols: np.ndarray, first: np.ndarray, w: Windows) -> dict[str, np.ndarray]:
    """doc: place of the document, s and e: first window start and one past the last, from the
    document's own beginning; h: the anchor, g: the whole run and the anchor's place in it."""
    n = len(symbols)
    empty = {"doc": np.zeros(0, np.int64), "s": np.zeros(0, np.int32), "e": np.zeros(0, np.int32), "h": np.zeros(0, np.uint64), "g": np.zeros(0, np.uint64)}
    if n < w.length:
        return empty
    rolling = Rolling(symbols)
    grams = rolling.every(w.gram) >> np.uint64(16)
    # hash above, place below: the leftmost of the smallest wins
    bits = np.uint64(int(n).bit_length())
    places = (np.uint64(1) << bits) - np.uint64(1)
    least = (mix(grams) & ~places) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, w.length - w.gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n - w.length + 1], least[span - width : span - width + n - w.length + 1])
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)[: n - w.length + 1]
    starts = np.flatnonzero(np.arange(n - w.length + 1) + w.length <= ends)
    if not len(starts):
        return empty
    anchor = (least[starts] & places).astype(np.int64)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    s0 = starts[fresh]
    s1 = starts[np.append(np.flatnonzero(fresh)[1:] - 1, len(starts) - 1)]
    anchor = anchor[fresh]
    doc = np.searchsorted(first, s0, side="right") - 1
    whole = rolling.of(s0, s1 + w.length)
    return {
        "doc": doc,
        "s": (s0 - first[doc]).astype(np.int32),
        "e": (s1 + 1 - first[doc]).astype(np.int32),
        "h": grams[anchor],
        "g": mix(whole + mix(((anchor - s0).astype(np.uint64) << np.uint64(32)) + (s1 - s0).astype(np.uint64))),
    }


def classes(run: dict[str, np.ndarray]) -> tuple[dict, dict, np.ndarray]:
    """(the earliest of each class of equal runs, the later ones, which of the earliest share an anchor)."""
    order = np.lexsort((run["s"], run["t"], run["doc"], run["g"], run["h"]))
    run = {k: v[order] for k, v in run.items()}
    same_h = run["h"][1:] == run["h"][:-1]
    same = same_h & (run["g"][1:] == run["g"][:-1])
    first = np.ones(len(order), dtype=bool)
    first[1:] = ~same
    firsts = {k: v[first] for k, v in run.items()}
    shared = np.zeros(len(firsts["h"]), dtype=bool)
    again = firsts["h"][1:] == firsts["h"][:-1]
    shared[1:] |= again
    shared[:-1] |= again
    # a copy of the first's own row is the same document, so it repeats nothing
    place = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    own = (run["doc"] == run["doc"][place]) & (run["t"] == run["t"][place]) & (run["s"] == run["s"][place])
    return firsts, {k: v[~first & ~own] for k, v in run.items()}, shared


def concatenated(parts: list[dict[str, np.ndarray]], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, BLOBS[k]) for k in names}


def by_document(run: dict[str, np.ndarray], parts: int) -> np.ndarray:
    return np.mod(run["doc"] ^ run["t"], parts).astype(np.int32)


def by_anchor(run: dict[str, np.ndarray], parts: int) -> np.ndarray:
    return (mix(run["h"] + np.uint64(1)) % np.uint64(parts)).astype(np.int32)


def packed(kind: int, k: np.ndarray, run: dict[str, np.ndarray], codes: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """One row for each k: the arrays of its items, in order. codes: all passages and their offsets."""
    order = np.lexsort((run["s"], run["doc"], k))
    ks, at = np.unique(k[order], return_index=True)
    stops = np.append(at[1:], len(order))
    columns = {c: [None] * len(ks) for c in (*BLOBS, "c")}
    for c, kind_of in BLOBS.items():
        if c in run:
            values = run[c].astype(kind_of, copy=False)[order]
            if c == "e":
                values = values - run["s"][order].astype(kind_of, copy=False)
            columns[c] = [planes(np.diff(values[a:b], prepend=0) if c == "doc" else values[a:b]) for a, b in zip(at, stops)]
    if codes is not None:
        data, offsets = codes
        lengths = np.diff(offsets)[order]
        data = data[ranges(offsets[:-1][order], lengths)]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        columns["c"] = [data[sums[a] : sums[b]].tobytes() for a, b in zip(at, stops)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ks.astype(np.int32)), pa.array(np.full(len(ks), kind, np.int32)), *(pa.array(v, pa.binary()) for v in columns.values())],
        names=["k", "kind", *columns],
    )


def unpacked(batch: pa.RecordBatch, names: tuple[str, ...], kind: int) -> list[dict[str, np.ndarray]]:
    columns = {c: batch.column(batch.schema.get_field_index(c)) for c in (*names, "kind")}
    rows = np.flatnonzero(columns["kind"].to_numpy(zero_copy_only=False) == kind)
    out = []
    for r in rows:
        part = {c: from_planes(columns[c][int(r)].as_py(), BLOBS[c]) for c in names}
        part["doc"] = np.cumsum(part["doc"])
        part["e"] = part["s"] + part["e"]
        out.append(part)
    return out


def keyed(df: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(k, doc, t, text): the order of a document, and the shard that holds what concerns it."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    t = text_order(text_col)
    return df.select(F.pmod(doc.bitwiseXOR(t.cast("long")), F.lit(parts)).cast("int").alias("k"), doc.alias("doc"), t.alias("t"), F.col(text_col).alias("text"))


def text_order(text_col: str):
    """32 bits of the text's hash: they tell rows of one id apart, no more."""
    return F.shiftright(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 32).cast("int")


def scanned(docs: DataFrame, w: Windows, parts: int) -> DataFrame:
    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def hand_on():
            firsts, later, _ = classes(concatenated(held, ("doc", "t", "s", "e", "h", "g")))
            yield packed(CLASSES, by_anchor(firsts, parts), firsts)
            if len(later["s"]):
                later = {c: later[c] for c in ("doc", "t", "s", "e")}
                yield packed(REPEATS, by_document(later, parts), later)

        for batch in batches:
            doc, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for row, data, offsets in text_chunks(batch.column(3), CHUNK):
                run = runs(*w.symbols(data, offsets), w)
                own = row + run["doc"]
                held.append(run | {"doc": doc[own], "t": t[own]})
                size += len(own)
                if size > HELD_RUNS:
                    yield from hand_on()
                    held, size = [], 0
        if size:
            yield from hand_on()

    return docs.mapInArrow(rows, SCHEMA)


def shard_by_shard(df: DataFrame, tasks: int) -> DataFrame:
    """Shards dealt to tasks, in which each stands together: a task holds one at a time."""
    return df.repartition(tasks, "k").sortWithinPartitions("k")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each shard, from rows sorted by shard."""
    held, last = [], None
    for batch in batches:
        ks = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ks[1:] != ks[:-1]) + 1).tolist(), len(ks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and ks[a] != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = ks[a]
    if held:
        yield held


def met(runs_of_all: DataFrame, parts: int) -> DataFrame:
    """Classes meet by anchor; repeats pass through."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            held = []
            for batch in shard:
                held += unpacked(batch, ("doc", "t", "s", "e", "h", "g"), CLASSES)
                through = batch.filter(pa.array(batch.column(1).to_numpy(zero_copy_only=False) == REPEATS))
                if through.num_rows:
                    yield through
            del shard
            if held:
                firsts, later, shared = classes(concatenated(held, ("doc", "t", "s", "e", "h", "g")))
                if len(later["s"]):
                    later = {c: later[c] for c in ("doc", "t", "s", "e")}
                    yield packed(REPEATS, by_document(later, parts), later)
                if shared.any():
                    asked = {c: firsts[c][shared] for c in ("doc", "t", "s", "e", "h")}
                    yield packed(ASKED, by_document(asked, parts), asked)

    return shard_by_shard(runs_of_all, parts // SHARDS_OF_A_TASK).mapInArrow(rows, SCHEMA)


class Held:
    """What shards have said about documents, by document."""

    def __init__(self, names: tuple[str, ...], parts: list[dict[str, np.ndarray]]):
        self.run = concatenated(parts, names)
        order = np.lexsort((self.run["s"], self.run["t"], self.run["doc"]))
        self.run = {k: v[order] for k, v in self.run.items()}
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (self.run["doc"][1:] != self.run["doc"][:-1]) | (self.run["t"][1:] != self.run["t"][:-1])
        self.at = np.append(np.flatnonzero(fresh), len(order))
        heads = self.at[:-1]
        self.place = {key: i for i, key in enumerate(zip(self.run["doc"][heads].tolist(), self.run["t"][heads].tolist()))}

    def span(self, doc: int, t: int) -> tuple[int, int]:
        i = self.place.get((doc, t))
        return (0, 0) if i is None else (int(self.at[i]), int(self.at[i + 1]))


def beside(texts: DataFrame, said: DataFrame, payload: str, parts: int) -> DataFrame:
    """Texts and what was said about them, dealt by document; in each task what was said stands first."""
    named = said.select("k", "kind", "doc", "t", "s", "e", "h").withColumn(payload, F.lit(None).cast(texts.schema[payload].dataType))
    as_blob = lambda c: F.lit(None).cast("binary").alias(c)
    rows = texts.select("k", F.lit(TEXT).alias("kind"), *map(as_blob, ("doc", "t", "s", "e", "h")), payload)
    return named.unionByName(rows).repartition(parts // SHARDS_OF_A_TASK, "k").sortWithinPartitions("kind")


def told(batches: Iterator[pa.RecordBatch], kind: int, names: tuple[str, ...]) -> Iterator[tuple[Held, pa.RecordBatch]]:
    """Each batch of texts, with all that was said."""
    parts, held = [], None
    for batch in batches:
        parts += unpacked(batch, names, kind)
        texts = batch.filter(pa.array(batch.column(1).to_numpy(zero_copy_only=False) == TEXT))
        if texts.num_rows:
            held = held or Held(names, parts)
            parts = []
            yield held, texts


def passages(docs: DataFrame, asked: DataFrame, w: Windows, parts: int) -> DataFrame:
    """The symbols of the runs that were asked for, dealt by anchor."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict[str, np.ndarray]] = []
        codes: list[np.ndarray] = []
        size = 0

        def hand_on():
            run = concatenated(found, ("doc", "t", "s", "e", "h"))
            lengths = (run["e"] - run["s"]).astype(np.int64) + (w.length - 1)
            return packed(PASSAGES, by_anchor(run, parts), run, (np.concatenate(codes), np.concatenate(([0], np.cumsum(lengths)))))

        for held, batch in told(batches, ASKED, ("doc", "t", "s", "e", "h")):
            body = batch.column(batch.num_columns - 1)
            doc, t, texts = (body.field(i) for i in range(3))
            doc, t = doc.to_numpy(zero_copy_only=False), t.to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(texts, CHUNK):
                spans = [held.span(doc[row + i], t[row + i]) for i in range(len(offsets) - 1)]
                if not any(b > a for a, b in spans):
                    continue
                symbols, first = w.symbols(data, offsets)
                items = ranges(np.array([a for a, _ in spans]), np.array([b - a for a, b in spans]))
                begin = np.repeat(first[:-1], [b - a for a, b in spans])
                run = {c: v[items] for c, v in held.run.items()}
                starts, stops = begin + run["s"], begin + run["e"] + w.length - 1
                found.append(run)
                codes.append(w.code(symbols, data)[ranges(starts, stops - starts)])
                size += codes[-1].nbytes
                if size > HELD_PASSAGES:
                    yield hand_on()
                    found, codes, size = [], [], 0
        if size:
            yield hand_on()

    bodies = docs.select("k", F.struct("doc", "t", "text").alias("body"))
    return beside(bodies, asked.where(f"kind = {ASKED}"), "body", parts).mapInArrow(rows, SCHEMA)


#: Which starts of a passage's windows agree with an earlier one: (codes, offsets, n_starts) -> a class for each start, -1 for one that stands alone.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def _later_windows(shard: list[pa.RecordBatch], w: Windows, search: Search) -> dict[str, np.ndarray]:
    """Ranges of window starts, in a shard of passages, that agree with an earlier one."""
    held, code = [], []
    for batch in shard:
        held += unpacked(batch, ("doc", "t", "s", "e"), PASSAGES)
        code += [np.frombuffer(x.as_py(), w.code_type) for x in batch.column(batch.schema.get_field_index("c"))]
    run = concatenated(held, ("doc", "t", "s", "e"))
    code = np.concatenate(code)
    n_starts = (run["e"] - run["s"]).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(n_starts + w.length - 1)))
    which = search(code, offsets, n_starts, w.length)
    passage = np.repeat(np.arange(len(n_starts)), n_starts)
    start = run["s"][passage] + (np.arange(len(passage)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts))
    tied = np.flatnonzero(which >= 0)
    doc, t, s, which = run["doc"][passage[tied]], run["t"][passage[tied]], start[tied], which[tied]
    order = np.lexsort((s, t, doc, which))
    first = np.ones(len(order), dtype=bool)
    first[1:] = which[order][1:] != which[order][:-1]
    later = order[~first]
    # neighbouring starts of one document become one range
    order = later[np.lexsort((s[later], t[later], doc[later]))]
    doc, t, s = doc[order], t[order], s[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + 1)
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(order) - 1) if len(order) else np.zeros(0, np.int64)
    return {"doc": doc[fresh], "t": t[fresh], "s": s[fresh].astype(np.int32), "e": (s[last] + 1).astype(np.int32)}


def searched(found: DataFrame, w: Windows, search: Search, parts: int) -> DataFrame:
    """Repeats inside shards of passages, by the operator's own method."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            out = _later_windows(shard, w, search)
            if len(out["s"]):
                yield packed(REPEATS, by_document(out, parts), out)

    return shard_by_shard(found, parts // SHARDS_OF_A_TASK).mapInArrow(rows, SCHEMA)


def repeats(df: DataFrame, w: Windows, search: Search, name: str, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Ranges of window starts that start earlier elsewhere, by document; and the number of shards."""
    parts = SHARDS_OF_A_TASK * partitions(df)
    docs = keyed(df, id_col, text_col, parts)
    said = written(met(scanned(docs, w, parts), parts), name)
    release_shuffles(df.sparkSession)
    again = written(searched(passages(docs, said, w, parts), w, search, parts), name)
    release_shuffles(df.sparkSession)
    return said.where(f"kind = {REPEATS}").union(again), parts


def covered_of(held: Held, doc: int, t: int, n: int, length: int) -> np.ndarray:
    """Which of a document's n symbols lie in a repeated window."""
    depth = np.zeros(n + 1, dtype=np.int32)
    a, b = held.span(doc, t)
    np.add.at(depth, held.run["s"][a:b], 1)
    np.subtract.at(depth, held.run["e"][a:b] + (length - 1), 1)
    return np.cumsum(depth[:n]) > 0


def with_repeats(df: DataFrame, found: DataFrame, parts: int, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """Rows for the last step: body holds doc, t and the columns of df."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    t = text_order(text_col)
    body = F.struct(doc.alias("doc"), t.alias("t"), F.struct(*columns).alias("row"))
    texts = df.select(F.pmod(doc.bitwiseXOR(t.cast("long")), F.lit(parts)).cast("int").alias("k"), body.alias("body"))
    return beside(texts, found, "body", parts)
