"""Removal of repeated substrings: bytes by refined suffix buckets, words by a compressed index.

Both find every window of a fixed length that starts earlier anywhere (smaller id, or the same
document and an earlier start) and remove all it covers; windows are judged on the input.

Defined cases: a null or empty text has nothing to remove; a null id comes last in the order; rows of one id
and one text are one document and are treated alike, and of one id with different texts the order
is that of the texts' hashes; an empty table gives an empty one; columns besides the id and the text
are returned as they are by ``cut_repeats`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.arrays import gather, text_chunks
from quadrille.llm.spark_io import frugal
from quadrille.llm.suffixes import dense, pointed, refine
from quadrille.llm.wavelet import FMIndex
from quadrille.llm.windows import CHUNK, REPEATS, Windows, covered_of, repeats, told, with_repeats

BYTES = Windows("bytes", 100, 24)
WORDS = Windows("words", 20, 5)
#: Bytes of the first buckets of the refinement.
FIRST_BUCKET = 4


def bucket_search(code: np.ndarray, offsets: np.ndarray, n_starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket-pointer refinement: places of q-gram buckets are sorted by the bucket of a later
    offset, each round on the buckets that the last one left, until buckets stand for ``length`` bytes."""
    n = len(code)
    padded = np.concatenate((code, np.zeros(FIRST_BUCKET, np.uint8))).astype(np.int64)
    first = sum(padded[i : n + i] << (8 * (FIRST_BUCKET - 1 - i)) for i in range(FIRST_BUCKET))
    rank, depth = dense(first), FIRST_BUCKET
    ends = np.full(n, n, dtype=np.int64)
    while depth < length:
        counts = np.bincount(rank, minlength=n)
        active = np.flatnonzero(counts[rank] > 1)
        if not len(active):
            break
        step = min(depth, length - depth)
        rank, _ = refine(rank, pointed(rank, ends, step), active)
        depth += step
    # only starts count: elsewhere a bucket may reach into the next passage
    starts = rank[_starts(offsets, n_starts)]
    held = np.bincount(starts, minlength=n)
    return np.where(held[starts] > 1, starts, -1)


def _starts(offsets: np.ndarray, n_starts: np.ndarray) -> np.ndarray:
    shift = np.repeat(offsets[:-1] - (np.cumsum(n_starts) - n_starts), n_starts)
    return np.arange(int(n_starts.sum())) + shift


#: Windows that go through the index at a time.
QUERIES = 1 << 18


def index_search(code: np.ndarray, offsets: np.ndarray, n_starts: np.ndarray, length: int) -> np.ndarray:
    """Backward search: the passages stream past the shard's index; a place's matching statistic reaches
    the threshold if the interval of its next ``length`` words holds a second suffix."""
    words, symbols = np.unique(code, return_inverse=True)
    index = FMIndex(symbols + 1, offsets, len(words) + 1)
    starts = _starts(offsets, n_starts)
    out = np.full(len(starts), -1, dtype=np.int64)
    for lo in range(0, len(starts), QUERIES):
        at = starts[lo : lo + QUERIES]
        place = np.arange(lo, lo + len(at))
        low, high = np.zeros(len(at), np.int64), np.full(len(at), index.size, np.int64)
        for back in range(length - 1, -1, -1):
            low, high = index.backward(low, high, symbols[at + back] + 1)
            more = high - low > 1  # its own occurrence alone can't become two
            at, place, low, high = at[more], place[more], low[more], high[more]
        out[place] = low
    return out


def _removed(df: DataFrame, w: Windows, search, name: str, id_col: str, text_col: str, columns: list[str], last, schema) -> DataFrame:
    found, parts = repeats(df, w, search, name, id_col, text_col)

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, batch in told(batches, REPEATS, ("doc", "t", "s", "e")):
            body = batch.column(batch.num_columns - 1)
            doc, t = (body.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield last(body.field(2), lambda i, n: covered_of(held, doc[i], t[i], n, w.length))

    return with_repeats(df, found, parts, id_col, text_col, columns).mapInArrow(rows, schema)


def _digest(id_col: str, texts_at: int, one) -> pa.RecordBatch:
    def last(row: pa.StructArray, cover) -> pa.RecordBatch:
        out = []
        for r, data, offsets in text_chunks(row.field(texts_at), CHUNK):
            out += one(r, data, offsets, cover)
        return pa.RecordBatch.from_arrays([row.field(0), *(pa.array(x) for x in zip(*out))], names=[id_col, *one.names])

    return last


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", w: Windows = BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of df."""

    def one(r, data, offsets, cover):
        for i in range(len(offsets) - 1):
            part = data[offsets[i] : offsets[i + 1]]
            gone = cover(r + i, len(part))
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[:1].sum()))
            yield len(part), int(gone.sum()), spans, hashlib.sha256(part[~gone].tobytes()).hexdigest()

    one.names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _removed(df, w, bucket_search, "bytes", id_col, text_col, [id_col, text_col], _digest(id_col, 1, one), schema)


def repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", w: Windows = WORDS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for each row of df."""
    from quadrille.llm.arrays import Words

    def one(r, data, offsets, cover):
        words = Words(data, offsets)
        spaced = np.concatenate((data, [np.uint8(0x20)]))
        for i in range(len(offsets) - 1):
            a, b = int(words.first[i]), int(words.first[i + 1])
            gone = cover(r + i, b - a)
            starts, ends = words.starts[a:b][~gone], words.ends[a:b][~gone] + 1
            joined, at = gather(spaced, starts, ends)
            joined[at[1:] - 1] = 0x20
            yield b - a, int(gone.sum()), hashlib.sha256(joined[:-1].tobytes()).hexdigest()

    one.names = ["n_words", "n_removed", "kept_sha256"]
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return _removed(df, w, index_search, "words", id_col, text_col, [id_col, text_col], _digest(id_col, 1, one), schema)


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", w: Windows = WORDS) -> DataFrame:
    """The rows of df without the words that repeated windows cover; what separates other words stays,
    the count of characters follows, and a row goes if the cut leaves it no word."""
    from quadrille.llm.arrays import Words

    at, count_at = df.columns.index(text_col), df.columns.index(count_col) if count_col in df.columns else None
    names = [f.name for f in df.schema]

    def last(row: pa.StructArray, cover) -> pa.RecordBatch:
        texts, counts, keep = [], [], []
        source = row.field(at)
        for r, data, offsets in text_chunks(source, CHUNK):
            words = Words(data, offsets)
            for i in range(len(offsets) - 1):
                a, b = int(words.first[i]), int(words.first[i + 1])
                gone = cover(r + i, b - a)
                if not gone.any():
                    texts.append(source[r + i].as_py())
                    keep.append(True)
                else:
                    begin = np.where(np.arange(b - a) > 0, words.starts[a:b], offsets[i])
                    drop = np.zeros(offsets[i + 1] - offsets[i] + 1, dtype=np.int32)
                    np.add.at(drop, begin[gone] - offsets[i], 1)
                    # a removed word takes what stands up to the next word with it
                    stop = np.append(words.starts[a + 1 : b], offsets[i + 1])
                    np.subtract.at(drop, stop[gone] - offsets[i], 1)
                    part = data[offsets[i] : offsets[i + 1]][np.cumsum(drop[:-1]) == 0]
                    texts.append(part.tobytes().decode())
                    keep.append(not gone.all())
                counts.append(None if texts[-1] is None else len(texts[-1]))
        columns = [row.field(i) for i in range(row.type.num_fields)]
        columns[at] = pa.array(texts, columns[at].type)
        if count_at is not None:
            same = pa.array(counts, columns[count_at].type)
            columns[count_at] = same
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return _removed(df, w, index_search, "words", id_col, text_col, [f"`{c}`" for c in names], last, df.schema)
