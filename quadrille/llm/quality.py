"""Quality rules: repetition inside a document, from its suffix array over words.

A longest-common-prefix interval of depth d is a substring of d words that is found again in the
same text; the union of the intervals' spans is what repetition covers.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; a null id is
passed through; equal rows give equal rows; an empty table gives an empty one. Columns besides the
id and the text are not read, and ``keep_quality`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.arrays import Rolling, Words, byte_symbols, covered, mix, sums, text_chunks
from quadrille.llm.spark_io import frugal
from quadrille.llm.suffixes import longest_shared

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


@dataclass(frozen=True)
class Limits:
    """At most ``covered_percent`` of the words may lie in repeats of ``repeat_words`` or more,
    and no repeat may be longer than ``longest`` words."""

    least_words: int = 10
    window: int = 5
    window_percent: int = 20
    repeat_words: int = 10
    covered_percent: int = 20
    longest: int = 100


def measure(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    parts = [_measure_chunk(data, offsets, limits) for _, data, offsets in text_chunks(texts)]
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, bool if k in ("kept", "base_failed") else np.int64) for k in names}


def _measure_chunk(data: np.ndarray, offsets: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    words = Words(data, offsets)
    n, doc, first = len(words), words.doc, words.first
    in_words = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True

    keys = mix(words.hashes() + mix(doc.astype(np.uint64) + np.uint64(1)))
    depth = longest_shared(keys, first[1:][doc])

    def in_repeats(least: int, whole: bool) -> np.ndarray:
        at = np.flatnonzero(depth >= least)
        return sums(covered(n, at, at + (depth[at] if whole else least)), first)

    longest = np.zeros(len(offsets) - 1, dtype=np.int64)
    np.maximum.at(longest, doc, depth)
    n_words, repeated, spans = words.counts.astype(np.int64), in_repeats(limits.window, False), in_repeats(limits.repeat_words, True)
    base_failed = (n_words < limits.least_words) | (100 * repeated > limits.window_percent * n_words)
    return {
        "n_words": n_words,
        "word_chars": sums(in_words[words.ends] - in_words[words.starts], first),
        "n_symbols": sums(symbol[data], offsets),
        "n_dup_lines": _duplicate_lines(data, offsets, words),
        "n_repeat_words": repeated,
        "base_failed": base_failed,
        "kept": ~base_failed & (100 * spans <= limits.covered_percent * n_words) & (longest <= limits.longest),
        "covered_words": spans,
        "longest_repeat": longest,
    }


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    docs = np.searchsorted(offsets[1:], np.sort(np.concatenate((offsets[:-1], breaks))), side="right")
    # an empty document's only line starts where the next begins; it has no word and never counts
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    with_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, docs = starts[with_word], ends[with_word], docs[with_word]
    keys = mix(Rolling(byte_symbols(data)).of(starts, ends) + mix((docs.astype(np.uint64) << np.uint64(32)) + (ends - starts).astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return np.bincount(docs[again], minlength=len(offsets) - 1).astype(np.int64)


def quality_measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row for each row of df: its id, the measures and the verdict. One scan, no shuffle."""

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], names=[id_col, *found])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {kind}, {MEASURES}")


def keep_quality(df: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of df whose text passes, with all their columns."""
    at = df.columns.index(text_col)

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(batch.column(at), limits)["kept"]))

    return df.mapInArrow(rows, df.schema)
