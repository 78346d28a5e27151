"""SentencePiece encoding and decoding of whole texts by suffix-array matching.

Texts are cut between two bytes that stand side by side in no piece of the vocabulary, so that no
piece reaches over a cut. The distinct pre-tokens of a chunk are concatenated and indexed by a suffix array; every piece of the vocabulary is binary-searched in it for its range of
occurrences; the occurrences, sorted by position, are the edges over which adjacent symbols are
joined, best score first and leftmost on ties, until no edge joins two neighbours.

For models of kind BPE with byte fallback that leave texts as they are; ids equal those of the public library
and do not depend on which texts share a chunk. Other models are refused.

Defined cases: a null or empty text has no ids; U+2581 stands for a space, as in the library, so it
decodes as one; a null id is passed through; repeated rows give repeated rows; an empty table gives
an empty one; columns besides the id, the text and those kept are not read. ``encode_pieces`` refuses to keep a column
that has the name of one it adds; ``decode_pieces`` puts its text in place of a column of that name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quadrille.llm.arrays import Rolling, byte_symbols, gather, ranges, text_chunks
from quadrille.llm.spark_io import frugal
from quadrille.llm.suffixes import dense, pointed, refine

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
CHUNK = 1 << 20
SPACE, MARK = 0x20, "▁"
#: Pre-tokens of more symbols are joined one by one, off the arrays.
LONG = 48
#: Pre-tokens that a task remembers from its earlier chunks.
REMEMBERED = 400_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


class PieceModel:
    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        proto = pb2.ModelProto()
        proto.ParseFromString(serialized)
        if proto.trainer_spec.model_type != pb2.TrainerSpec.BPE:
            raise ValueError("only models of kind BPE are supported")
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are (identity) are supported")
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes_of, self.byte_id = [], np.full(256, self.unknown, dtype=np.int32)
        ids, texts, scores = [], [], []
        for i, p in enumerate(proto.pieces):
            out = p.piece.replace(MARK, " ").encode()
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                out = bytes([value])
            elif p.type == UNKNOWN:
                out = " ⁇ ".encode()
            elif p.type == CONTROL:
                out = b""
            elif p.type == NORMAL:
                ids.append(i)
                texts.append(out)
                scores.append(p.score)
            else:
                raise ValueError("pieces of this kind are not supported")
            self.bytes_of.append(out)
        self.ids, self.scores = np.array(ids, np.int32), np.array(scores, np.float64)
        self.lengths = np.array([len(t) for t in texts])
        if not texts or min(self.lengths) < 1 or any(b"\0" in t for t in texts):
            raise ValueError("a piece is empty or holds a zero byte")
        self.deepest = -(-int(self.lengths.max()) // 8)
        #: an edge is position * stride + length
        self.stride = max(64, 1 << int(self.lengths.max()).bit_length())
        padded = b"".join(t.ljust(8 * self.deepest, b"\0") for t in texts)
        #: the pieces' bytes, eight to a number, in order of significance
        self.words = np.frombuffer(padded, ">u8").reshape(len(texts), self.deepest).astype(np.uint64)
        #: whether two bytes stand side by side in a piece, or the second continues a character
        self.inside = np.zeros((256, 256), dtype=bool)
        self.inside[:, 0x80:0xC0] = True
        joined = np.frombuffer(b"\0".join(texts), np.uint8)
        self.inside[joined[:-1], joined[1:]] = True
        self.inside[0], self.inside[:, 0] = False, False
        self.byte_data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.byte_offsets = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes_of])))
        self.memory: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @staticmethod
    def load(path: str = DEFAULT_MODEL) -> bytes:
        data = Path(path).read_bytes()
        if len(data) > MAX_MODEL_BYTES:
            raise ValueError("the model is too large to send to every task")
        return data

    # encoding

    def encode(self, texts: pa.Array) -> pa.ListArray:
        values, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for _, data, offsets in text_chunks(texts, CHUNK):
            ids, counts = self._encode_chunk(data, offsets)
            values.append(ids)
            lengths.append(counts)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(values)))

    def _encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = self._normalised(data, offsets)
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_docs, np.int64)
        begin = np.ones(len(data), dtype=bool)
        begin[1:] = ~self.inside[data[:-1], data[1:]]
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        keys = Rolling(byte_symbols(data)).of(starts, ends) ^ (ends - starts).astype(np.uint64)
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        ids, id_offsets = self._known(distinct, data, starts[at], ends[at])
        counts = np.diff(id_offsets)[which]
        out = ids[ranges(id_offsets[:-1][which], counts)]
        first = np.searchsorted(starts, offsets)
        totals = np.concatenate(([0], np.cumsum(counts)))
        return out, totals[first[1:]] - totals[first[:-1]]

    def _normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if (mark := MARK.encode()) in (raw := data.tobytes()):
            texts = [raw[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1], offsets[1:])]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        if self.prefix:
            full = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][full], SPACE)
            offsets = offsets + np.concatenate(([0], np.cumsum(full)))
        return data, offsets

    def _known(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens (keys sorted); those that earlier chunks had are remembered."""
        old_keys, old_ids, old_offsets = self.memory or (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64))
        at = np.minimum(np.searchsorted(old_keys, keys), max(0, len(old_keys) - 1))
        known = old_keys[at] == keys if len(old_keys) else np.zeros(len(keys), dtype=bool)
        new = np.flatnonzero(~known)
        new_ids, new_offsets = self._matched(*gather(data, starts[new], ends[new]))
        all_ids = np.concatenate((old_ids, new_ids))
        lo, hi = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        lo[known], hi[known] = old_offsets[at[known]], old_offsets[at[known] + 1]
        lo[new], hi[new] = new_offsets[:-1] + len(old_ids), new_offsets[1:] + len(old_ids)
        if len(old_keys) + len(new) <= REMEMBERED:
            merged = np.concatenate((old_keys, keys[new]))
            order = np.argsort(merged)
            a = np.concatenate((old_offsets[:-1], lo[new]))[order]
            b = np.concatenate((old_offsets[1:], hi[new]))[order]
            self.memory = merged[order], all_ids[ranges(a, b - a)], np.concatenate(([0], np.cumsum(b - a)))
        return all_ids[ranges(lo, hi - lo)], np.concatenate(([0], np.cumsum(hi - lo)))

    def _edges(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of pieces: sorted keys position * stride + length, and the piece of each."""
        n = len(text)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
        place, eight = np.arange(n), np.zeros(n, dtype=np.uint64)
        for i in range(8):
            eight = (eight << np.uint64(8)) | np.where(place + i < ends, padded[i : n + i], np.uint64(0))
        suffixes = np.argsort(self._ranked(eight, place, ends), kind="stable")
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        for level in range(self.deepest):
            more = np.flatnonzero((self.lengths > 8 * level) & (low < high))
            if not len(more):
                break
            at = suffixes + 8 * level
            column = np.where(at < ends[suffixes], eight[np.minimum(at, n - 1)], np.uint64(0))
            want = self.words[more, level]
            free = np.clip(8 * (level + 1) - self.lengths[more], 0, 7).astype(np.uint64)
            top = want | ((np.uint64(1) << (np.uint64(8) * free)) - np.uint64(1))
            if level == 0:
                low[more], high[more] = np.searchsorted(column, want), np.searchsorted(column, top, side="right")
            else:
                low[more], high[more] = _bisect(column, low[more], high[more], want, True), _bisect(column, low[more], high[more], top, False)
        found = high - low
        position = suffixes[ranges(low, found)]
        piece = np.repeat(np.arange(len(self.ids)), found)
        keys = position * self.stride + self.lengths[piece]
        order = np.argsort(keys)
        return keys[order], piece[order]

    def _ranked(self, eight: np.ndarray, place: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Buckets of suffixes by as many bytes as the longest piece has, from their first eight."""
        rank, depth = dense(eight), 8
        while depth < 8 * self.deepest:
            # a bucket is refined as a whole, with its suffixes that have ended, as long as one goes on
            held, goes_on = np.bincount(rank, minlength=len(rank)), np.zeros(len(rank), dtype=bool)
            goes_on[rank[place + depth < ends]] = True
            active = np.flatnonzero((held[rank] > 1) & goes_on[rank])
            if not len(active):
                break
            rank, _ = refine(rank, pointed(rank, ends, depth), active)
            depth *= 2
        return rank

    def _matched(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pre-token, concatenated, and their offsets."""
        n_tokens = len(offsets) - 1
        if not n_tokens:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        keys, pieces = self._edges(text, offsets)

        def piece_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            length = end - start
            want = start * self.stride + length
            at = np.searchsorted(keys, want)
            at[at == len(keys)] = 0
            return np.where((length < self.stride) & (keys[at] == want), pieces[at], -1) if len(keys) else np.full(len(start), -1)

        scores = np.append(self.scores, -np.inf)
        start = np.flatnonzero((text & 0xC0) != 0x80)
        end = np.append(start[1:], len(text))
        token = np.searchsorted(offsets, start, side="right") - 1
        size = np.bincount(token, minlength=n_tokens)
        done = []
        for t in np.flatnonzero(size > LONG):
            own = slice(int(np.searchsorted(token, t)), int(np.searchsorted(token, t, side="right")))
            a, b = self._joined_one(start[own], end[own], lambda s, e: int(piece_of(np.array([s]), np.array([e]))[0]))
            done.append((a, b, np.full(len(a), t)))
        held = size[token] <= LONG
        start, end, token = start[held], end[held], token[held]
        join = np.full(len(start), -np.inf)
        same = np.flatnonzero(token[1:] == token[:-1])
        join[same] = scores[piece_of(start[same], end[same + 1])]
        while len(start):
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            best = np.maximum.reduceat(join, first)
            row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(start))))
            finished = best[row] == -np.inf
            if finished.any():
                done.append((start[finished], end[finished], token[finished]))
                start, end, token, join, row = (x[~finished] for x in (start, end, token, join, row))
                if not len(start):
                    break
            top = np.flatnonzero(join == best[row])
            top = top[np.append(True, row[top][1:] != row[top][:-1])]  # the leftmost of each
            end[top] = end[top + 1]
            stay = np.ones(len(start), dtype=bool)
            stay[top + 1] = False
            moved = np.cumsum(stay) - 1
            start, end, token, join = start[stay], end[stay], token[stay], join[stay]
            changed = moved[top]
            changed = np.unique(np.concatenate((changed, changed[changed > 0] - 1)))
            nxt = np.minimum(changed + 1, len(start) - 1)
            inside = (nxt > changed) & (token[nxt] == token[changed])
            join[changed] = -np.inf
            join[changed[inside]] = scores[piece_of(start[changed[inside]], end[nxt[inside]])]
        start, end, token = (np.concatenate([d[i] for d in done]) for i in range(3))
        order = np.argsort(start)
        start, end, token = start[order], end[order], token[order]
        piece = piece_of(start, end)
        width = np.where(piece >= 0, 1, end - start)
        owner = np.repeat(np.arange(len(start)), width)
        byte = text[start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)]
        ids = np.where(piece[owner] >= 0, self.ids[piece[owner]], self.byte_id[byte]).astype(np.int32)
        return ids, np.concatenate(([0], np.cumsum(np.bincount(token, width, n_tokens).astype(np.int64))))

    def _joined_one(self, start: np.ndarray, end: np.ndarray, piece_of) -> tuple[np.ndarray, np.ndarray]:
        start, end = start.tolist(), end.tolist()
        n = len(start)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and end[j] - start[i] < self.stride and (p := piece_of(start[i], end[j])) >= 0:
                heapq.heappush(heap, (-self.scores[p], i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        keep = [i for i in range(n) if alive[i]]
        return np.array([start[i] for i in keep]), np.array([end[i] for i in keep])

    # decoding

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts, without the space that encoding puts in front."""
        values = ids.flatten().to_numpy(zero_copy_only=False)
        counts = np.nan_to_num(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        out = []
        first = np.concatenate(([0], np.cumsum(counts)))
        step = 1 << 18  # ids at a time
        row = 0
        while row < len(counts):
            stop = max(row + 1, int(np.searchsorted(first, first[row] + step, side="right")) - 1)
            part = values[first[row] : first[stop]]
            data, offsets = gather(self.byte_data, self.byte_offsets[part], self.byte_offsets[part + 1])
            raw, at = data.tobytes(), offsets[first[row : stop + 1] - first[row]]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                a += int(self.prefix and b > a and raw[a] == SPACE)
                out.append(raw[a:b].decode(errors="replace"))
            row = stop
        return pa.array(out, pa.string())


def _bisect(column: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, left: bool) -> np.ndarray:
    """Per query, the place of want in the sorted stretch column[low:high]."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        value = column[np.minimum(mid, len(column) - 1)]
        right = open_ & (value < want if left else value <= want)
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, n_tokens, token_ids, round_trip): round_trip tells that the ids decode to the text."""
    carried = (id_col, *keep)
    if {"n_tokens", "token_ids", "round_trip"} & set(carried):
        raise ValueError("a kept column has the name of one that is added")
    shared = df.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(shared.value)
        for batch in batches:
            texts = batch.column(len(carried)).fill_null("")
            ids = model.encode(texts)
            back = model.decode(ids)
            same = [a == b for a, b in zip(back.to_pylist(), texts.to_pylist())]
            columns = [batch.column(i) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*columns, ids.value_lengths().cast(pa.int64()), ids, pa.array(same, pa.bool_())], names=[*carried, "n_tokens", "token_ids", "round_trip"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)
    return df.select(*(f"`{c}`" for c in (*carried, text_col))).mapInArrow(rows, f"{fields}, n_tokens long, token_ids array<int>, round_trip boolean")


def decode_pieces(df: DataFrame, ids_col: str = "token_ids", out_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """df with the text of its ids as last column; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))
    kept = [f.name for f in df.schema if f.name != out_col]

    @frugal
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(shared.value)
        for batch in batches:
            texts = model.decode(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*kept, out_col])

    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{out_col}` string"])
    return df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids_col}`").alias("the ids")).mapInArrow(rows, fields)
