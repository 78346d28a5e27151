"""The container: header, frame index, one block per layer, checksum; and the prefix code inside.

``pack`` and ``unpack`` work on the frames of one track; ``write_containers`` groups tracks, and the data source
``quadrille`` reads files of a folder, one task per file, only the layers asked for."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadrille.functions.dims import END_OF_BAND, ESCAPE, ESCAPE_BITS, MAX_LEVEL, SAMPLE_RATE, band_arrays, code_table

# fixed values of the format
MAGIC, VERSION = b"DSA1", 1
MODES = {1: "discrete", 2: "gradient"}
HEADER = struct.Struct("<4sBBIIHIIII")
INDEX = struct.Struct("<BBI")
TYPES = {"K": 0, "B": 1, "S": 2}
LAYERS = (range(0, 8), range(8, 24), range(24, 48))
FRAMES = "track string, frame int, ftype string, gop_pos int, q array<smallint>, steps array<double>"
HEADER_FIELDS = "path string, version int, mode string, sample_rate long, n_frames int, bitrate_kbps int, layer0_bytes long, layer1_bytes long, layer2_bytes long, duration_s double, file_bytes long, crc_ok boolean"


def pack_band(q: np.ndarray) -> bytes:
    """Levels as code words, each nonzero one with its sign; then the end mark unless the last level is nonzero."""
    nonzero = np.flatnonzero(q)
    if not len(nonzero):
        return b""
    code, last, bits = code_table(), int(nonzero[-1]), []
    for value in q[: last + 1].tolist():
        size = abs(value)
        bits.append(code[size] if size <= MAX_LEVEL else code[ESCAPE] + format(size, f"0{ESCAPE_BITS}b"))
        if size:
            bits.append("1" if value < 0 else "0")
    if last + 1 < len(q):
        bits.append(code[END_OF_BAND])
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


@lru_cache(maxsize=1)
def _symbols() -> dict[str, int]:
    return {bits: symbol for symbol, bits in code_table().items()}


def unpack_band(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int16)
    if not data:
        return out
    symbols, text, at = _symbols(), format(int.from_bytes(data, "big"), f"0{8 * len(data)}b"), 0

    def take(count: int) -> str:
        nonlocal at
        part = text[at : at + count].ljust(count, "0")
        at += count
        return part

    for i in range(n):
        word = take(1)
        while word not in symbols:
            word += take(1)
        size = symbols[word]
        if size == END_OF_BAND:
            break
        if size == ESCAPE:
            size = int(take(ESCAPE_BITS), 2)
        if size:
            out[i] = -size if take(1) == "1" else size
    return out


def pack_layer(q: np.ndarray, steps: np.ndarray, bands: range) -> bytes:
    a, out = band_arrays(), []
    for b in bands:
        coded = pack_band(q[a["start"][b] : a["start"][b] + a["size"][b]]) if len(q) else b""
        out.append(struct.pack("<fH", steps[b], len(coded)) + coded)
    return b"".join(out)


def unpack_layer(data: bytes, bands: range, q: np.ndarray, steps: np.ndarray) -> None:
    a, at = band_arrays(), 0
    for b in bands:
        steps[b], n = struct.unpack_from("<fH", data, at)
        at += 6
        q[a["start"][b] : a["start"][b] + a["size"][b]] = unpack_band(data[at : at + n], int(a["size"][b]))
        at += n


def pack(frames: pd.DataFrame, kbps: float = 12.0, mode: int = 1, sample_rate: int = SAMPLE_RATE) -> bytes:
    """The file of one track; frames: frame, ftype, gop_pos, q, steps."""
    frames = frames.sort_values("frame")
    index, blocks = [], [[], [], []]
    for f in frames.itertuples():
        index.append(INDEX.pack(TYPES[f.ftype], f.gop_pos, f.frame))
        for block, bands in zip(blocks, LAYERS):
            coded = b"" if f.ftype == "S" else pack_layer(np.asarray(f.q, np.int16), np.asarray(f.steps), bands)
            block.append(struct.pack("<H", len(coded)) + coded)
    parts = [b"".join(index), *(b"".join(b) for b in blocks)]
    ends = np.cumsum([HEADER.size, *map(len, parts)]).tolist()
    body = HEADER.pack(MAGIC, VERSION, mode, sample_rate, len(frames), int(kbps), *ends[1:4], ends[4]) + b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def header(data: bytes) -> dict:
    magic, version, mode, rate, n, kbps, l0, l1, l2, end = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError(f"not a container: it begins with {magic!r}")
    return {"version": version, "mode": MODES.get(mode, f"unknown({mode})"), "sample_rate": rate, "n_frames": n, "bitrate_kbps": kbps, "offsets": (l0, l1, l2, end)}


def crc_ok(data: bytes) -> bool:
    end = header(data)["offsets"][3]
    return zlib.crc32(data[:end]) == struct.unpack_from("<I", data, end)[0]


def unpack(data: bytes, layers: tuple[int, ...] = (0, 1, 2), strict: bool = True) -> Iterator[tuple]:
    """(frame, ftype, gop_pos, q, steps); layers that aren't asked for are not touched and stay zero."""
    if strict and not crc_ok(data):
        raise ValueError("the checksum differs")
    head = header(data)
    names = {v: k for k, v in TYPES.items()}
    places = {layer: head["offsets"][layer] for layer in layers}
    for i in range(head["n_frames"]):
        kind, gop_pos, frame = INDEX.unpack_from(data, HEADER.size + i * INDEX.size)
        q, steps = np.zeros(1023, np.int16), np.ones(48)
        for layer in layers:
            (n,) = struct.unpack_from("<H", data, places[layer])
            if n:
                unpack_layer(data[places[layer] + 2 : places[layer] + 2 + n], LAYERS[layer], q, steps)
            places[layer] += 2 + n
        if names[kind] == "S":
            q = q[:0]
        yield frame, names[kind], gop_pos, q, steps


def to_containers(frames: DataFrame, kbps: float = 12.0, mode: int = 1) -> DataFrame:
    """(track, payload binary): one file for each track."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track": [key[0]], "payload": [pack(rows, kbps, mode)]})

    return frames.select("track", "frame", "ftype", "gop_pos", "q", "steps").groupBy("track").applyInPandas(one, "track string, payload binary")


def from_containers(files: DataFrame, layers: tuple[int, ...] = (0, 1, 2), strict: bool = True) -> DataFrame:
    """(track, payload) -> frames, file by file."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for track, payload in zip(batch["track"], batch["payload"]):
                yield pd.DataFrame([(track, *x[:3], x[3].tolist(), x[4].tolist()) for x in unpack(payload, layers, strict)], columns=["track", "frame", "ftype", "gop_pos", "q", "steps"])

    return files.select("track", "payload").mapInPandas(rows, FRAMES)


def checked(files: DataFrame) -> DataFrame:
    """(track, stored, computed, crc_ok) with SQL functions only."""
    body = F.expr("substring(payload, 1, length(payload) - 4)")
    stored = F.conv(F.expr("concat(hex(substring(payload, length(payload), 1)), hex(substring(payload, length(payload) - 1, 1)), hex(substring(payload, length(payload) - 2, 1)), hex(substring(payload, length(payload) - 3, 1)))"), 16, 10).cast("long")
    return files.select("track", stored.alias("stored"), F.crc32(body).alias("computed"), (stored == F.crc32(body)).alias("crc_ok"))


class ContainerSource(DataSource):
    """spark.read.format("quadrille").option("path", folder or file).option("layers", "0,1")"""

    @classmethod
    def name(cls) -> str:
        return "quadrille"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return ContainerReader(self.options)


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.layers = tuple(int(x) for x in options.get("layers", "0,1,2").split(","))
        self.strict = options.get("strict", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        at = Path(self.path)
        return [InputPartition(str(p)) for p in (sorted(p for p in at.iterdir() if p.is_file() and p.name[0] not in "._") if at.is_dir() else [at])]

    def read(self, partition: InputPartition):
        from pathlib import Path

        at = Path(partition.value)
        for frame, ftype, gop_pos, q, steps in unpack(at.read_bytes(), self.layers, self.strict):
            yield at.stem, frame, ftype, gop_pos, q.tolist(), steps.tolist()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
