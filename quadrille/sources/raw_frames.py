"""The plain frame stream: tag, type, place, index, then each band's step and levels; or prefix-coded bands."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrille.functions.dims import band_arrays
from quadrille.sources.container import FRAMES, LAYERS, TYPES, pack_layer, unpack_band

# fixed values of the format
TAG = bytes((0xDA, 0x5A))
HEAD = struct.Struct("<2sBBII")


def pack_frame(ftype: str, gop_pos: int, frame: int, q: np.ndarray, steps: np.ndarray, coded: bool = False, tag: bytes = TAG) -> bytes:
    out = [HEAD.pack(tag, TYPES[ftype], gop_pos, frame, 0)]
    if ftype == "S":
        return out[0]
    a = band_arrays()
    for bands in LAYERS:
        if coded:
            out.append(pack_layer(q, steps, bands))
            continue
        for b in bands:
            own = q[a["start"][b] : a["start"][b] + a["size"][b]].astype("<i2")
            out.append(struct.pack("<fH", steps[b], len(own)) + own.tobytes())
    return b"".join(out)


def unpack_frames(data: bytes, coded: bool = False, tag: bytes = TAG) -> Iterator[tuple]:
    a, at, names = band_arrays(), 0, {v: k for k, v in TYPES.items()}
    while at < len(data):
        found, kind, gop_pos, frame, _ = HEAD.unpack_from(data, at)
        if found != tag or kind not in names:
            raise ValueError(f"no frame at byte {at}")
        at += HEAD.size
        q, steps = np.zeros(1023, np.int16), np.ones(48)
        if names[kind] == "S":
            q = q[:0]
        else:
            for b in range(48):
                steps[b], n = struct.unpack_from("<fH", data, at)
                at += 6
                where = slice(int(a["start"][b]), int(a["start"][b] + a["size"][b]))
                if coded:
                    q[where] = unpack_band(data[at : at + n], int(a["size"][b]))
                    at += n
                elif n:
                    q[where] = np.frombuffer(data, "<i2", n, at)
                    at += 2 * n
        yield frame, names[kind], gop_pos, q, steps


def to_stream(frames: DataFrame, coded: bool = False) -> DataFrame:
    """(track, payload): the frames of a track one after another."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [pack_frame(f.ftype, f.gop_pos, f.frame, np.asarray(f.q, np.int16), np.asarray(f.steps), coded) for f in rows.sort_values("frame").itertuples()]
        return pd.DataFrame({"track": [key[0]], "payload": [b"".join(parts)]})

    return frames.select("track", "frame", "ftype", "gop_pos", "q", "steps").groupBy("track").applyInPandas(one, "track string, payload binary")


def from_stream(streams: DataFrame, coded: bool = False) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for track, payload in zip(batch["track"], batch["payload"]):
                yield pd.DataFrame([(track, *x[:3], x[3].tolist(), x[4].tolist()) for x in unpack_frames(payload, coded)], columns=["track", "frame", "ftype", "gop_pos", "q", "steps"])

    return streams.select("track", "payload").mapInPandas(rows, FRAMES)
