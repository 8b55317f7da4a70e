"""Selective scan of version 5 matrix files: only the wanted variable is inflated."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Element types of the container and their array types.
MI = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MI_MATRIX, MI_COMPRESSED, MX_SPARSE = 14, 15, 5


def _element(data: bytes, at: int) -> tuple[int, bytes, int]:
    """Type, payload and next offset of one element; small ones pack into their tag."""
    kind, size = struct.unpack_from("<2I", data, at)
    if kind >> 16:
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    padded = size if kind == MI_COMPRESSED else (size + 7) // 8 * 8
    return kind, data[at + 8 : at + 8 + size], at + 8 + padded


def _numbers(data: bytes, at: int) -> tuple[np.ndarray, int]:
    kind, payload, nxt = _element(data, at)
    return np.frombuffer(payload, "<" + MI[kind]), nxt


def _header(body: bytes) -> tuple[str, int, np.ndarray, int]:
    flags, at = _numbers(body, 0)
    dims, at = _numbers(body, at)
    _, name, at = _element(body, at)
    return name.decode(), int(flags[0]) & 0xFF, dims, at


def variables(data: bytes):
    """Name and a thunk reading the variable, without inflating what is not asked for."""
    at = 128
    while at < len(data):
        kind, payload, at = _element(data, at)
        if kind == MI_COMPRESSED:
            head = zlib.decompressobj().decompress(payload, 512)
            yield _header(head[8:])[0], lambda p=payload: _read(zlib.decompress(p)[8:])
        elif kind == MI_MATRIX:
            yield _header(payload)[0], lambda p=payload: _read(p)


def _read(body: bytes):
    """Triples ``(row, column, value)`` of one matrix, dense zeros left out."""
    _, cls, dims, at = _header(body)
    if cls == MX_SPARSE:
        rows, at = _numbers(body, at)
        starts, at = _numbers(body, at)
        values, _ = _numbers(body, at)
        n = int(starts[-1])
        return rows[:n].astype(int), np.repeat(np.arange(len(starts) - 1), np.diff(starts)), values[:n].astype(float)
    values, _ = _numbers(body, at)
    full = values.reshape(dims, order="F").reshape(int(dims[0]), -1)
    r, c = np.nonzero(full)
    return r, c, full[r, c].astype(float)


def read_matrix(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``path, row, col, value`` of the non-zero entries of variable ``name``."""

    def parse(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                hit = next((read for n, read in variables(content) if n == name), None)
                if hit is None:
                    raise ValueError(f"{file}: no variable {name!r}")
                r, c, v = hit()
                yield pd.DataFrame({"path": file, "row": r, "col": c, "value": v})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row long, col long, value double")
