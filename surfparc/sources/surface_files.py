"""Binary surface formats, parsed file by file inside tasks.

Spark lists and reads the files (one row each); a small parser turns a file's
bytes into rows. A run of time points is one file, so files are the unit of work.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The data contract a time-series file has to meet.
CONTRACT = {"DataType": "NIFTI_TYPE_FLOAT32", "Encoding": "GZipBase64Binary", "Endian": "LittleEndian"}
DTYPES = {"NIFTI_TYPE_FLOAT32": "<f4", "NIFTI_TYPE_INT32": "<i4", "NIFTI_TYPE_UINT8": "u1"}
TRIANGLE_MAGIC = b"\xff\xff\xfe"
ARRAY = re.compile(rb"<DataArray\b([^>]*)>(.*?)</DataArray>", re.S)
PAYLOAD = re.compile(rb"<Data>(.*?)</Data>", re.S)
ATTRIBUTE = re.compile(rb'(\w+)\s*=\s*"([^"]*)"')


def _arrays(data: bytes, path: str):
    """Attributes and decoded payload of every data array of a file, in order."""
    if data.count(b"<DataArray") != len(ARRAY.findall(data)) or b"<DataArray" not in data:
        raise ValueError(f"{path}: missing or unterminated DataArray")
    for i, hit in enumerate(ARRAY.finditer(data)):
        attrs = {k.decode(): v.decode() for k, v in ATTRIBUTE.findall(hit.group(1))}
        body = PAYLOAD.search(hit.group(2))
        if body is None:
            raise ValueError(f"{path}: data array {i} has no Data element")
        yield i, attrs, body.group(1)


def _values(attrs: dict, payload: bytes, path: str, i: int) -> np.ndarray:
    if attrs.get("Encoding") != CONTRACT["Encoding"] or attrs.get("Endian") != CONTRACT["Endian"] or attrs.get("DataType") not in DTYPES:
        raise ValueError(f"{path}: data array {i} has an unsupported encoding")
    raw = zlib.decompress(base64.b64decode(payload.strip(), validate=True))
    return np.frombuffer(raw, dtype=DTYPES[attrs["DataType"]])


def parse_series(data: bytes, path: str) -> np.ndarray:
    """``(vertices, time)`` of a time-series file; every array meets one contract and length."""
    columns, n = [], None
    for i, attrs, payload in _arrays(data, path):
        for key, want in CONTRACT.items():
            if attrs.get(key) != want:
                raise ValueError(f"{path}: data array {i} has {key}={attrs.get(key)!r}, needs {want!r}")
        n = n or attrs.get("Dim0")
        col = _values(attrs, payload, path, i)
        if attrs.get("Dim0") != n or n is None or len(col) != int(n):
            raise ValueError(f"{path}: data array {i} differs in length from the first")
        columns.append(col)
    return np.stack(columns, axis=1)


def parse_mesh(data: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and zero-based faces of a ``.surf.gii`` or a binary triangle file."""
    name = path.lower()
    if name.endswith(".surf.gii"):
        parts = {a.get("Intent"): _values(a, p, path, i) for i, a, p in _arrays(data, path)}
        return parts["NIFTI_INTENT_POINTSET"].reshape(-1, 3), parts["NIFTI_INTENT_TRIANGLE"].reshape(-1, 3)
    if name.endswith(".gii"):
        raise ValueError(f"{path}: not a surface mesh; only .surf.gii holds geometry")
    if data[:3] != TRIANGLE_MAGIC:
        raise ValueError(f"{path}: not a triangle surface file")
    at = data.index(b"\n\n", 3) + 2
    n_vertices, n_faces = struct.unpack_from(">2i", data, at)
    points = np.frombuffer(data, ">f4", 3 * n_vertices, at + 8).reshape(-1, 3)
    faces = np.frombuffer(data, ">i4", 3 * n_faces, at + 8 + 12 * n_vertices).reshape(-1, 3)
    return points.astype(float), faces.astype(int)


def parse_annotation(data: bytes, path: str) -> np.ndarray:
    """Colour-table index per vertex, -1 where the annotation value is zero."""
    read = lambda fmt, at: struct.unpack_from(">" + fmt, data, at)
    n = read("i", 0)[0]
    pairs = np.frombuffer(data, ">i4", 2 * n, 4).reshape(-1, 2)
    at = 4 + 8 * n
    if not np.array_equal(np.sort(pairs[:, 0]), np.arange(n)):
        raise ValueError(f"{path}: vertices are missing, repeated or out of range")
    if at + 4 > len(data) or read("i", at)[0] != 1:
        raise ValueError(f"{path}: no colour table")
    version = read("i", at + 4)[0]
    if version != -2:
        raise ValueError(f"{path}: colour-table version {-version} is not supported")
    size, name_length = read("2i", at + 8)
    at += 16 + name_length
    entries = read("i", at)[0]
    at += 4
    codes: dict[int, int] = {}
    for _ in range(entries):
        index, length = read("2i", at)
        red, green, blue, _alpha = read("4i", at + 8 + length)
        at += 24 + length
        if not 0 <= index < size:
            raise ValueError(f"{path}: colour-table entry {index} is out of range")
        codes.setdefault(red + 256 * green + 65536 * blue, index)
    values = np.empty(n, dtype=np.int64)
    values[pairs[:, 0]] = pairs[:, 1]
    unknown = set(np.unique(values)) - set(codes) - {0}
    if unknown:
        raise ValueError(f"{path}: annotation value {min(unknown)} is not in the colour table")
    return np.array([codes[v] if v else -1 for v in values], dtype=np.int32)


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_series(spark: SparkSession, path: str | list[str], expected: int | None = None) -> DataFrame:
    """``path, v, ts`` for every surface time-series file under ``path``."""

    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                if not name.lower().endswith(".func.gii"):
                    raise ValueError(f"{name}: only .func.gii time series are supported")
                x = parse_series(content, name)
                if expected is not None and len(x) != expected:
                    raise ValueError(f"{name}: {len(x)} vertices, expected {expected}")
                yield pd.DataFrame({"path": name, "v": np.arange(len(x)), "ts": list(x)})

    return _files(spark, path).mapInPandas(parse, "path string, v long, ts array<float>")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertex and face tables of every mesh file under ``path``."""

    def points(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                p, _ = parse_mesh(content, name)
                yield pd.DataFrame({"path": name, "v": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    def triangles(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                _, f = parse_mesh(content, name)
                yield pd.DataFrame({"path": name, "f": np.arange(len(f)), "v0": f[:, 0], "v1": f[:, 1], "v2": f[:, 2]})

    files = _files(spark, path)
    return (
        files.mapInPandas(points, "path string, v long, x double, y double, z double"),
        files.mapInPandas(triangles, "path string, f long, v0 long, v1 long, v2 long"),
    )


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """``path, v, label`` for every annotation file under ``path``."""

    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                labels = parse_annotation(content, name)
                yield pd.DataFrame({"path": name, "v": np.arange(len(labels)), "label": labels})

    return _files(spark, path).mapInPandas(parse, "path string, v long, label int")


def group_labels(annotation: DataFrame) -> DataFrame:
    """Unlabelled vertices (-1) become 0."""
    return annotation.withColumn("label", F.greatest("label", F.lit(0)))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``path, v, x`` from two-dimensional ``.npy`` files, one row per first index."""

    def parse(batches):
        import io

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False))
                yield pd.DataFrame({"path": name, "v": np.arange(len(x)), "x": list(x.astype(float))})

    return _files(spark, path).mapInPandas(parse, "path string, v long, x array<double>")
