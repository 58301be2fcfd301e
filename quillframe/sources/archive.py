"""A binary tensor archive: header, directory of fixed records, blobs aligned to 64 bytes; written by tasks, read as a data source.

Layout: magic, u32 tensors, u32 name bytes; then for each tensor u8 kind, u8 dimensions, u16 bits * 100, u32 shape[4],
u64 offset, u64 bytes, u32 group, u32 name length; then the names; then the blobs. Kinds: 1 half, 2 single, 3 quantized (packed
codes, then half-precision norms), 4 raw bytes. A reader needs the header and directory alone to plan: one partition a tensor.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillframe.operators import quantization as q

MAGIC, ALIGN = b"QFTA\x01\0\0\0", 64
RECORD = struct.Struct("<BBHIIIIQQII")
HALF, SINGLE, CODED, RAW = 1, 2, 3, 4
SCHEMA = "file string, ordinal int, name string, kind int, shape array<int>, bits double, grouping int, start bigint, bytes bigint, values array<float>, blob binary"


def encode(value: np.ndarray | bytes, bits: float | None, group: int) -> tuple[int, tuple[int, ...], float, int, bytes]:
    """(kind, shape, bits, group, blob) of a tensor; matrices with a width are quantized, other arrays halved."""
    if isinstance(value, bytes):
        return RAW, (), 0.0, 0, value
    if bits and value.ndim == 2:
        packed, norms = q.quantize(value, bits, group)
        return CODED, value.shape, bits, group, packed.tobytes() + norms.tobytes()
    return HALF, value.shape, 0.0, 0, value.astype(np.float16).tobytes()


def build(tensors: list[tuple[str, np.ndarray | bytes]], bits: dict[str, float] | None = None, default: float = 4, group: int = 128) -> bytes:
    """The archive's bytes; widths by longest prefix of the name."""
    rules = bits or {}

    def width(name: str) -> float:
        fits = [k for k in rules if name.startswith(k)]
        return rules[max(fits, key=len)] if fits else default

    coded = [encode(x, width(n), group) for n, x in tensors]
    names = [n.encode() for n, _ in tensors]
    at = len(MAGIC) + 8 + RECORD.size * len(tensors) + sum(map(len, names))
    directory, blobs = [], []
    for (kind, shape, b, g, blob), name in zip(coded, names):
        start = -(-at // ALIGN) * ALIGN
        blobs.append((start - at, blob))
        directory.append(RECORD.pack(kind, len(shape), round(b * 100), *(*shape, 0, 0, 0, 0)[:4], start, len(blob), g, len(name)))
        at = start + len(blob)
    head = MAGIC + struct.pack("<II", len(tensors), sum(map(len, names)))
    return head + b"".join(directory) + b"".join(names) + b"".join(b"\0" * gap + blob for gap, blob in blobs)


def directory(stream, file: str) -> list[tuple]:
    """(file, ordinal, name, kind, shape, bits, group, start, bytes) of each tensor."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError(f"{file} is no archive")
    count, names = struct.unpack("<II", stream.read(8))
    records = [RECORD.unpack(stream.read(RECORD.size)) for _ in range(count)]
    text, out, at = stream.read(names), [], 0
    for i, (kind, dims, bits, a, b, c, d, start, size, group, length) in enumerate(records):
        out.append((file, i, text[at : at + length].decode(), kind, [a, b, c, d][:dims], bits / 100, group, start, size))
        at += length
    return out


def decode(kind: int, shape: list[int], bits: float, group: int, blob: bytes) -> np.ndarray | None:
    """The tensor as single precision, None for raw bytes."""
    if kind == RAW:
        return None
    if kind == CODED:
        rows, width = shape
        padded = -(-width // group) * group
        packed = rows * padded * (2 if bits == q.TERNARY else int(bits)) // 8
        codes = np.frombuffer(blob[:packed], np.uint8).reshape(rows, -1)
        norms = np.frombuffer(blob[packed:], np.float16).reshape(rows, -1)
        return q.dequantize(codes, norms, width, bits, group).astype(np.float32)
    return np.frombuffer(blob, np.float16 if kind == HALF else np.float32).reshape(shape).astype(np.float32)


class _Part(InputPartition):
    def __init__(self, record: tuple) -> None:
        super().__init__(record)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        out = []
        for file in self.paths:
            store, path = fs.FileSystem.from_uri(file)
            with store.open_input_file(path) as stream:
                out += [_Part(r) for r in directory(stream, file)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file, ordinal, name, kind, shape, bits, group, start, size = partition.value
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as stream:
            stream.seek(start)
            blob = stream.read(size)
        value = decode(kind, shape, bits, group, blob)
        yield (file, ordinal, name, kind, shape, bits, group, start, size, None if value is None else value.reshape(-1).tolist(), blob if kind == RAW else None)


class ArchiveSource(DataSource):
    """``spark.read.format("tensor_archive").load(uri)``; several files are given as uris joined by commas."""

    @classmethod
    def name(cls) -> str:
        return "tensor_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].split(","))


def read(spark: SparkSession, uri: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tensor_archive").load(uri)


def write(tensors: list[tuple[str, np.ndarray | bytes]], uri: str, **how) -> int:
    """Write one archive; gives its size. A model's tensors fit the memory of who writes them."""
    data = build(tensors, **how)
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as out:
        out.write(data)
    return len(data)
