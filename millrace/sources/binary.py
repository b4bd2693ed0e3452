"""Recordings in binary formats: level-5 containers (S10) and array files (S11), read as ``binaryFile`` rows.

A file is a row with its bytes, from any store that Spark reads, and is decoded within the
task that has it, over views of its buffer: elements that aren't wanted are stepped over, and
compressed ones are inflated piece by piece. A file that can't be decoded is a row with its
error; whoever reads decides whether to leave it out or to raise.
"""

from __future__ import annotations

import ast
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the container format: element types that hold numbers, by code, and codes of the others.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
TEXTS = {1: "latin-1", 2: "latin-1", 4: "utf-16", 16: "utf-8", 17: "utf-16", 18: "utf-32"}
CELL, STRUCT, CHAR, SPARSE = 1, 2, 4, 5
ARRAYS = range(6, 16)
HEADER, COMPLEX = 128, 0x0800
PIECE = 1 << 16
RECORDINGS = "path string, channels map<string, array<double>>, error string"
PAYLOADS = "path string, shape array<int>, values array<double>, error string"


class Plain:
    """Bytes in order, as views of a buffer."""

    def __init__(self, view: memoryview):
        self.view, self.at = view, 0

    def take(self, n: int) -> memoryview:
        if n > len(self.view) - self.at:
            raise EOFError(f"truncated: {n} bytes expected at {self.at}, {len(self.view) - self.at} there")
        self.at += n
        return self.view[self.at - n : self.at]

    skip = take


class Inflated:
    """Bytes in order out of a compressed buffer; no more than is asked for is held."""

    def __init__(self, view: memoryview):
        self.rest, self.engine, self.at, self.ready = view, zlib.decompressobj(), 0, b""

    def _more(self, most: int) -> bytes:
        raw = self.engine.unconsumed_tail or self.rest[:PIECE]
        if not self.engine.unconsumed_tail:
            self.rest = self.rest[len(raw) :]
        out = self.engine.decompress(raw, most)
        if not out and not self.engine.unconsumed_tail and not len(self.rest):
            raise EOFError(f"truncated: a compressed element ends at {self.at}")
        return out

    def take(self, n: int) -> memoryview:
        out = bytearray()
        while len(out) < n:
            out += self._more(n - len(out))
        self.at += n
        return memoryview(out)

    def skip(self, n: int) -> None:
        while n:
            part = len(self._more(min(n, PIECE)))
            self.at += part
            n -= part


class Container:
    """Variables of a level-5 container. ``wanted`` names the channels whose numbers are read."""

    def __init__(self, content: memoryview, wanted: Sequence[str] = ()):
        self.source, self.wanted = Plain(content), set(wanted)
        head = bytes(self.source.take(HEADER))
        if head[126:128] not in (b"IM", b"MI"):
            raise ValueError("no level-5 container")
        self.order = "<" if head[126:128] == b"IM" else ">"
        if struct.unpack(self.order + "H", head[124:126])[0] >> 8 != 1:
            raise ValueError("no level-5 container")

    def tag(self, s) -> tuple[int, int, memoryview | None]:
        """Type, size and, of a small element, the data."""
        word = struct.unpack(self.order + "I", s.take(4))[0]
        if word >> 16:
            return word & 0xFFFF, word >> 16, s.take(4)[: word >> 16]
        return word, struct.unpack(self.order + "I", s.take(4))[0], None

    def element(self, s) -> tuple[int, memoryview]:
        kind, n, data = self.tag(s)
        if data is None:
            data = s.take(n)
            s.skip(-n % 8)
        return kind, data

    def numbers(self, s) -> np.ndarray:
        kind, data = self.element(s)
        if kind not in NUMBERS:
            raise ValueError(f"element type {kind} holds no numbers")
        return np.frombuffer(data, np.dtype(NUMBERS[kind]).newbyteorder(self.order))

    def text(self, s) -> str:
        kind, data = self.element(s)
        if kind not in TEXTS:
            raise ValueError(f"element type {kind} holds no text")
        code = TEXTS[kind]
        return bytes(data).decode(code + ("" if code in ("latin-1", "utf-8") else "-le" if self.order == "<" else "-be"))

    def variables(self) -> Iterator[tuple[str, object]]:
        while self.source.at < len(self.source.view):
            kind, n, _ = self.tag(self.source)
            if kind == COMPRESSED:
                inner = Inflated(self.source.take(n))
                kind, n, _ = self.tag(inner)
                yield self.matrix(inner, n, True) if kind == MATRIX else ("", None)
            elif kind == MATRIX:
                yield self.matrix(self.source, n, True)
            else:
                self.source.skip(n + -n % 8)

    def nested(self, s, full: bool) -> object:
        kind, n, _ = self.tag(s)
        if kind != MATRIX:
            raise ValueError(f"element type {kind} within an array of arrays")
        return self.matrix(s, n, full)[1]

    def matrix(self, s, n: int, full: bool) -> tuple[str, object]:
        """Name and value of an array: numbers, a string, or a list of values or of fields by name; None where nothing is read."""
        if n == 0:
            return "", None
        end = s.at + n
        flags = int(self.numbers(s)[0])
        kind, size = flags & 0xFF, prod(self.numbers(s).tolist())
        name = self.text(s)
        value: object = None
        if kind == STRUCT:
            width = int(self.numbers(s)[0])
            _, names = self.element(s)
            fields = [bytes(names[i : i + width]).split(b"\0")[0].decode("latin-1") for i in range(0, len(names), width)]
            value = [self.fields(s, fields) for _ in range(size)]
        elif kind == CELL:
            value = [self.nested(s, full) for _ in range(size)]
        elif kind == CHAR:
            value = self.text(s)
        elif kind in ARRAYS and full:
            value = self.numbers(s)
            if flags & COMPLEX:
                value = value + 1j * self.numbers(s)
        s.skip(end - s.at)
        return name, value

    def fields(self, s, names: list[str]) -> dict[str, object]:
        """One element of a struct. Where its name is known and isn't wanted, its numbers are stepped over."""
        found: dict[str, object] = {}
        for f in names:
            other = bool(self.wanted) and isinstance(found.get("Name"), str) and found["Name"] not in self.wanted
            found[f] = self.nested(s, not other)
        if self.wanted and isinstance(found.get("Name"), str) and found["Name"] not in self.wanted:
            found.pop("Data", None)
        return found


def channels(content: memoryview, wanted: Sequence[str] = ()) -> dict[str, np.ndarray]:
    """Numbers by channel of a recording: its first variable is a struct whose field Y has a Name and Data a channel."""
    for name, value in Container(content, wanted).variables():
        if name.startswith("__") or not isinstance(value, list) or not value or not isinstance(value[0], dict):
            continue
        rows = value[0].get("Y") or []
        return {r["Name"]: np.asarray(r["Data"]).ravel().astype(float) for r in rows if isinstance(r, dict) and isinstance(r.get("Name"), str) and r.get("Data") is not None}
    raise ValueError("no recording in the container")


def array(content: memoryview) -> np.ndarray:
    """The array of an array file: any number type, byte order and axis order."""
    s = Plain(content)
    if bytes(s.take(6)) != b"\x93NUMPY":
        raise ValueError("no array file")
    major = s.take(2)[0]
    if major not in (1, 2, 3):
        raise ValueError(f"array file of version {major}")
    n = struct.unpack("<H", s.take(2))[0] if major == 1 else struct.unpack("<I", s.take(4))[0]
    head = ast.literal_eval(bytes(s.take(n)).decode("utf-8" if major == 3 else "latin-1"))
    if not isinstance(head, dict) or set(head) != {"descr", "fortran_order", "shape"}:
        raise ValueError("array file without its three entries")
    shape = head["shape"]
    if not isinstance(head["descr"], str) or not re.fullmatch(r"[<>|=]?[biuf]\d+|[<>|=]?\?", head["descr"]):
        raise ValueError(f"array of {head['descr']!r} holds no plain numbers")
    if not isinstance(shape, tuple) or not all(isinstance(k, int) and k >= 0 for k in shape):
        raise ValueError(f"shape {shape!r}")
    kind, size = np.dtype(head["descr"]), prod(shape)
    left = len(s.view) - s.at
    if left != size * kind.itemsize:
        raise ValueError(f"shape {shape} of {kind} needs {size * kind.itemsize} bytes, {left} there")
    return np.frombuffer(s.take(left), kind).reshape(shape, order="F" if head["fortran_order"] else "C")


def _decoded(df: DataFrame, schema: str, decode) -> DataFrame:
    """path and what ``decode`` makes of content, a file at a time; of a file that it refuses, the error."""
    names = [x.split()[0] for x in schema.replace("<string, ", "<string,").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    if not content.is_valid:
                        raise ValueError("no content")
                    values, error = decode(memoryview(content.as_buffer())), None
                except (EOFError, ValueError, TypeError, SyntaxError, IndexError, struct.error, zlib.error, MemoryError) as e:
                    values, error = None, f"{type(e).__name__}: {e}"[:300]
                yield _batch(names, path.as_py(), values, error)

    return df.select("path", "content").mapInArrow(run, schema)


def _batch(names: list[str], path: str, values: tuple | None, error: str | None) -> pa.RecordBatch:
    numbers = pa.list_(pa.float64())
    if names[1] == "channels":
        offsets = [0, len(values)] if values is not None else [0, 0]
        keys, waves = (list(values), list(values.values())) if values else ([], [])
        flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, waves)]), pa.int32()), pa.array(np.concatenate(waves) if waves else np.zeros(0)))
        found = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), flat)
        columns = [found if values is not None else pa.nulls(1, pa.map_(pa.string(), numbers))]
    else:
        columns = [pa.array([values[0] if values else None], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(values[1])], pa.int32()), pa.array(values[1])) if values else pa.nulls(1, numbers)]
    return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), *columns, pa.array([error], pa.string())], names)


def recordings(files: DataFrame, wanted: Sequence[str] = ()) -> DataFrame:
    """path, channels and error of level-5 recordings (path, content); only the ``wanted`` channels are read, or all."""
    return _decoded(files, RECORDINGS, lambda content: channels(content, wanted))


def payloads(files: DataFrame) -> DataFrame:
    """path, shape, values (in row order) and error of array files (path, content)."""

    def decode(content: memoryview) -> tuple[list[int], np.ndarray]:
        a = array(content)
        return list(a.shape), np.ascontiguousarray(a, np.float64).ravel()

    return _decoded(files, PAYLOADS, decode)


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, modificationTime, length and content of the files under root whose name the glob matches; bytes are read only if content is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)


def file_name(path) -> object:
    """The last part of a path."""
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def container(name: str, waves: dict[str, np.ndarray], compress: bool = True, order: str = "<") -> bytes:
    """A recording as a level-5 container: a struct of that name whose field Y has a Name and Data a channel (the sink of S10)."""

    def element(kind: int, data: bytes) -> bytes:
        return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def matrix(kind: int, dims: Sequence[int], title: str, *parts: bytes) -> bytes:
        head = element(6, struct.pack(order + "II", kind, 0)) + element(5, struct.pack(f"{order}{len(dims)}i", *dims)) + element(1, title.encode("latin-1"))
        return element(MATRIX, head + b"".join(parts))

    def structure(title: str, fields: list[str], rows: list[list[bytes]]) -> bytes:
        names = b"".join(f.encode("latin-1").ljust(32, b"\0") for f in fields)
        return matrix(STRUCT, (1, len(rows)), title, struct.pack(order + "Ii", 4 << 16 | 5, 32), element(1, names), *(x for r in rows for x in r))

    def string(value: str) -> bytes:
        return matrix(CHAR, (1, len(value)), "", element(17, value.encode("utf-16-le" if order == "<" else "utf-16-be")))

    def numbers(value: np.ndarray) -> bytes:
        return matrix(6, (1, len(value)), "", element(9, np.asarray(value).astype(order + "f8").tobytes()))

    body = structure(name, ["Y"], [[structure("", ["Name", "Data"], [[string(k), numbers(v)] for k, v in waves.items()])]])
    if compress:
        packed = zlib.compress(body)
        body = struct.pack(order + "II", COMPRESSED, len(packed)) + packed
    return b"level-5 container".ljust(124, b" ") + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI") + body
