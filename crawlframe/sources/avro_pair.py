"""Avro object container files of key and value pairs, for interchange: a Python data source that reads and writes.

    spark.dataSource.register(AvroPairSource)
    df.write.format("avro_pair").mode("append").save(path)
    spark.read.format("avro_pair").schema("url string, size long").load(path)

Scalars, byte strings, arrays, text-keyed maps and records are covered; each nullable field is a union with null. Blocks
are cut at about 64 KB, so readers can start at any of their marks; a file is read by one task for each range.
Files are opened where the task runs, by Arrow's file systems: plain paths and ``file:`` are folders that all executors must see,
other schemes (``hdfs``, ``s3``, ``gs``, …) go to their stores.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC = b"Obj\x01"
BLOCK = 64 << 10
SPLIT = 64 << 20

_NAMES = {T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes", T.BooleanType: "boolean"}


def avro_type(kind: T.DataType, name: str = "Record"):
    """Avro schema of a Spark type."""
    if type(kind) in _NAMES:
        return _NAMES[type(kind)]
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", avro_type(kind.elementType, f"{name}_item")]}
    if isinstance(kind, T.MapType):
        return {"type": "map", "values": ["null", avro_type(kind.valueType, f"{name}_value")]}
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", avro_type(f.dataType, f"{name}_{f.name}")]} for f in kind.fields]}
    raise TypeError(f"no Avro type for {kind}")


def put_long(out: io.BytesIO, n: int) -> None:
    n = (n << 1) ^ (n >> 63)
    while n & ~0x7F:
        out.write(bytes([n & 0x7F | 0x80]))
        n >>= 7
    out.write(bytes([n]))


def get_long(data: io.BufferedIOBase) -> int:
    shift = value = 0
    while True:
        b = data.read(1)
        if not b:
            raise EOFError
        value |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7


def _put_bytes(out, data: bytes) -> None:
    put_long(out, len(data))
    out.write(data)


def encode(out: io.BytesIO, schema, value) -> None:
    """Write a value of an Avro schema."""
    if isinstance(schema, list):
        at = schema.index("null") if value is None else next(i for i, s in enumerate(schema) if s != "null")
        put_long(out, at)
        return None if value is None else encode(out, schema[at], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind in ("int", "long"):
        put_long(out, int(value))
    elif kind == "string":
        _put_bytes(out, value.encode())
    elif kind == "bytes":
        _put_bytes(out, bytes(value))
    elif kind == "boolean":
        out.write(b"\x01" if value else b"\x00")
    elif kind == "float":
        out.write(struct.pack("<f", value))
    elif kind == "double":
        out.write(struct.pack("<d", value))
    elif kind == "record":
        for f in schema["fields"]:
            encode(out, f["type"], value[f["name"]])
    elif kind in ("array", "map"):
        items = list(value.items()) if kind == "map" else list(value)
        if items:
            put_long(out, len(items))
            for x in items:
                if kind == "map":
                    _put_bytes(out, x[0].encode())
                encode(out, schema["values"] if kind == "map" else schema["items"], x[1] if kind == "map" else x)
        put_long(out, 0)
    elif kind == "fixed":
        out.write(bytes(value))
    elif kind != "null":
        raise TypeError(f"can't write {kind}")


def decode(data, schema):
    """Read a value of an Avro schema."""
    if isinstance(schema, list):
        return decode(data, schema[get_long(data)])
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "null":
        return None
    if kind in ("int", "long"):
        return get_long(data)
    if kind == "string":
        return data.read(get_long(data)).decode()
    if kind == "bytes":
        return data.read(get_long(data))
    if kind == "boolean":
        return data.read(1) == b"\x01"
    if kind == "float":
        return struct.unpack("<f", data.read(4))[0]
    if kind == "double":
        return struct.unpack("<d", data.read(8))[0]
    if kind == "fixed":
        return data.read(schema["size"])
    if kind == "enum":
        return schema["symbols"][get_long(data)]
    if kind == "record":
        return {f["name"]: decode(data, f["type"]) for f in schema["fields"]}
    if kind in ("array", "map"):
        out = {} if kind == "map" else []
        while n := get_long(data):
            if n < 0:
                n = -n
                get_long(data)
            for _ in range(n):
                if kind == "map":
                    key = data.read(get_long(data)).decode()
                    out[key] = decode(data, schema["values"])
                else:
                    out.append(decode(data, schema["items"]))
        return out
    if isinstance(kind, (dict, list)):
        return decode(data, kind)
    raise TypeError(f"can't read {kind}")


def header(schema, mark: bytes, codec: str) -> bytes:
    out = io.BytesIO()
    out.write(MAGIC)
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    put_long(out, len(meta))
    for k, v in meta.items():
        _put_bytes(out, k.encode())
        _put_bytes(out, v)
    put_long(out, 0)
    out.write(mark)
    return out.getvalue()


def read_header(f) -> tuple[dict, str, bytes]:
    """(schema, codec, mark) of a container file."""
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = decode(f, {"type": "map", "values": "bytes"})
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path, and the path in it."""
    parts = urlsplit(path)
    if parts.scheme == "file":
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(path) if parts.scheme and "://" in path else (fs.LocalFileSystem(), path)


def _reading(path: str):
    store, name = place(path)
    return io.BufferedReader(store.open_input_file(name), 1 << 20)


def write_file(path: str, schema, rows, codec: str = "deflate", level: int = 1) -> int:
    """Write records (dictionaries) to a container file; returns how many."""
    mark, total = os.urandom(16), 0
    store, name = place(path)
    with store.open_output_stream(name) as f:
        f.write(header(schema, mark, codec))
        block, n = io.BytesIO(), 0

        def flush():
            data = block.getvalue()
            if codec == "deflate":
                machine = zlib.compressobj(level, zlib.DEFLATED, -15)
                data = machine.compress(data) + machine.flush()
            out = io.BytesIO()
            put_long(out, n)
            _put_bytes(out, data)
            f.write(out.getvalue() + mark)

        for row in rows:
            encode(block, schema, row)
            n, total = n + 1, total + 1
            if block.tell() >= BLOCK:
                flush()
                block, n = io.BytesIO(), 0
        if n:
            flush()
    return total


def read_range(path: str, begin: int = 0, end: int | None = None):
    """Records of the blocks that begin behind a mark in [begin, end)."""
    with _reading(path) as f:
        schema, codec, mark = read_header(f)
        first, size = f.tell(), f.seek(0, io.SEEK_END)
        f.seek(first)
        end = size if end is None else end
        if begin > first:
            f.seek(begin - 16)
            if not _seek_mark(f, mark):
                return
        while f.tell() < size and (f.tell() < end or f.tell() == first and begin <= first):
            n, data = get_long(f), f.read(get_long(f))
            if codec == "deflate":
                data = zlib.decompress(data, -15)
            elif codec != "null":
                raise ValueError(f"unknown codec {codec}")
            if f.read(16) != mark:
                raise ValueError(f"{path}: a block doesn't end with the file's mark")
            block = io.BytesIO(data)
            for _ in range(n):
                yield decode(block, schema)


def _seek_mark(f, mark: bytes) -> bool:
    """Go behind the next mark."""
    tail, base = b"", f.tell()
    while chunk := f.read(1 << 16):
        found = (tail + chunk).find(mark)
        if found != -1:
            f.seek(base - len(tail) + found + 16)
            return True
        base += len(chunk)
        tail = (tail + chunk)[-15:]
    return False


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of the container files of a folder, sorted; a folder of a sorted map is read by its data file, a file stands for itself."""
    store, root = place(path)
    if store.get_file_info(root).type == fs.FileType.File:
        return [(path, store.get_file_info(root).size)]
    found = []
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        folders = f.path.rstrip("/").removeprefix(root.rstrip("/")).strip("/").split("/")
        plain = len(folders) == 1 and f.extension == "avro" and not f.base_name.startswith(".") and f.base_name != "index.avro"
        if f.type == fs.FileType.File and (plain or (len(folders) == 2 and f.base_name == "data.avro")):
            found.append(("/".join([path.rstrip("/"), *folders]), f.size))
    return sorted(found)


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str):
        self.schema, self.path = schema, path

    def partitions(self):
        return [_Range(f, at, min(at + SPLIT, size)) for f, size in files_of(self.path) for at in range(0, max(size, 1), SPLIT)]

    def read(self, part: _Range):
        for row in read_range(part.path, part.begin, part.end):
            flat = {**row, **_fields("key", row), **_fields("value", row)}
            yield tuple(flat.get(f.name) for f in self.schema.fields)


def _fields(name: str, row: dict) -> dict:
    inner = row.get(name)
    return inner if isinstance(inner, dict) else {}


class _Writer(DataSourceWriter):
    def __init__(self, schema: T.StructType, path: str, overwrite: bool, codec: str):
        self.schema, self.path, self.codec = schema, path, codec
        self.before = [f for f, _ in files_of(path) if f.rpartition("/")[2].startswith("part-")] if overwrite else []

    def write(self, rows):
        store, root = place(self.path)
        store.create_dir(root, recursive=True)
        name = f"{self.path.rstrip('/')}/.part-{uuid.uuid4().hex}.avro"
        return _Written(name, write_file(name, avro_type(self.schema, "Pair"), (r.asDict(True) for r in rows), self.codec))

    def commit(self, messages):
        """Files get their names first, and those they replace go last, so a crash in between loses no row."""
        for k, m in enumerate(m for m in messages if m):
            store, draft = place(m.path)
            folder, _, base = draft.rpartition("/")
            store.move(draft, f"{folder}/part-{k:05d}-{base[6:]}")
        for f in self.before:
            store, name = place(f)
            store.delete_file(name)

    def abort(self, messages):
        for m in messages:
            if m:
                store, name = place(m.path)
                if store.get_file_info(name).type == fs.FileType.File:
                    store.delete_file(name)


class AvroPairSource(DataSource):
    """Format ``avro_pair``; option ``codec``: deflate (default) or null."""

    @classmethod
    def name(cls) -> str:
        return "avro_pair"

    def schema(self):
        found = files_of(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        with _reading(found[0][0]) as f:
            return spark_type(read_header(f)[0])

    def reader(self, schema):
        return _Reader(schema, self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(schema, self.options["path"], overwrite, self.options.get("codec", "deflate"))


def spark_type(schema) -> T.DataType:
    """Spark type of an Avro schema."""
    if isinstance(schema, list):
        return spark_type(next(s for s in schema if s != "null"))
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(spark_type(schema["items"]))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"]))
    if kind == "fixed":
        return T.BinaryType()
    if kind == "enum":
        return T.StringType()
    if isinstance(kind, (dict, list)):
        return spark_type(kind)
    return {v: k for k, v in _NAMES.items()}[kind]()
