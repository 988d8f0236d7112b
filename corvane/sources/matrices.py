"""Vector matrices as files of raw numbers: a data source that reads and writes ``.npy`` by row ranges.

A matrix is either a folder of parts (``part-*.npy``, each with its ``part-*.json`` of ids) that ``_matrix.json``
lists in order, or one ``.npy`` file with a JSON list of its ids beside it. Reading splits every file into row
ranges: a task seeks to its bytes and reads no others. Writing is in two phases: tasks write parts that nobody
lists; the driver then lists them in one small file, which is moved into place. Before that move readers see
what was there before; parts of tasks that failed or ran twice are never listed.

Files are opened by ``pyarrow.fs``, so paths may be local or of any store that it knows.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "corvane_matrix"
LISTED = "_matrix.json"
#: Rows of a written part, and bytes of a read range.
PART_ROWS, RANGE_BYTES = 65_536, 32 << 20


class MatrixError(ValueError):
    """Files that do not fit together."""


def _at(path: str) -> tuple[fs.FileSystem, str]:
    store, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, where.rstrip("/")


def _json(store: fs.FileSystem, path: str):
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Header:
    rows: int
    dim: int
    dtype: str
    offset: int


def header(store: fs.FileSystem, path: str) -> Header:
    with store.open_input_file(path) as f:
        head = io.BytesIO(f.read(1 << 16))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if len(shape) != 2 or fortran or dtype.kind != "f":
        raise MatrixError(f"{path}: not a row-wise matrix of floating-point numbers, but {dtype} {shape}")
    return Header(shape[0], shape[1], dtype.str, head.tell())


@dataclass
class Part:
    vectors: str
    ids: str
    header: Header


def listed_parts(path: str, ids: str | None = None) -> list[Part]:
    """The files of a matrix in order; they must fit together."""
    store, where = _at(path)
    if where.endswith(".npy"):
        names = [(where, _at(ids)[1] if ids else f"{where.rpartition('/')[0]}/ids.json")]
    else:
        names = [(f"{where}/{p['vectors']}", f"{where}/{p['ids']}") for p in _json(store, f"{where}/{LISTED}")["parts"]]
    parts = [Part(v, i, header(store, v)) for v, i in names]
    dims = {p.header.dim for p in parts if p.header.rows}
    if len(dims) > 1:
        raise MatrixError(f"{path}: vectors of {sorted(dims)} numbers")
    return parts


@dataclass
class Range(InputPartition):
    path: str
    part: Part
    first: int
    rows: int
    row: int


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, ids: str | None, text_ids: bool, bytes_: int):
        self.path, self.ids, self.text_ids, self.bytes = path, ids, text_ids, bytes_

    def partitions(self) -> list[Range]:
        out, row = [], 0
        for part in listed_parts(self.path, self.ids):
            step = max(1, self.bytes // max(1, part.header.dim * np.dtype(part.header.dtype).itemsize))
            for first in range(0, part.header.rows, step):
                n = min(step, part.header.rows - first)
                out.append(Range(self.path, part, first, n, row + first))
            row += part.header.rows
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a matrix without rows has no ranges
            return
        store, _ = _at(partition.path)
        head = partition.part.header
        ids = _json(store, partition.part.ids)
        if len(ids) != head.rows:
            raise MatrixError(f"{partition.part.vectors}: {head.rows} vectors, but {len(ids)} ids")
        size = head.dim * np.dtype(head.dtype).itemsize
        with store.open_input_file(partition.part.vectors) as f:
            raw = f.read_at(partition.rows * size, head.offset + partition.first * size)
        if len(raw) != partition.rows * size:
            raise MatrixError(f"{partition.part.vectors}: the file ends early")
        vectors = np.frombuffer(raw, head.dtype).astype(np.float32, copy=False).reshape(partition.rows, head.dim)
        for a in range(0, partition.rows, 4096):
            m = vectors[a : a + 4096]
            ends = np.arange(0, m.size + 1, max(head.dim, 1), dtype=np.int32) if head.dim else np.zeros(len(m) + 1, np.int32)
            own = ids[partition.first + a : partition.first + a + len(m)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(m)) + partition.row + a), pa.array([str(x) for x in own], pa.string()) if self.text_ids else pa.array(own, pa.int64()), pa.ListArray.from_arrays(ends, m.ravel())],
                ["row", "id", "vec"],
            )


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, where = _at(self.path)
        store.create_dir(where, recursive=True)
        parts, held, rows = [], [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            vec = table["vec"].combine_chunks()
            sizes = np.unique(vec.value_lengths().to_numpy(zero_copy_only=False)) if len(vec) else np.zeros(0)
            if vec.null_count or len(sizes) > 1:
                raise MatrixError(f"vectors of {sizes.tolist()} numbers, {vec.null_count} of them null")
            m = vec.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(vec), -1)
            name = f"part-{uuid.uuid4().hex}"
            with store.open_output_stream(f"{where}/{name}.npy") as f:
                buffer = io.BytesIO()
                np.lib.format.write_array_header_1_0(buffer, np.lib.format.header_data_from_array_1_0(m))
                f.write(buffer.getvalue())
                f.write(m.tobytes())
            with store.open_output_stream(f"{where}/{name}.json") as f:
                f.write(json.dumps(table["id"].to_pylist(), ensure_ascii=False).encode())
            parts.append({"vectors": f"{name}.npy", "ids": f"{name}.json", "rows": len(m), "dim": int(m.shape[1])})

        for batch in iterator:
            at = 0
            while at < len(batch):
                take = min(len(batch) - at, PART_ROWS - rows)
                held.append(batch.slice(at, take))
                rows, at = rows + take, at + take
                if rows == PART_ROWS:
                    flush()
                    held, rows = [], 0
        if rows:
            flush()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        store, where = _at(self.path)
        store.create_dir(where, recursive=True)
        parts = [p for m in messages if m is not None for p in m.parts]
        dims = {p["dim"] for p in parts}
        if len(dims) > 1:
            self.abort(messages)
            raise MatrixError(f"vectors of {sorted(dims)} numbers")
        there = store.get_file_info(f"{where}/{LISTED}").type == fs.FileType.File
        before = _json(store, f"{where}/{LISTED}")["parts"] if there else []
        name = f"{where}/_new-{uuid.uuid4().hex}.json"
        with store.open_output_stream(name) as f:
            f.write(json.dumps({"parts": parts if self.overwrite else before + parts}).encode())
        store.move(name, f"{where}/{LISTED}")
        if self.overwrite:  # nothing lists them any more
            self._delete(before)

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([p for m in messages if m is not None for p in m.parts])

    def _delete(self, parts: list[dict]) -> None:
        store, where = _at(self.path)
        for p in parts:
            for name in (p["vectors"], p["ids"]):
                if store.get_file_info(f"{where}/{name}").type == fs.FileType.File:
                    store.delete_file(f"{where}/{name}")


class MatrixSource(DataSource):
    """Options: ``path``; ``ids``, the id file of a single ``.npy`` (``ids.json`` beside it); ``bytes``, of a read range."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"row long, id {'string' if self._text_ids() else 'long'}, vec array<float>"

    def _text_ids(self) -> bool:
        parts = listed_parts(self.options["path"], self.options.get("ids"))
        store, _ = _at(self.options["path"])
        first = _json(store, parts[0].ids) if parts else []
        return bool(first) and not isinstance(first[0], int)

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], self.options.get("ids"), schema["id"].dataType.typeName() == "string", int(self.options.get("bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        if not {"id", "vec"} <= set(schema.fieldNames()):
            raise MatrixError("a matrix is written from columns id and vec")
        return MatrixWriter(self.options["path"], overwrite)


def read_matrix(spark: SparkSession, path: str, ids: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(row, id, vec)`` of a matrix, ``row`` being its place in the files."""
    spark.dataSource.register(MatrixSource)
    options = {"path": path, "bytes": str(range_bytes)} | ({"ids": ids} if ids else {})
    return spark.read.format(FORMAT).options(**options).load()


def write_matrix(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes ``df(id, vec)`` as the parts of a matrix; ``mode`` is ``overwrite`` or ``append``."""
    df.sparkSession.dataSource.register(MatrixSource)
    df.select("id", "vec").write.format(FORMAT).mode(mode).option("path", path).save()
