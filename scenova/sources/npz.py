"""Array shards (``.npz``) as a Spark data source: ``spark.read.format("npz")`` and ``df.write.format("npz")``.

Reading: one partition for each shard, in the order of their names; the schema
names the members, and no other member of a shard is unpacked. ``file`` and
``row``, if the schema has them, tell where a row came from. A member's first
axis is the row. Where a schema asks for one level of arrays more than a member
has axes, the member's missing target axis is put back.

Writing: a task writes shards of ``rows`` rows (an option), loads each again and
compares names, types and shapes. Arrays of unequal length are padded to the
longest of their shard (NaN, 0, false or the empty string), with their lengths
in ``<name>__length``; nulls have a mask in ``<name>__null``. The shards of a job
share a prefix; once all tasks have ended, a manifest is written that lists
them, and a folder with manifests is read by these alone. So what a lost
executor has left is never read, and a job that fails removes its prefix.

Paths go through Arrow's file systems: local and mounted folders, HDFS and
object stores by their URIs.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LENGTH, NULL, MANIFEST = "__length", "__null", "_manifest-"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def shards(path: str) -> list[str]:
    """Shards of a folder and those below it, by name: all, or those that manifests list."""
    files, root = filesystem(path)
    found = [f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    listed = [m for m in found if posixpath.basename(m).startswith(MANIFEST)]
    if not listed:
        return sorted(f for f in found if f.endswith(".npz"))
    out = []
    for m in listed:
        with files.open_input_stream(m) as held:
            out += [posixpath.join(posixpath.dirname(m), s["name"]) for s in json.load(held)]
    return sorted(out)


def levels(kind: pa.DataType) -> int:
    return 1 + levels(kind.value_type) if pa.types.is_list(kind) else 0


def as_column(held: dict[str, np.ndarray], field: pa.Field) -> pa.Array:
    """An Arrow column of a member, with its lengths and nulls."""
    x, depth = held[field.name], levels(field.type)
    if x.ndim == depth and depth > 1:
        x = x[:, None]  # a target axis that was dropped
    lengths, null = held.get(field.name + LENGTH), held.get(field.name + NULL)
    rows = x.tolist()
    if lengths is not None:
        rows = [r[:n] for r, n in zip(rows, lengths.tolist())]
    if null is not None:
        rows = [None if gone else r for r, gone in zip(rows, null.tolist())]
    return pa.array(rows, field.type)


def as_members(name: str, column: pa.Array) -> dict[str, np.ndarray]:
    """A column as members of a shard."""
    values, out = column.to_pylist(), {}
    if column.null_count:
        out[name + NULL] = np.array([v is None for v in values])
    kind, depth = column.type, levels(column.type)
    while pa.types.is_list(kind):
        kind = kind.value_type
    text = pa.types.is_string(kind) or pa.types.is_large_string(kind)
    dtype = np.dtype(str) if text else np.dtype(kind.to_pandas_dtype())
    blank = "" if text else np.nan if dtype.kind == "f" else dtype.type(0)
    if not depth:
        return out | {name: np.array([blank if v is None else v for v in values], dtype)}
    rows = [v or [] for v in values]
    sizes = [len(r) for r in rows]
    if len(set(sizes)) > 1 or column.null_count:
        out[name + LENGTH] = np.array(sizes, np.int32)
    longest = max(sizes, default=0)
    if depth == 1:
        padded = [r + [blank] * (longest - len(r)) for r in rows]
        return out | {name: np.array(padded, dtype).reshape(len(rows), longest)}
    inner = {len(e) for r in rows for e in r}
    if depth > 2 or len(inner) > 1:
        raise ValueError(f"{name}: arrays below the first level must have one length")
    wide = inner.pop() if inner else 0
    padded = [r + [[blank] * wide] * (longest - len(r)) for r in rows]
    return out | {name: np.array(padded, dtype).reshape(len(rows), longest, wide)}


@dataclass
class Shard(InputPartition):
    path: str


class NpzReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = to_arrow_schema(schema), options["path"]

    def partitions(self) -> list[InputPartition]:
        return [Shard(p) for p in shards(self.path)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        with files.open_input_file(partition.path) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as held:
            named = [f for f in self.schema if f.name not in ("file", "row")]
            found = {k: held[k] for f in named for k in (f.name, f.name + LENGTH, f.name + NULL) if k in held.files}
            n = len(found[named[0].name]) if named else len(held[held.files[0]])
        own = {"file": lambda kind: pa.array([partition.path] * n, kind), "row": lambda kind: pa.array(np.arange(n), kind)}
        columns = [own[f.name](f.type) if f.name in own else as_column(found, f) for f in self.schema]
        yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


@dataclass
class Written(WriterCommitMessage):
    shards: list[dict]


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.rows, self.job = options["path"], int(options.get("rows", 4096)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        out, rest = [], None
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while rest.num_rows >= self.rows:
                out.append(self.shard(files, root, rest.slice(0, self.rows)))
                rest = rest.slice(self.rows)
        if rest is not None and rest.num_rows:
            out.append(self.shard(files, root, rest))
        return Written(out)

    def shard(self, files: fs.FileSystem, root: str, table: pa.Table) -> dict:
        """Write one shard, load it again and compare."""
        members: dict[str, np.ndarray] = {}
        for name in table.column_names:
            members |= as_members(name, table[name].combine_chunks())
        name = f"part-{self.job}-{uuid.uuid4().hex}.npz"
        raw = io.BytesIO()
        np.savez_compressed(raw, **members)
        with files.open_output_stream(f"{root}/{name}") as f:
            f.write(raw.getvalue())
        shapes = {k: [x.dtype.str, *x.shape] for k, x in members.items()}
        with files.open_input_file(f"{root}/{name}") as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as held:
            again = {k: [held[k].dtype.str, *held[k].shape] for k in held.files}
        if again != shapes:
            raise ValueError(f"{name} holds {again}, not {shapes}")
        return {"name": name, "rows": table.num_rows, "shapes": shapes}

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = filesystem(self.path)
        listed = [s for m in messages if m for s in m.shards]
        kinds = {(k, s["shapes"][k][0][1:] if s["shapes"][k][0][1] != "U" else "U") for s in listed for k in s["shapes"] if not k.endswith((LENGTH, NULL))}
        if len(kinds) > len({k for k, _ in kinds}):
            raise ValueError(f"shards differ in types: {sorted(kinds)}")
        with files.open_output_stream(f"{root}/{MANIFEST}{self.job}.json") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = filesystem(self.path)
        for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if self.job in posixpath.basename(f.path):
                files.delete_file(f.path)


class NpzSource(DataSource):
    """Format "npz". Options: path, and rows in a shard when writing."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        raise ValueError("npz needs a schema: it names the members to read")

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            files, root = filesystem(self.options["path"])
            if files.get_file_info(root).type == fs.FileType.Directory:
                files.delete_dir_contents(root)
        return NpzWriter(self.options)


def register(spark) -> None:
    spark.dataSource.register(NpzSource)
