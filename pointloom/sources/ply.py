"""PLY as a Spark data source: byte ranges of records on the way in, committed files on the way out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Stores that workers reach without Spark's own readers.
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
#: Bytes of records of one input partition, and of a header at most.
RANGE, HEAD = 32 << 20, 1 << 16
#: Records of an output batch.
CHUNK = 1 << 16
COLUMNS = "scene_id long, point_id long, x double, y double, z double, label int, red int, green int, blue int, path string, n_header long, n_readable long"
RECORD = np.dtype([(a, "<f4") for a in "xyz"] + [(c, "<u1") for c in ("red", "green", "blue", "label")])
_XYZRGB = [(a, "<f4") for a in "xyz"] + [(c, "<u1") for c in ("red", "green", "blue")]


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a URI or a local path."""
    return (pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path))


def reachable(path: str) -> bool:
    return ":" not in path.split("/")[0] or path.split(":")[0] in SCHEMES


@dataclass
class Records(InputPartition):
    """Records ``first .. first + count`` of a file; for text files all lines."""

    scene: int
    path: str
    body: int
    first: int
    count: int
    n_header: int
    n_readable: int
    fields: list
    binary: bool


class PlyReader(DataSourceReader):
    """Files are listed and ranked by name first; then ranges of their records are dealt to partitions."""

    def __init__(self, options):
        self.path, self.layout = options["path"], options.get("layout", "auto")

    def partitions(self):
        from .clouds import read_header

        files, root = store(self.path)
        info = files.get_file_info(root)
        if info.type == pafs.FileType.File:
            found = [info]
        else:
            found = [f for f in files.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".ply")]
        parts = []
        for scene, f in enumerate(sorted(found, key=lambda i: i.path)):
            with files.open_input_file(f.path) as handle:
                body, binary, count, fields = read_header(handle.read_at(min(HEAD, f.size), 0))
            binary = binary and self.layout != "ascii"
            fields = _XYZRGB if self.layout == "xyzrgb" else fields
            if self.layout == "labelled" and "label" not in [n for n, _ in fields]:
                raise ValueError(f"{f.path}: no label property")
            if not binary:
                parts.append(Records(scene, f.path, body, 0, count, count, -1, fields, False))
                continue
            width = np.dtype(fields).itemsize
            readable = min(count, (f.size - body) // width)
            if readable < count and self.layout != "xyzrgb":
                raise ValueError(f"{f.path}: body holds {readable} of {count} records")
            step = max(1, RANGE // width)
            parts += [Records(scene, f.path, body, a, min(step, readable - a), count, readable, fields, True) for a in range(0, readable, step)]
        return parts or [Records(-1, "", 0, 0, 0, 0, 0, [], True)]

    def read(self, part: Records):
        if part.scene < 0:
            return
        files, _ = store(self.path)
        names = [n for n, _ in part.fields]
        with files.open_input_file(part.path) as handle:
            if not part.binary:
                from .clouds import ascii_rows

                handle.seek(part.body)
                values = ascii_rows(handle.read().decode("ascii", "replace"), part.count, max(len(names), 3))
                get = lambda n, a, b: values[a:b, names.index(n)] if n in names else None
                first, count, readable = 0, len(values), len(values)
                for at in range(0, count, CHUNK):
                    yield _batch(part, get, first + at, at, min(at + CHUNK, count), readable)
                return
            dtype = np.dtype(part.fields)
            for at in range(0, part.count, CHUNK):
                size = min(CHUNK, part.count - at)
                table = np.frombuffer(handle.read_at(size * dtype.itemsize, part.body + (part.first + at) * dtype.itemsize), dtype)
                get = lambda n, a, b: table[n][a:b] if n in names else None
                yield _batch(part, get, part.first + at, 0, size, part.n_readable)


def _batch(part: Records, get, first: int, a: int, b: int, readable: int) -> pa.RecordBatch:
    n = b - a
    columns = {"scene_id": pa.array(np.full(n, part.scene)), "point_id": pa.array(np.arange(first, first + n))}
    for c in "xyz":
        columns[c] = pa.array(np.asarray(get(c, a, b), dtype=np.float64))
    for c in ("label", "red", "green", "blue"):
        v = get(c, a, b)
        columns[c] = pa.nulls(n, pa.int32()) if v is None else pa.array(np.asarray(v).astype(np.int32))
    columns["path"] = pa.array([part.path] * n, pa.string())
    columns["n_header"], columns["n_readable"] = pa.array(np.full(n, part.n_header)), pa.array(np.full(n, readable))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


@dataclass
class Written(WriterCommitMessage):
    """Files that a task wrote under names of its own, with the names they get at the commit."""

    files: list


class PlyWriter(DataSourceArrowWriter):
    """One binary file per scene; rows arrive sorted by scene and point, with the scene's count in ``n``.

    Tasks write under names of their own; only the commit, which names the files of successful attempts, gives them their place.
    Files of failed or repeated attempts stay in the attempt folder, which the commit deletes.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.attempts = options["path"].rstrip("/"), f"_attempts-{uuid.uuid4().hex}"

    def write(self, iterator):
        from .clouds import ply_head

        files, root = store(self.path)
        files.create_dir(f"{root}/{self.attempts}", recursive=True)
        done, handle, scene = [], None, None
        for batch in iterator:
            rows = batch.to_pandas()
            for key, part in rows.groupby("scene_id", sort=False):
                if key != scene:
                    if handle is not None:
                        handle.close()
                    scene, name = key, f"{root}/{self.attempts}/{uuid.uuid4().hex}"
                    handle = files.open_output_stream(name)
                    handle.write(ply_head(int(part["n"].iloc[0])))
                    done.append((name, f"{root}/{int(key):05d}.ply"))
                record = np.empty(len(part), RECORD)
                for c in RECORD.names:
                    record[c] = part[c].to_numpy()
                handle.write(record.tobytes())
        if handle is not None:
            handle.close()
        return Written(done)

    def commit(self, messages):
        files, root = store(self.path)
        for message in messages:
            for temporary, final in message.files if message else ():
                files.move(temporary, final)
        self._clear(files, root)

    def abort(self, messages):
        self._clear(*store(self.path))

    def _clear(self, files, root):
        if files.get_file_info(f"{root}/{self.attempts}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/{self.attempts}")


class PlySource(DataSource):
    """``spark.read.format("ply")`` and ``df.write.format("ply")`` once registered."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        return COLUMNS

    def reader(self, schema: StructType):
        return PlyReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return PlyWriter(self.options, overwrite)
