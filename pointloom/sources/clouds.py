"""Point-cloud files: distributed ingest and one file per scene on export.

Files are read by byte ranges of records (:mod:`pointloom.sources.ply`), or whole through Spark where only Spark reaches
the store; Python workers only decode and encode bytes, everything else is DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.groups import attach
from ..functions.lineage import with_small
from ..operators.transforms import label_rgb
from .ply import PlySource, reachable

# Names of the PLY scalar types and their little-endian layouts.
PLY_TYPES = {
    "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "int": "<i4", "int32": "<i4",
    "uint": "<u4", "uint32": "<u4", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "char": "<i1", "int8": "<i1", "uchar": "<u1", "uint8": "<u1",
}
POINT_SCHEMA = (
    "path string, point_id long, x double, y double, z double, label int, red int, green int, blue int,"
    " n_header long, n_readable long"
)
CHUNK = 1 << 18


def read_header(data: bytes):
    end = data.index(b"end_header") + len(b"end_header")
    body = data.index(b"\n", end - 1) + 1
    binary, count, fields, in_vertex = False, 0, [], False
    for line in data[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            binary = words[1].startswith("binary")
        elif words[:1] == ["element"]:
            in_vertex = words[1] == "vertex"
            count = int(words[2]) if in_vertex else count
        elif words[:1] == ["property"] and in_vertex and words[1] != "list":
            fields.append((words[-1], PLY_TYPES.get(words[1], "<f4")))
    return body, binary, count, fields


def ascii_rows(text: str, limit: int, width: int):
    """Rows up to the first short or non-numeric line."""
    rows = []
    for line in text.splitlines():
        if len(rows) >= limit:
            break
        words = line.split()
        if len(words) < width:
            break
        try:
            rows.append([float(w) for w in words[:width]])
        except ValueError:
            break
    return np.array(rows, dtype=np.float64).reshape(-1, width)


def _decode(path: str, data: bytes, layout: str):
    body, binary, count, fields = read_header(data)
    names = [n for n, _ in fields]
    if layout == "ascii":
        binary = False
    if layout == "xyzrgb":
        fields = [(a, "<f4") for a in "xyz"] + [(c, "<u1") for c in ("red", "green", "blue")]
        names = [n for n, _ in fields]
    if binary:
        dtype = np.dtype(fields)
        readable = min(count, (len(data) - body) // dtype.itemsize)
        if readable < count and layout != "xyzrgb":
            raise ValueError(f"{path}: body holds {readable} of {count} records")
        table = np.frombuffer(data, dtype=dtype, count=readable, offset=body)
        get = lambda n: table[n] if n in names else None
    else:
        values = ascii_rows(data[body:].decode("ascii", "replace"), count, max(len(names), 3))
        readable = len(values)
        get = lambda n: values[:, names.index(n)] if n in names else None
    if layout == "labelled" and "label" not in names:
        raise ValueError(f"{path}: no label property")
    for start in range(0, max(readable, 1), CHUNK):
        part = slice(start, min(start + CHUNK, readable))
        size = part.stop - part.start
        frame = {"path": path, "point_id": np.arange(part.start, part.stop, dtype=np.int64)}
        for a in ("x", "y", "z"):
            frame[a] = np.asarray(get(a)[part], dtype=np.float64)
        for c in ("label", "red", "green", "blue"):
            v = get(c)
            frame[c] = pd.array([None] * size if v is None else np.asarray(v[part]).astype(np.int64), dtype="Int32")
        frame["n_header"], frame["n_readable"] = count, readable
        yield pd.DataFrame(frame)


def read_points(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """Read a directory of PLY files; ``scene_id`` is the rank of the sorted file name.

    Layouts: ``labelled`` (label required), ``header`` and ``auto`` (whatever the header
    says), ``xyzrgb`` (15-byte records; a cut-off body keeps its complete records),
    ``ascii`` (reads up to the first bad line).  ``n_header - n_readable`` counts lost records.
    """
    if reachable(path):
        spark.dataSource.register(PlySource)
        out = spark.read.format("ply").option("layout", layout).load(path)
    else:
        out = _read_through_spark(spark, path, layout)
    if layout == "labelled":
        return out.select("scene_id", "point_id", "x", "y", "z", "label", "path")
    return out.select(
        "scene_id", "point_id", "x", "y", "z", "label", "red", "green", "blue", "path", "n_header", "n_readable"
    )


def _read_through_spark(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """The same for stores that only Spark reads: whole files of up to 2 GB, ranked before they are decoded."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path)
    )
    # Ranks need the file list only: the content column is pruned from this branch.
    ranks = files.select("path").withColumn("_dir", F.lit(0)).withColumn(
        "scene_id", (F.row_number().over(Window.partitionBy("_dir").orderBy("path")) - 1).cast("long")
    ).drop("_dir")

    def decode(batches):
        for batch in batches:
            for scene, p, content in zip(batch["scene_id"], batch["path"], batch["content"]):
                for frame in _decode(p, content, layout):
                    frame.insert(0, "scene_id", scene)
                    yield frame

    ranked = with_small(files.select("path", "content"), ranks, "path", "inner").select("scene_id", "path", "content")
    return ranked.mapInPandas(decode, f"scene_id long, {POINT_SCHEMA}")


def ply_head(n: int) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}"]
    lines += [f"property float {a}" for a in "xyz"]
    lines += [f"property uchar {c}" for c in ("red", "green", "blue", "label")]
    return ("\n".join(lines) + "\nend_header\n").encode("ascii")


def write_points(df: DataFrame, path: str, format: str = "parquet", label: str = "label") -> None:
    """Write a labelled cloud.

    ``parquet`` (default) partitions by scene and is the scalable form.  ``ply`` writes one
    file per scene with colours derived from the label.  A PLY file is one stream with the point
    count in front, so one task writes it; rows arrive sorted and leave in chunks, so
    memory stays bounded even for a huge scene.  Files appear only when the whole job commits.
    """
    coloured = label_rgb(df, label)
    if format == "parquet":
        coloured.repartition("scene_id", F.pmod(F.xxhash64("point_id"), F.lit(16))).write.mode("overwrite").partitionBy(
            "scene_id").parquet(path)
        return
    counts = df.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        attach(coloured, counts, "scene_id")
        .select("scene_id", "point_id", "x", "y", "z", "red", "green", "blue", F.col(label).alias("label"), "n")
        .repartition("scene_id").sortWithinPartitions("scene_id", "point_id")
    )
    df.sparkSession.dataSource.register(PlySource)
    rows.write.format("ply").mode("append").save(path)
