"""WARC archives with a Zstandard dictionary per file, each record a frame of its own."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.lineage import cut, shared_folder

# Magic number of the dictionary's skippable frame and of a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
#: Smallest payload that may be a revisit.
MIN_REVISIT = 100
#: Records of an archive that its dictionary is built from, in bytes, and its size.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"


def _open(path: str):
    """File system and path of a URI or a plain path; the same on every machine."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has the response's HTTP header and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"),
        ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields and payload facts of a record; the payload of a response is hashed anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    if fields["WARC-Type"] == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"] or len(payload) != stated:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    else:
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": stated, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": payload,
    }


def build_dictionary(records: list[bytes]) -> bytes:
    """Dictionary of some records; too few to train on give a raw one of their last bytes."""
    try:
        # Given segment and word lengths: no search over them.
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=3)
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary, kind))


class Archive:
    """Writer of one file: the first records wait until the dictionary can be built."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.path, self.out, self.waiting, self.held, self.compressor = path, system.open_output_stream(name, compression=None), [], 0, None
        self.records = self.raw = self.stored = 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.stored += len(data)

    def _begin(self) -> None:
        dictionary = build_dictionary(self.waiting)
        packed = zstandard.ZstdCompressor(level=10).compress(dictionary)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.compressor = _compressor(dictionary)
        for record in self.waiting:
            self._put(self.compressor.compress(record))
        self.waiting = []

    def add(self, record: bytes) -> None:
        self.records += 1
        self.raw += len(record)
        if self.compressor:
            self._put(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> tuple:
        if not self.compressor:
            self._begin()
        self.out.close()
        return self.path, self.records, self.raw, self.stored


def read_archive(path: str) -> Iterator[bytes]:
    """Records of an archive, one after the other."""
    system, name = _open(path)
    with system.open_input_stream(name, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path} does not begin with a dictionary")
        dictionary = zstandard.ZstdDecompressor().decompress(source.read(size))
        extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        decompressor, rest = zstandard.ZstdDecompressor(**extra), b""
        frame, parts = decompressor.decompressobj(), []
        while rest or (rest := source.read(1 << 20)):
            parts.append(frame.decompress(rest))
            rest = b""
            if frame.eof:
                yield b"".join(parts)
                rest, frame, parts = frame.unused_data, decompressor.decompressobj(), []
        if parts:
            raise ValueError(f"{path} is cut short")


def record_plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of every page.

    Of equal payloads of at least 100 bytes that with the smallest id is the
    response and the others refer to it; rows that share this id, and rows without an id where no row has one, are
    responses.  Null payloads are empty.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts.drop("n"), "digest", "left").select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page and return the manifest ``path, records, raw_bytes, stored_bytes``.

    Every task writes files of its own under fresh names, and only the files that a
    successful task reports are in the manifest; those of a lost or repeated task are not read.
    The manifest is written before it is returned, so nothing is archived twice.
    """
    def run(batches):
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for page, target, payload, digest, refers in zip(*columns):
                archive = archive or Archive(f"{folder}/part-{uuid.uuid4().hex}.warc.zst")
                archive.add(record_bytes(page, target, payload, digest, refers))
                if archive.raw >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        names = ["path", "records", "raw_bytes", "stored_bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string() if i == 0 else pa.int64()) for i in range(4)], names=names)

    system, name = _open(folder)
    system.create_dir(name, recursive=True)
    planned = record_plan(pages, page_id, url, html)
    return cut(planned.mapInArrow(run, "path string, records long, raw_bytes long, stored_bytes long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives of a manifest, a task per archive; responses are checked against their digest."""
    kinds = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for data in read_archive(path):
                    rows.append(parse_record(data))
                    held += len(data)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])

    files = max(1, manifest.count())
    return manifest.select("path").repartition(min(files, 100_000), "path").mapInArrow(run, schema)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
