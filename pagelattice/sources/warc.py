"""WARC archives: the record table and a Spark data source that writes and reads it.

Each task writes one ``.warc.gz`` part, one gzip member per record. A write is published by one small
manifest that names its parts, so neither a task that ran twice nor a lost executor leaves a record
twice or half a file: readers open what a manifest names. The manifest also keeps the offset of a
member every ``SPLIT`` bytes, so that a large part is read by several tasks. Folders without
manifests, as other tools write them, are read file by file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

_DEFAULT_DATE = "1970-01-01T00:00:00Z"
_MANIFESTS = "_manifests"
#: Compressed bytes of a part that one reading task takes.
SPLIT = 64 << 20
#: Payload bytes and rows after which a reading task hands on a batch.
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 1000
_FIELDS = pa.schema(
    [
        ("target_uri", pa.string()),
        ("status_line", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
        ("warc_date", pa.string()),
    ]
)


def responses(captures: DataFrame, url: str = "url", body: str = "html", content_type: str = "text/html") -> DataFrame:
    """Captures as writer input: (target_uri, status_line, headers, payload, warc_date).

    Columns ``status``, ``reason``, ``headers`` (map) and ``captured_at`` are used when present.
    """
    have = set(captures.columns)
    status = F.col("status").cast("string") if "status" in have else F.lit("200")
    reason = F.col("reason") if "reason" in have else F.lit("OK")
    kind = F.col("content_type") if "content_type" in have else F.lit(content_type)
    headers = F.col("headers") if "headers" in have else F.create_map(F.lit("Content-Type"), kind)
    when = (
        F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        if "captured_at" in have
        else F.lit(_DEFAULT_DATE)
    )
    return captures.select(
        F.col(url).alias("target_uri"),
        F.concat_ws(" ", status, reason).alias("status_line"),
        headers.alias("headers"),
        F.col(body).cast("binary").alias("payload"),
        when.alias("warc_date"),
    )


def warc_records(response_rows: DataFrame) -> DataFrame:
    """Header table of the records, computed at the scan."""
    return response_rows.select(
        "target_uri",
        F.lit("response").alias("warc_type"),
        "status_line",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
    )


def _record(row: dict) -> bytes:
    """One response record. Its id follows from its content, so a repeated task repeats it."""
    payload = row["payload"] or b""
    headers = "".join(f"{k}: {v}\r\n" for k, v in (row["headers"] or []))
    block = f"HTTP/1.1 {row['status_line']}\r\n{headers}\r\n".encode() + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    identity = uuid.uuid5(uuid.NAMESPACE_URL, f"{row['target_uri']} {row['warc_date']} {digest}")
    head = (
        "WARC/1.0\r\n"
        "WARC-Type: response\r\n"
        f"WARC-Record-ID: <urn:uuid:{identity}>\r\n"
        f"WARC-Target-URI: {row['target_uri']}\r\n"
        f"WARC-Date: {row['warc_date']}\r\n"
        f"WARC-Payload-Digest: sha1:{digest}\r\n"
        "Content-Type: application/http; msgtype=response\r\n"
        f"Content-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def _store(path: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, root.rstrip("/")


def _listed(system, folder: str) -> list:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.base_name)


@dataclass
class _Part(WriterCommitMessage):
    name: str
    records: int
    size: int
    #: Offsets of members, the first included, at least ``SPLIT`` bytes apart.
    cuts: list[int] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, split: int = SPLIT):
        self.path, self.overwrite, self.split = path, overwrite, split
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _store(self.path)
        system.create_dir(root, recursive=True)
        part = _Part(f"part-{self.job}-{uuid.uuid4().hex}.warc.gz", 0, 0)
        with system.open_output_stream(f"{root}/{part.name}", compression=None) as out:
            for batch in iterator:
                # Row by row out of the batch, so that one record at a time is in Python memory.
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if not part.cuts or part.size - part.cuts[-1] >= self.split:
                        part.cuts.append(part.size)
                    part.size += out.write(gzip.compress(_record(row), mtime=0))
                part.records += batch.num_rows
        return part

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _store(self.path)
        parts = [m for m in messages if m is not None and m.records]
        system.create_dir(f"{root}/{_MANIFESTS}", recursive=True)
        earlier = _listed(system, f"{root}/{_MANIFESTS}")
        number = max((int(f.base_name[:10]) for f in earlier if f.base_name[:10].isdigit()), default=-1) + 1
        named = [{"name": p.name, "records": p.records, "size": p.size, "cuts": p.cuts} for p in parts]
        body = json.dumps({"replaces": self.overwrite, "parts": named}).encode()
        hidden = f"{root}/{_MANIFESTS}/.{self.job}"
        with system.open_output_stream(hidden, compression=None) as out:
            out.write(body)
        # From here on the write is done; what follows only clears files that no reader opens.
        system.move(hidden, f"{root}/{_MANIFESTS}/{number:010d}-{self.job}.json")
        self._drop({p.name for p in parts}, all_jobs=self.overwrite)
        if self.overwrite:
            for old in earlier:
                system.delete_file(old.path)
        with system.open_output_stream(f"{root}/_SUCCESS", compression=None):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(set())

    def _drop(self, keep: set[str], all_jobs: bool = False) -> None:
        """Parts of failed or repeated tasks go; an overwrite takes those of earlier writes along."""
        system, root = _store(self.path)
        for info in _listed(system, root):
            mine = all_jobs or info.base_name.startswith(f"part-{self.job}-")
            if mine and info.base_name.endswith(".warc.gz") and info.base_name not in keep:
                system.delete_file(info.path)


@dataclass
class _Section(InputPartition):
    name: str
    start: int
    end: int | None


class _Span(io.RawIOBase):
    """The bytes of an open file up to an offset, as a stream."""

    def __init__(self, file, start: int, end: int):
        self.file, self.left = file, end - start
        file.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(min(len(buffer), self.left))
        buffer[: len(data)] = data
        self.left -= len(data)
        return len(data)


def _head(stream) -> tuple[str, list[tuple[str, str]]] | None:
    """First line and fields up to the empty line; nothing at the end of the stream."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    fields = []
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields.append((name.strip(), value.strip()))
    return first.decode("utf-8", "replace").strip(), fields


def _responses_of(stream) -> Iterator[dict]:
    """Response records of an uncompressed stream; other kinds of record are passed over."""
    while (head := _head(stream)) is not None:
        line, fields = head
        if not line.startswith("WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:80]!r}")
        known = {name.lower(): value for name, value in fields}
        length = int(known["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record of {known.get('warc-target-uri')} ends early")
        if known.get("warc-type") != "response":
            continue
        http = io.BytesIO(block)
        status, headers = _head(http) or ("", [])
        yield {
            "target_uri": known.get("warc-target-uri"),
            "status_line": status.partition(" ")[2],
            # Of a repeated header the last value; a map holds a key once.
            "headers": list(dict(headers).items()),
            "payload": http.read(),
            "warc_date": known.get("warc-date"),
        }


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, root = _store(self.path)
        manifests = [f for f in _listed(system, f"{root}/{_MANIFESTS}") if f.base_name.endswith(".json")]
        if not manifests:
            return [_Section(f.base_name, 0, None) for f in _listed(system, root) if f.base_name.endswith(".warc.gz")]
        parts = []
        for info in manifests:
            with system.open_input_stream(info.path, compression=None) as file:
                manifest = json.loads(file.read())
            parts = manifest["parts"] if manifest["replaces"] else parts + manifest["parts"]
        return [
            _Section(part["name"], start, end)
            for part in parts
            for start, end in zip(part["cuts"], part["cuts"][1:] + [part["size"]])
        ]

    def read(self, partition: _Section | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's only task where there are no partitions
            return
        system, root = _store(self.path)
        with system.open_input_file(f"{root}/{partition.name}") as file:
            end = file.size() if partition.end is None else partition.end
            span = io.BufferedReader(_Span(file, partition.start, end), 1 << 20)
            rows, held = [], 0
            for row in _responses_of(gzip.GzipFile(fileobj=span)):
                rows.append(row)
                held += len(row["payload"])
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _FIELDS)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _FIELDS)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "target_uri string, status_line string, headers map<string,string>, payload binary, warc_date string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("split", SPLIT)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known. It travels by value, so workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WarcSource)


def _qualified(spark: SparkSession, path: str) -> str:
    """One store for all tasks: a path without a scheme belongs to the default file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(r"^file:/+", "file:///", system.makeQualified(folder).toString())


def write_warc(
    response_rows: DataFrame, path: str, parts: int | None = None, overwrite: bool = False, split: int = SPLIT
) -> None:
    """Write records as ``.warc.gz`` parts, one per task.

    Payloads stay in the partitions they were read in; give ``parts`` only to force a number of
    files, which moves every payload once. ``split`` is the size of the sections that are read apart.
    """
    spark = response_rows.sparkSession
    register(spark)
    rows = response_rows.repartition(parts) if parts else response_rows
    mode = "overwrite" if overwrite else "append"
    rows.write.format("warc").mode(mode).option("path", _qualified(spark, path)).option("split", split).save()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of a folder: (target_uri, status_line, headers, payload, warc_date).

    A record that is cut off or does not start where it should ends the read with an error.
    """
    register(spark)
    return spark.read.format("warc").load(_qualified(spark, path))
