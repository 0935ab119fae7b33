"""Deterministic sharded WARC archives.

Records are range-sorted by id; each task writes gzip members and begins a new file when the compressed size passes a
bound. Files are staged under names unique to the attempt; a manifest, committed by Spark as one table, lists those of
the attempts that count, and a second job renames them to their final names (repeating it is harmless). So a lost
executor leaves at most stray staged files. Headers and digests are made anew from the payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.shared import new_path

#: Parts that the pages of one payload are dealt over when they learn which of them is the response.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "part int, file int, staged string, name string, records long, bytes long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Date", DATE), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _clean(url: str) -> str:
    """Control characters would end a header line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def page_record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", _uri(page_id)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.insert(1, ("WARC-Target-URI", _clean(url)))
    if not revisits:
        return record("response", fields, http + payload)
    return record("revisit", [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))], http)


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Shard:
    """Rolls gzip files of one task; closed ones are listed in `done`."""

    def __init__(self, folder: str, part: int, most: int):
        self.fs, self.root = _file_system(folder)
        self.part, self.most, self.done, self.out, self.attempt = part, most, [], None, uuid.uuid4().hex

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.staged = f"_staged/{self.part:06d}-{len(self.done):06d}-{self.attempt}.warc.gz"
            self.fs.create_dir(f"{self.root}/_staged", recursive=True)
            self.out, self.size, self.records = self.fs.open_output_stream(f"{self.root}/{self.staged}", compression=None), 0, 0
            self._member(record("warcinfo", [("WARC-Record-ID", f"<urn:x-shard:{self.part}-{len(self.done)}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._member(data)
        self.records += 1
        if self.size >= self.most:
            self.close()

    def _member(self, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.out.write(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.part, len(self.done), self.staged, f"{self.part:06d}-{len(self.done):06d}.warc.gz", self.records, self.size))
            self.out = None


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = 256 << 20, least_bytes: int = 0, shards: int | None = None) -> DataFrame:
    """Writes pages(page_id, url, html) under folder and returns the manifest.

    Of records with equal payloads of least_bytes or more, that with the largest page_id is the response, the others
    revisit it; smaller payloads are all responses. Null ids come before all others; among repeated rows with the largest
    page_id the first is the response. Null html is an empty payload, a null url has no target header, an empty table gives
    an empty manifest. Other columns are ignored."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("hex", F.sha1(F.encode("html", "UTF-8")))
    keyed = p.select("page_id", "hex", F.octet_length("html").alias("n"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    groups = keyed.where(F.col("n") >= least_bytes).groupBy("hex").agg(F.max("page_id").alias("keep"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # pages with one payload meet it in many tasks
    roles = keyed.join(groups, ["hex", "salt"]).groupBy("page_id", "hex").agg(F.max("keep").alias("keep"))
    none = F.lit(None).cast("string")
    rows = p.select("page_id", "hex", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("keep")).unionByName(roles.select("page_id", "hex", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "keep"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "page_id", "hex").sortWithinPartitions("page_id", "hex", "kind", "url", "html")

    def write(batches: Iterator[pa.RecordBatch]):
        shard, at, known, keep, written = Shard(folder, TaskContext.get().partitionId(), roll_bytes), None, False, None, False
        for b in batches:
            for r in b.to_pylist():
                if (r["page_id"], r["hex"]) != at:
                    at, known, keep, written = (r["page_id"], r["hex"]), False, None, False
                if r["kind"] == 0:  # comes before its pages
                    known, keep = True, r["keep"]
                    continue
                first = not known or (keep == r["page_id"] and not written)
                written = True
                shard.write(page_record(r["page_id"], r["url"], r["html"].encode(), not first, keep))
        shard.close()
        if shard.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*shard.done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "staged", "name", "records", "bytes"])

    path = f"{folder}/_manifest"
    rows.mapInArrow(write, MANIFEST).write.parquet(path)
    manifest = spark.read.schema(MANIFEST).parquet(path)

    def publish(batches: Iterator[pa.RecordBatch]):
        disk, root = _file_system(folder)
        for b in batches:
            for r in b.to_pylist():
                if disk.get_file_info(f"{root}/{r['staged']}").type != fs.FileType.NotFound:
                    disk.move(f"{root}/{r['staged']}", f"{root}/{r['name']}")
                elif disk.get_file_info(f"{root}/{r['name']}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{r['name']}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    manifest.mapInArrow(publish, "n long").agg(F.sum("n")).collect()
    return manifest


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream one by one, inflated."""
    inflate, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            out.append(inflate.decompress(data))
            data = inflate.unused_data
            if not inflate.eof:
                break
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []
    if any(out):
        raise EOFError("the last member is cut off")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    return fields, block


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of the manifest's files: RECORDS. Revisits have a null payload but the full payload's size and digest;
    a record without an id has a null page_id, an empty manifest no records."""

    def read(batches: Iterator[pa.RecordBatch]):
        disk, root = _file_system(folder)
        number = lambda s: None if s.endswith(":none>") else int(s[1:-1].rsplit(":", 1)[1])
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())])
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with disk.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
                            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
                        revisit = fields["WARC-Type"] == "revisit"
                        rows.append({
                            "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload if payloads and not revisit else None, "payload_bytes": int(fields["X-Payload-Length"]),
                            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "file": name,
                        })
                        held += len(payload) if payloads else 0
                        if len(rows) >= 5000 or held > 32 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("name").repartition(max(1, manifest.count()), "name").mapInArrow(read, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "warc")
