"""WARC archives in Zstandard with a dictionary, and their reader.

Every task writes archives of its own: a leading skippable frame (magic 0x184D2A5D) with a dictionary trained on
records of this archive, then a frame for each record, compressed alone with that dictionary, so that any record can be
read by itself. Records with a payload that an earlier page has are revisits without payload. Dictionary training uses the archive's first ``TRAIN`` bytes of records, which is
also all that a task holds in memory besides one record.

Archives go to the folder that all executors share, under names that no other attempt uses; the list of archives comes
from the tasks that succeeded, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch

#: Fixed values of the format: the dictionary frame's magic, and that of a Zstandard frame.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Bytes of records to train on, of a dictionary, samples at least, bytes of an archive after which the next begins.
TRAIN, DICT, SAMPLES, ARCHIVE = 4 << 20, 1 << 16, 16, 1 << 28
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page, url: str | None, payload: bytes, sha1: str, refers_to=None, date: str = DATE) -> bytes:
    """One record: a response with its payload, or, if refers_to is given, a revisit of that page without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c.isprintable() and c != " " else quote(c, safe="", errors="surrogatepass") for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha1}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers by lower-case name, its HTTP headers likewise under ``http``, and its payload (None in a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    out["payload"] = payload if out["warc-type"] == "response" else None
    return out


class Writer:
    """Archives below a folder; ``paths`` has those that are complete."""

    def __init__(self, folder: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.paths: list[tuple[str, int]] = []
        self.held: list[bytes] = []
        self.size, self.out = 0, None

    def add(self, raw: bytes) -> None:
        self.size += len(raw)
        if self.out is None:
            self.held.append(raw)
            if self.size >= TRAIN:
                self._begin()
        else:
            self._write(raw)
        if self.size >= ARCHIVE:
            self.close()

    def _begin(self) -> None:
        table = None
        if len(self.held) >= SAMPLES:
            try:
                table = zstandard.train_dictionary(DICT, [r[: 1 << 16] for r in self.held])
            except zstandard.ZstdError:  # too little to learn from
                table = None
        if table is None:
            table = zstandard.ZstdCompressionDict(b"".join(self.held)[:DICT].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.n = f"{self.folder}/{uuid.uuid4().hex}.warc.zst", 0
        self.out = self.fs.open_output_stream(self.name, compression=None)
        data = table.as_bytes()
        self.out.write(struct.pack("<II", DICT_MAGIC, len(data)) + data)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=table, write_content_size=True)
        held, self.held = self.held, []
        for raw in held:
            self._write(raw)

    def _write(self, raw: bytes) -> None:
        self.out.write(self.zstd.compress(raw))
        self.n += 1

    def close(self) -> None:
        if self.held:
            self._begin()
        if self.out is not None:
            self.out.close()
            self.paths.append((self.name, self.n))
        self.out, self.size = None, 0


def read(fs: pafs.FileSystem, name: str) -> Iterator[bytes]:
    """The records of one archive in turn; one is in memory at a time."""
    with fs.open_input_stream(name, compression=None, buffer_size=1 << 20) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICT_MAGIC:
            raise ValueError(f"{name}: no dictionary frame")
        data = f.read(size)
        kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind))
        rest = b""
        while True:
            rest = rest or f.read(1 << 18)
            if not rest:
                return
            one, parts = zstd.decompressobj(), []
            while True:
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else f.read(1 << 18)
                if one.eof:
                    break
                if not rest:
                    raise ValueError(f"{name}: ends inside a record")
            yield b"".join(parts)


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for every row of df below folder; returns (path, records) of the archives, already written.

    Payload: the text in UTF-8; null: empty. Of rows with equal payloads of ``min_bytes`` at least, that with the
    smallest id is a response and the others revisit it; repeated rows of that id are responses, too. Rows with a null
    id can be revisits, and responses if no other row has their payload. Spaces and unprintable characters of a URL are
    percent-encoded; a null URL is empty. A payload of any length is one record. An empty table gives no archive.
    """
    ids = F.col(id_col).cast("bigint")
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(ids.alias("id"), F.col(url_col).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("sha1"))
    facts = rows.select("id", "sha1", F.octet_length("html").alias("n"))
    first = facts.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    # Who revisits whom is told on narrow rows; of pages without content, a hot key, the first is one literal.
    none = hashlib.sha1(b"").hexdigest()
    empty = facts.where(F.col("n") == 0).agg(F.min("id"), F.count("*")).first()
    void = empty[0] if min_bytes <= 0 and empty[1] > 1 else None
    told = facts.where(F.col("n") > 0).join(first.where(F.col("sha1") != none).drop("c"), ["sha1", "n"]).select(F.col("id").alias("i"), F.col("sha1").alias("digest"), "first").distinct()
    both = rows.withColumn("n", F.octet_length("html")).join(told, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha1") == F.col("digest")), "left")
    both = both.withColumn("first", F.when(F.col("n") == 0, F.lit(void)).otherwise(F.col("first")))

    def run(batches):
        out = Writer(folder)
        for b in batches:
            for page, url, html, sha1, to in zip(*(c.to_pylist() for c in b.columns)):
                out.add(record(page, url, html.encode("utf-8", "surrogatepass"), base64.b32encode(bytes.fromhex(sha1)).decode(), to))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out.paths], pa.string()), pa.array([n for _, n in out.paths], pa.int64())], names=["path", "records"])

    to = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return scratch.save(both.select("id", "url", "html", "sha1", to.alias("to")).mapInArrow(run, "path string, records bigint"), "archives")


def load(archives: DataFrame, folder: str) -> DataFrame:
    """The records of archives (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in a revisit).

    A response whose payload doesn't match its digest is an error. A page without id comes back with a null id, one
    without URL with an empty one. No archives, no records; records come back as often as they were written.
    """

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def page(urn):
            text = urn[10:-1] if urn else ""
            return int(text) if text else None

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                for raw in read(fs, path):
                    r = parse(raw)
                    sha1 = r["warc-payload-digest"].removeprefix("sha1:")
                    n = int(r["http"]["content-length"])
                    if r["payload"] is not None and (len(r["payload"]) != n or digest(r["payload"]) != sha1):
                        raise ValueError(f"{path}: a payload doesn't match its digest")
                    rows.append((page(r["warc-record-id"]), r["warc-target-uri"], n, sha1, r["warc-type"], page(r.get("warc-refers-to")), r["payload"]))
                    size += len(raw)
                    if size > 1 << 22:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    spread = archives.select("path").repartition(max(1, archives.count()))  # an archive is a task
    return spread.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """What the archives of all pages say when read back."""
    folder = scratch.folder(spark, "warc")
    archives = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return load(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
