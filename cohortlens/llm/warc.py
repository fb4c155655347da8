"""WARC archives of pages and a two-level capture index.

Writing: each task streams its pages into .warc.gz files (one gzip member per record) below a folder that all executors
share, and returns a manifest row per record; the manifest is the commit, files of lost task attempts are in no manifest.
Of equal payloads only the page with the smallest id carries the payload, the others are revisit records.

Index: manifest lines are sorted by reversed-host URL key over ranges of keys. Each range is one index file: blocks of
lines, each compressed, then the file's directory with one line per block. A top directory holds the key range of each
file, one row per file. A lookup searches the top directory, the file's directory and the block by bisection and reads
just that directory, that block and that record by their byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import file_system_path, shared_folder, written

#: Captures in a compressed block; bytes after which a task begins another archive file.
BLOCK_LINES = 1000
FILE_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"
#: Bytes of neighbouring records that are read at once.
READ_BYTES = 8 << 20
MANIFEST = "key string, id bigint, url string, file string, offset bigint, length bigint, type string, digest string, bytes bigint, refers_to bigint"


def url_key(url: Column) -> Column:
    """Host labels in reverse, a bracket, then path and query, in lower case for the host; '' for null."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def _line(text: str | None) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record(id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, date: str = DATE) -> bytes:
    """One WARC record. A revisit has the HTTP head of its page and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}")
    body = http if revisit_of is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if revisit_of is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name(id)}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if id is not None:
        head.append(f"WARC-Page-ID: {id}")
    if revisit_of is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{name(revisit_of)}>", f"WARC-Refers-To-Page-ID: {revisit_of}"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields (lower-case names), the payload, and its length as the HTTP head has it."""
    at = raw.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in raw[:at].decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    body = raw[at + 4:at + 4 + int(fields["content-length"])]
    head, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in head.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    return fields | {"payload": payload, "payload_length": length}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row below ``folder`` and returns the manifest, itself written there. Runs jobs.

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest id are responses, the others revisit
    it; rows with smaller payloads are all responses. A null page has an empty payload. A null id is never referred to.
    """
    rows = pages.select(pages[id].cast("bigint").alias("id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", url_key(F.col("url")).alias("key"), F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("bytes"))
    first = rows.select("id", "sha", "bytes").where(f"bytes >= {least}").groupBy("sha", "bytes").agg(F.min("id").alias("first"))
    rows = rows.join(first, ["sha", "bytes"], "left").select("key", "id", "url", "html", "sha", F.when(F.col("first").eqNullSafe(F.col("id")), None).otherwise(F.col("first")).alias("refers_to"))

    def write(batches):
        fs, path = file_system_path(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            key, ids, urls, htmls, shas, refers = (batch.column(i).to_pylist() for i in range(6))
            got = []
            for i in range(len(ids)):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                payload = htmls[i].encode("utf-8", "surrogatepass")
                digest = base64.b32encode(bytes.fromhex(shas[i])).decode()
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record(ids[i], urls[i], payload, digest, refers[i])) + pack.flush()
                out.write(data)
                got.append((key[i], ids[i], urls[i], name, at, len(data), "response" if refers[i] is None else "revisit", digest, len(payload), refers[i]))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if out is not None:
                out.flush()
            cols = list(zip(*got)) if got else [[]] * 10
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in MANIFEST.split(", ")])
        if out is not None:
            out.close()

    return written(rows.mapInArrow(write, MANIFEST), "manifest")


@dataclass(frozen=True)
class CaptureIndex:
    folder: str
    top: list[tuple[str, str, str]]  # (first key, last key, index file), by key: one for each index file


def build_index(manifest: DataFrame, folder: str) -> CaptureIndex:
    """Writes index files below ``folder``; the driver gets one row per file. Runs jobs."""

    def write(batches):
        fs, path = file_system_path(folder)
        fs.create_dir(path, recursive=True)
        out, name, at, lines, directory = None, f"{uuid.uuid4().hex}.idx", 0, [], []

        def block():
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            directory.append([json.loads(lines[0])[0], json.loads(lines[-1])[0], at, len(data)])
            out.write(data)
            at, lines = at + len(data), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                lines.append(json.dumps(row))
                if len(lines) == BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + len(data).to_bytes(8, "big"))
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "last": [directory[-1][1]], "file": [name]})

    ordered = manifest.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "file", "offset")
    files = written(ordered.mapInArrow(write, "first string, last string, file string"), "index")
    return CaptureIndex(folder, sorted(tuple(r) for r in files.collect()))


def _directory(source) -> list:
    size = source.size()
    n = int.from_bytes(source.read_at(8, size - 8), "big")
    return json.loads(zlib.decompress(source.read_at(n, size - 8 - n)))


def _block(source, at: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(source.read_at(length, at)).decode("utf-8", "surrogatepass").split("\n")]


def find(index: CaptureIndex, key: str) -> list[list]:
    """Manifest rows of all captures of a key, by bisection over directories and blocks."""
    fs, path = file_system_path(index.folder)
    found = []
    for _, _, name in index.top[bisect_left(index.top, key, key=lambda t: t[1]):bisect_right(index.top, key, key=lambda t: t[0])]:
        with fs.open_input_file(f"{path}/{name}") as source:
            directory = _directory(source)
            for _, _, at, length in directory[bisect_left(directory, key, key=lambda b: b[1]):bisect_right(directory, key, key=lambda b: b[0])]:
                lines = _block(source, at, length)
                found += lines[bisect_left(lines, key, key=lambda x: x[0]):bisect_right(lines, key, key=lambda x: x[0])]
    return found


def lookup(index: CaptureIndex, urls: DataFrame, url: str = "url") -> DataFrame:
    """(url, and what ``read_records`` gives) for every capture of every row's URL; rows without a capture give none."""

    def search(batches):
        for batch in batches:
            got = [(u, *row) for u, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in find(index, k)]
            names = ["asked", *(c.split()[0] for c in MANIFEST.split(", "))]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            cols = list(zip(*got)) if got else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    asked = urls.select(F.col(url).alias("u"), url_key(F.col(url)).alias("k"))
    return asked.mapInArrow(search, "asked string, " + MANIFEST)


class IndexFile:
    """One index file, asked for keys in ascending order: its directory is read once, and each block that holds a key once."""

    def __init__(self, fs, path: str):
        self.source = fs.open_input_file(path)
        self.directory = _directory(self.source)
        self.firsts, self.lasts = [b[0] for b in self.directory], [b[1] for b in self.directory]
        self.held, self.lines, self.keys, self.blocks_read = -1, [], [], 0

    def captures(self, key: str) -> Iterator[list]:
        """Manifest rows of a key: the directory is bisected for blocks, a block for lines."""
        for i in range(bisect_left(self.lasts, key), bisect_right(self.firsts, key)):
            if i != self.held:
                _, _, at, length = self.directory[i]
                self.held, self.lines = i, _block(self.source, at, length)
                self.keys = [x[0] for x in self.lines]
                self.blocks_read += 1
            yield from self.lines[bisect_left(self.keys, key):bisect_right(self.keys, key)]


def captures_of(index: CaptureIndex, keys: DataFrame, key: str = "key") -> DataFrame:
    """Manifest rows of all captures of the distinct keys: the top directory is bisected for index files, whose keys are sorted,
    so that a task reads the directory and the blocks it needs once. A key with many captures lies in many files."""
    firsts, lasts = [t[0] for t in index.top], [t[1] for t in index.top]
    names = [c.split()[0] for c in MANIFEST.split(", ")]

    def files(batches):
        for batch in batches:
            asked = batch.column(0).to_pylist()
            got = [(no, k) for k in asked for no in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int32()), pa.array([k for _, k in got], pa.string())], names=["no", "k"])

    def rows(batches):
        fs, path = file_system_path(index.folder)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        now, file = None, None
        for batch in batches:
            found = []
            for no, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if no != now:
                    now, file = no, IndexFile(fs, f"{path}/{index.top[no][2]}")
                for row in file.captures(k):
                    found.append(row)
                    if len(found) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)
                        found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

    distinct = keys.select(F.col(key).alias("k")).filter(F.col("k").isNotNull()).distinct()
    # bisection compares as Python does: by code points, the order in which the index was written
    sent = distinct.mapInArrow(files, "no int, k string").repartitionByRange(max(1, len(index.top)), "no").sortWithinPartitions("no", "k")
    return sent.mapInArrow(rows, MANIFEST)


def read_records(entries: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, url, (payload)) from the archives' byte ranges.

    A response's digest is computed anew from what was read; one that differs from the record's header raises an error.
    """
    kinds = "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payload

    def read(batches):
        fs, path = file_system_path(folder)
        name, source, data, start = None, None, b"", 0
        for batch in batches:
            out = []
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            for i, (f, at, length) in enumerate(zip(files, offsets, lengths)):
                if f != name:
                    source = fs.open_input_file(f"{path}/{f}")
                    name, data, start = f, b"", 0
                if at < start or at + length > start + len(data):
                    end, j = at + length, i + 1  # records that lie beside it come with the same read
                    while j < len(files) and files[j] == f and offsets[j] == end and end - at < READ_BYTES:
                        end, j = end + lengths[j], j + 1
                    data, start = source.read_at(end - at, at), at
                rec = parse(zlib.decompress(data[at - start:at - start + length], 31))
                digest = rec["warc-payload-digest"].removeprefix("sha1:")
                kind, refers = rec["warc-type"], rec.get("warc-refers-to-page-id")
                if kind == "response" and (sha1_base32(rec["payload"]) != digest or len(rec["payload"]) != rec["payload_length"]):
                    raise ValueError(f"damaged record at {at} of {f}")
                own = rec.get("warc-page-id")
                out.append((own and int(own), rec["payload_length"], digest, kind, refers and int(refers), rec["warc-target-uri"], *[rec["payload"]] * payload))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][:6 + payload]
            cols = list(zip(*out)) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=[c.split()[0] for c in kinds.split(", ")])

    placed = entries.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, kinds)


def archive_round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the archives and their index and reads every record back: the pages' keys are resolved through the bisected
    index, the records of their captures by range reads. Runs jobs.

    Per row of ``pages``: id, payload_bytes, payload_digest, record_type, refers_to, url. Null pages have empty payloads,
    a null URL is read back as ''; rows that repeat an id have a record each, responses all if the id is the smallest. Pages
    of any length are archived whole. An empty table has no archive and gives no rows. Columns beyond the three are ignored.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, id, url, html, least)
    index = build_index(manifest, folder)
    asked = pages.select(url_key(pages[url]).alias("key"))
    return read_records(captures_of(index, asked), folder).withColumnRenamed("id", id)
