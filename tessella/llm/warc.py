"""WARC archives with a two-level capture index.

Writing: every partition writes archives of gzip members, one record each, and the captures' places.
Of pages with equal payloads of ``LEAST`` bytes or more, those with the smallest id become responses;
the others become revisit records, which hold headers only and refer to the first of them. Every row gets a
number when the pages are read; record ids are made from it, so that rows of one page id stay apart.

Indexing: captures are range-partitioned and sorted by reversed-host URL key, page id and place. Each partition
becomes one index file: gzip blocks of ``BLOCK_LINES`` lines, then a directory with the first key and place
of each block, then the directory's place. What the driver holds is the first key of each index file: as
many entries as partitions, whatever the number of captures.

Reading: a key is searched in the list of files, then in one file's directory, then its block is read by
range and searched, and the record by range again. Bulk look-ups are sorted by key first, so that each
directory and block is read once, and records are read in the order of their places.

Files are opened with pyarrow's file systems (file, hdfs, s3, gs), in the folder that all executors share.
A task names its file at random and hands on only rows of its own file: what lost or repeated attempts
wrote is never read.

Edge cases: a null html is an empty payload; a null url is an empty one; rows with a null page id are
responses and are looked up by null; a look-up gives all captures of a page id and key, so rows with one id
and url come back each with its own payload; repeated urls are captures of one key in the order of their ids.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, materialise

#: Payloads of fewer bytes are never revisits.
LEAST = 100
BLOCK_LINES = 1000
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 1 << 30
#: Records that lie closer than this are read with one range.
GAP = 1 << 16
SPAN = 1 << 22
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def url_key(url: str) -> str:
    """Reversed-host key: ``http://www.a.example:80/b?z&y#f`` becomes ``example,a)/b?y&z``."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip(), flags=re.I).partition("#")[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    host = re.sub(r":(80|443)$", "", host.rpartition("@")[2].lower())
    host = re.sub(r"^www\d*\.", "", host)
    name, colon, port = host.partition(":")
    path, mark, query = path.partition("?")
    return ",".join(reversed(name.split("."))) + colon + port + ")/" + path + (("?" + "&".join(sorted(query.split("&")))) if query else "")


def record_id(page_id: int | None, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{number}')}>"


def _when(page_id: int | None) -> str:
    """A capture time that depends on the page only."""
    return datetime.fromtimestamp(1_700_000_000 + (page_id or 0) % 10_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def make_record(page_id: int | None, number: int, url: str, payload: bytes, digest: str, refers_to: tuple[int, int] | None) -> bytes:
    """One gzip member with a response record, or a revisit record that refers to a page id and row number."""
    size = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, number), "WARC-Date": _when(page_id), "WARC-Target-URI": re.sub(r"[\r\n]", "", url)}
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(size), "Content-Type": "application/http;msgtype=response"}
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(*refers_to), "X-Refers-To-Page": str(refers_to[0])}
    block = http if refers_to is not None else http + payload
    head["Content-Length"] = str(len(block))
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (empty for revisits); the payload is held against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    return fields, payload


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to ``folder``; the captures: key, page_id, file, place, size, kind."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    # Written, as a row's number must stay the same whenever the row is read.
    pages = materialise(pages.withColumn("number", F.monotonically_increasing_id()), "pages")
    big = pages.where(F.octet_length("html") >= LEAST)
    firsts = materialise(big.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "number"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.number").alias("first_number")), "firsts")
    dealt = pages.join(firsts, "digest", "left").select("page_id", "number", "url", "html", "digest", "first_id", "first_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        out, name, place = None, "", 0
        try:
            for batch in batches:
                fs.create_dir(root, recursive=True)
                rows = []
                for page, number, url, html, digest, first, first_number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or place >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    kind = "revisit" if first is not None and page is not None and first != page else "response"
                    member = make_record(page, number, url, html.encode(), digest, (first, first_number) if kind == "revisit" else None)
                    out.write(member)
                    rows.append((url_key(url), page, name, place, len(member), kind))
                    place += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "page_id", "file", "place", "size", "kind"]) if rows else batch.slice(0, 0)
        finally:
            if out is not None:
                out.close()

    return materialise(dealt.mapInArrow(run, "key string, page_id bigint, file string, place bigint, size bigint, kind string"), "captures")


def _order(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """Spark's ascending order of key and page id: nulls first."""
    return key, page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, int | None, str]]:
    """Write the two-level index to ``folder``; first key, first page id and name of each of its files, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        name, out, place, lines, directory = f"{uuid.uuid4().hex}.cdx.gz", None, 0, [], []

        def block() -> None:
            nonlocal place
            body = zlib.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode(), 6)
            out.write(body)
            directory.append([lines[0][0], lines[0][1], place, len(body)])
            place += len(body)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            body = zlib.compress(json.dumps(directory, ensure_ascii=False).encode())
            out.write(body + struct.pack("<QQ", place, len(body)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name]), pa.array([TaskContext.get().partitionId()], pa.int32())], ["key", "page_id", "name", "part"])

    by = ("key", "page_id", "file", "place")
    spread = captures.repartitionByRange(*by).sortWithinPartitions(*by)
    files = materialise(spread.mapInArrow(run, "key string, page_id bigint, name string, part int"), "index")
    # One row for each index file: as many as partitions. Files that begin with captures of one pair lie in the order of their ranges.
    return [(r.key, r.page_id, r.name) for r in sorted(files.collect(), key=lambda r: (*_order(r.key, r.page_id), r.part))]


class IndexReader:
    """Looks up captures by key and page id; keeps the directory and block it read last."""

    def __init__(self, folder: str, files: list[tuple[str, int | None, str]]) -> None:
        (self.fs, self.root), self.files = _opened(folder), files
        self.firsts = [_order(*f[:2]) for f in files]
        self.name, self.open, self.directory, self.starts, self.at, self.block = "", None, [], [], -1, {}

    def files_of(self, key: str, page_id: int | None) -> range:
        """The files that may hold a pair: captures of one pair can go on from file to file."""
        wanted = _order(key, page_id)
        last = max(0, bisect.bisect_right(self.firsts, wanted) - 1)
        return range(min(last, max(0, bisect.bisect_left(self.firsts, wanted) - 1)), last + 1)

    def find(self, key: str, page_id: int | None) -> tuple[str, int, int, str] | None:
        """Archive, place, size and kind of a pair's first capture, or None."""
        return next((x for n in self.files_of(key, page_id) for x in self.find_all(n, key, page_id)), None)

    def find_all(self, part: int, key: str, page_id: int | None) -> Iterator[tuple[str, int, int, str]]:
        """Archive, place, size and kind of all captures of a pair in one file."""
        if not self.files:
            return
        name = self.files[part][2]
        if name != self.name:
            if self.open is not None:
                self.open.close()
            self.name, self.at, self.open = name, -1, self.fs.open_input_file(f"{self.root}/{name}")
            size = self.open.size()
            place, length = struct.unpack("<QQ", self.open.read_at(16, size - 16))
            self.directory = json.loads(zlib.decompress(self.open.read_at(length, place)))
            self.starts = [_order(*d[:2]) for d in self.directory]
        wanted = _order(key, page_id)
        # A pair that begins a block may have captures at the end of the one before.
        at = max(0, bisect.bisect_left(self.starts, wanted) - 1)
        while at < len(self.starts) and self.starts[at] <= wanted:
            if at != self.at:
                place, length = self.directory[at][2:]
                # Only the line feed parts lines: other separators stand inside of texts.
                lines = zlib.decompress(self.open.read_at(length, place)).decode().split("\n")
                self.at, self.block = at, {}
                for x in map(json.loads, filter(None, lines)):
                    self.block.setdefault((x[0], x[1]), []).append(tuple(x[2:]))
            yield from self.block.get((key, page_id), ())
            at += 1


def look_up(wanted: DataFrame, folder: str, files: list[tuple[str, int, str]]) -> DataFrame:
    """page_id, file, place, size, kind of all captures of each distinct pair of ``wanted(page_id, url)``; places are null where nothing was captured."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder, files)
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), [url_key(u or "") for u in b.column(1).to_pylist()], strict=True)
            rows = [(n, i, k, len(parts) == 1) for i, k in pairs for parts in (reader.files_of(k, i),) for n in parts]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.string(), pa.bool_()))], ["part", "page_id", "key", "only"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder, files)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["page_id", "file", "place", "size", "kind"])
            rows.clear()
            return made

        for b in batches:
            for n, i, k, only in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = False
                for capture in reader.find_all(n, k, i):
                    found = True
                    rows.append((i, *capture))
                    if len(rows) >= 10_000:
                        yield out()
                if only and not found:
                    rows.append((i, None, None, None, None))
            if rows:
                yield out()

    # Urls of one key are one pair.
    parts = wanted.select(F.col("page_id").cast("long").alias("page_id"), "url").distinct().mapInArrow(keys, "part int, page_id bigint, key string, only boolean").distinct()
    return parts.repartitionByRange("part", "key", "page_id").sortWithinPartitions("part", "key", "page_id").mapInArrow(find, "page_id bigint, file string, place bigint, size bigint, kind string")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """page_id, payload, payload_bytes, payload_digest, record_type, refers_to of captures, by range reads in file order.

    payload is null for revisits; their size and digest are what their headers say of the full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        name, source, span, held = None, None, 0, b""
        for b in batches:
            rows = []
            wanted = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for k, (page, file, place, size) in enumerate(wanted):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source, span, held = file, fs.open_input_file(f"{root}/{file}"), 0, b""
                if not (span <= place and place + size <= span + len(held)):
                    end = place + size
                    for _, f, p, s in wanted[k + 1 :]:
                        if f != file or p < end - s or p > end + GAP or p + s - place > SPAN:
                            break
                        end = max(end, p + s)
                    span, held = place, source.read_at(end - place, place)
                fields, payload = read_record(held[place - span : place - span + size])
                kind = fields["WARC-Type"]
                if fields.get("X-Page-ID") != (None if page is None else str(page)):
                    raise ValueError(f"the index leads page {page} to another record")
                rows.append((page, payload.decode() if kind == "response" else None, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), kind, int(fields["X-Refers-To-Page"]) if kind == "revisit" else None))
                if kind == "response" and len(payload) != rows[-1][2]:
                    raise ValueError(f"page {page} has another length than its record says")
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ordered = places.where("file is not null").select("page_id", "file", "place", "size").repartitionByRange("file", "place").sortWithinPartitions("file", "place")
    return ordered.mapInArrow(run, "page_id bigint, payload string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives and index of ``pages``, then look every page up and read its record back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives")
    files = write_index(captures, f"{folder}/index")
    places = materialise(look_up(pages, f"{folder}/index", files), "places")
    return read_records(places, f"{folder}/archives")
