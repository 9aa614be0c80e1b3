"""WARC archives with a two-level capture index.

Pages are dealt out by range of their reversed-host URL key, so each task
writes one archive in key order: a gzip member for each record, after one that
describes the archive.  Beside it lies
its index: the sorted lines ``key page_id archive offset length`` in compressed
blocks of ``LINES`` lines, and a sparse directory with the first key of each
block, its offset and its length.  A lookup searches the directory, then the
lines of the blocks, then reads the byte range of the record.

Equal payloads (SHA-1 and length) of at least ``min_bytes`` are stored once:
the record of the smallest page id is a response, the others are revisits that
name it and keep the HTTP header, so digest and size of the full payload stay
known.

Defined results: a null url has the empty key; a null html is the empty
payload; rows that repeat the smallest page id of a payload are all responses;
a null page id sorts after all others and is written as ``-``; rows that are
alike get records of their own, told apart by a number; an empty table makes no
archive and no rows; a payload of any length is one record; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_session, cut, input_bytes, shared_dir, tidy
from .token_store import filesystem

#: Index lines of a compressed block.
LINES = 256
#: Bytes of input for each archive, about.
ARCHIVE_BYTES = 16 << 20
#: Ways into which the pages of one payload are dealt.
SALTS = 16
_DATE = "2024-01-01T00:00:00Z"


def url_key(col: str | Column) -> Column:
    """The reversed host, then ``)`` and the rest of a URL: ``com,example,www)/path``."""
    url = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    rest = F.regexp_replace(url, r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    port = F.regexp_extract(host, r"(:[0-9]*)$", 1)
    name = F.regexp_replace(host, r":[0-9]*$", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#.*$", "")
    key = F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), path)
    return F.when(url == "", "").otherwise(key)


def key_of(url: str | None) -> str:
    """``url_key`` of one URL."""
    if not url:
        return ""
    rest = re.sub(r"^[^:/?#]*://", "", url)
    host = re.match(r"[^/?#]*", rest)[0]
    name, port = re.match(r"(.*?)(:[0-9]*)?$", host.lower(), re.S).groups()
    path = re.sub(r"#.*$", "", rest[len(host) :])
    return ",".join(reversed(name.split("."))) + (port or "") + ")" + path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, key: str, sha: str, nth: int = 0) -> str:
    """The name of a record: its page, a hash of key and payload, and which of such rows it is."""
    name = "-" if page_id is None else str(page_id)
    return f"urn:page:{name}:{zlib.crc32(f'{key} {sha}'.encode()):08x}.{nth}"


def describing(name: str) -> bytes:
    """The record that describes an archive."""
    block = b"software: gridweave\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {_DATE}", f"WARC-Filename: {name}.warc.gz", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(name: str, url: str | None, payload: bytes, sha: str, refers_to: str | None) -> bytes:
    """One WARC record, not compressed; ``name`` and ``refers_to`` are record ids."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def _page(urn: str) -> int | None:
    name = urn.split(":")[2]
    return None if name == "-" else int(name)


class IndexWriter:
    """Sorted lines in compressed blocks, and the directory of the blocks."""

    def __init__(self) -> None:
        self.blocks, self.directory, self.lines, self.at = [], [], [], 0

    def add(self, key: str, page_id: int | None, archive: str, offset: int, length: int) -> None:
        self.lines.append(json.dumps([key, page_id, archive, offset, length]))
        if len(self.lines) == LINES:
            self.flush()

    def flush(self) -> None:
        if self.lines:
            block = zlib.compress("\n".join(self.lines).encode())
            self.directory.append([json.loads(self.lines[0])[0], self.at, len(block)])
            self.blocks.append(block)
            self.at += len(block)
            self.lines = []


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name = f"pages-{uuid.uuid4().hex}"  # of this attempt only
        index, sink, at, n, first, last = IndexWriter(), None, 0, 0, None, None
        known: tuple = (None, None, None, None)
        same, nth = None, 0
        for batch in batches:
            for page_id, url, html, key, sha, kind, least in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "key", "sha", "kind", "least")), strict=True):
                if kind == 0:
                    known = (key, page_id, sha, least)
                    continue
                least = known[3] if known[:3] == (key, page_id, sha) else None
                same, nth = (key, page_id, sha), nth + 1 if same == (key, page_id, sha) else 0
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
                    first = key
                    raw = gzip.compress(describing(name), 6, mtime=0)
                    sink.write(raw)
                    at = len(raw)
                payload = (html or "").encode()
                refers_to = None if least is None or least["id"] == page_id else record_id(least["id"], least["key"], sha)
                raw = gzip.compress(record(record_id(page_id, key, sha, nth), url, payload, digest(payload), refers_to), 6, mtime=0)
                sink.write(raw)
                index.add(key, page_id, f"{name}.warc.gz", at, len(raw))
                at += len(raw)
                n += 1
                last = key
        if sink is None:
            return
        sink.close()
        index.flush()
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            for block in index.blocks:
                f.write(block)
        with fs.open_output_stream(f"{root}/{name}.dir") as f:
            f.write(json.dumps(index.directory).encode())
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([last]), pa.array([n], pa.int64())], ["name", "first_key", "last_key", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes all pages; returns the manifest: name, first_key, last_key, records."""
    spark = arrow_session(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", url_key("url").alias("key"), F.sha1(payload).alias("sha"))
    # only ids, keys and digests are joined; a payload may be that of a third of all pages, so they are salted
    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), url_key("url").alias("key"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"))
    named = F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id").alias("id"), "key"))
    least = thin.filter(F.col("n") >= min_bytes).groupBy("sha").agg(F.min(named).alias("least"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    thin = thin.withColumn("salt", F.pmod(F.xxhash64("page_id", "key"), F.lit(SALTS)).cast("int")).join(least.hint("shuffle_hash"), ["sha", "salt"])
    # what a page refers to travels ahead of it, so the pages themselves are shuffled once
    ahead = thin.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "key", "sha", F.lit(0).alias("kind"), "least").distinct()
    joined = ahead.unionByName(src.select("*", F.lit(1).alias("kind"), F.lit(None).cast("struct<id:bigint,key:string>").alias("least")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * input_bytes(pages) // ARCHIVE_BYTES)
    order = [F.col("key"), F.col("page_id").asc_nulls_last(), F.col("sha")]
    return cut(joined.repartitionByRange(int(n), *order).sortWithinPartitions(*order, "kind").mapInArrow(_write(folder), "name string, first_key string, last_key string, records long"))


class Archive:
    """One archive with its index; blocks of the index are read as they are asked for."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, self.root = filesystem(folder)
        self.name = name
        with self.fs.open_input_file(f"{self.root}/{name}.dir") as f:
            self.directory = json.loads(f.read())
        self.firsts = [d[0] for d in self.directory]
        self.index = self.fs.open_input_file(f"{self.root}/{name}.idx")
        self.data = self.fs.open_input_file(f"{self.root}/{name}.warc.gz")

        self.kept: tuple[int, list[list]] = (-1, [])

    def block(self, i: int) -> list[list]:
        """The lines of a block; the latest block is kept."""
        if self.kept[0] != i:
            _, at, n = self.directory[i]
            self.index.seek(at)
            self.kept = (i, [json.loads(x) for x in zlib.decompress(self.index.read(n)).decode().split("\n")])
        return self.kept[1]

    def read(self, line: list) -> tuple[dict[str, str], dict[str, str], bytes]:
        self.data.seek(line[3])
        return parse(gzip.decompress(self.data.read(line[4])))

    def find(self, key: str) -> Iterator[list]:
        """Index lines of a key, by binary search of the directory and then of the blocks."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.directory) and self.firsts[i] <= key:
            lines = self.block(i)
            yield from lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]
            i += 1

    def close(self) -> None:
        self.index.close()
        self.data.close()


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                archive = Archive(folder, name)
                before = None
                for i in range(len(archive.directory)):
                    out = []
                    # each key once, also where its lines reach over several blocks
                    keys = [k for k in dict.fromkeys(x[0] for x in archive.block(i)) if k != before]
                    before = keys[-1] if keys else before
                    for line in itertools.chain.from_iterable(map(archive.find, keys)):
                        warc, http, body = archive.read(line)
                        sha, n = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                        if warc["WARC-Type"] == "response":
                            if len(body) != n or digest(body) != sha:
                                raise ValueError(f"record {warc['WARC-Record-ID']} is damaged")
                        refers = warc.get("WARC-Refers-To")
                        out.append((_page(warc["WARC-Record-ID"]), n, sha, warc["WARC-Type"], _page(refers) if refers else None))
                    cols = list(zip(*out, strict=True)) or [[]] * 5
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                archive.close()
        tidy()

    return run


def read_report(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record, each key looked up in the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    names = manifest.select("name").repartition(max(1, min(manifest.count(), 10_000)), "name")
    return names.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(manifest: DataFrame, folder: str, url: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
    """The captures of a URL.  Only archives whose key range holds it are opened."""
    key = key_of(url)
    out = []
    for r in manifest.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("name").toLocalIterator():
        archive = Archive(folder, r[0])
        out += [archive.read(line) for line in archive.find(key)]
        archive.close()
    return out


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives of all pages to the shared folder and reports what they hold."""
    folder = shared_dir(pages.sparkSession)
    return read_report(write_archives(pages, folder, min_bytes), folder)
