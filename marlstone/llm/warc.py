"""WARC archives of web pages and a two-level index of their captures.

Pages are range-partitioned by reversed-host URL key, so archives, index blocks and directories all
follow key order. Each task writes one archive of separately compressed records and one index file:
compressed blocks of captures, then a sparse directory with the first key of each block. A lookup
finds the archive part by its key range, binary-searches that part's directory, decompresses one
block, binary-searches it and reads the record by range.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import Scratch, map_batches
from marlstone.llm.streamed import with_top

#: Captures in an index block.
BLOCK_CAPTURES = 256
#: Payloads from this size on are stored once; equal ones become revisits.
MIN_SHARED = 1000
#: Every record bears this date, so that the same pages give the same archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Most archive parts whose key ranges are broadcast (a part is what one task wrote).
MAX_PARTS = 200_000
_NONE = "-"


def url_key(url: Column) -> Column:
    """Reversed host, closing bracket, path and query: com,example)/a?b. Null becomes empty."""
    clean = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"\s", "%20")
    shape = r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(?i:www\.)?([^/?#:]*)(?::\d*)?([^#]*)"
    host = F.lower(F.regexp_extract(clean, shape, 1))
    return F.when(host == "", clean).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(clean, shape, 2)))


def _record(kind: str, page: str, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}')}>"
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {page}", f"X-Payload-Length: {len(payload)}"]
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers)}", f"X-Refers-To-Page-ID: {refers}"]
    else:
        body += payload
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(body)}"])
    return head.encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one decompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


@lru_cache(maxsize=4)
def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """One archive and one index file; a row about them. A retried task writes files of other names."""
    store, base = _filesystem(folder)
    name = f"{base}/part-{uuid.uuid4().hex}"
    warc = index = None
    block: list[str] = []
    directory: list[list] = []
    at = index_at = captures = 0
    first = last = None
    mark = None

    def flush() -> None:
        nonlocal index_at
        packed = zlib.compress("\n".join(block).encode(), 6)
        directory.append([block[0].split(" ", 1)[0], index_at, len(packed)])
        index.write(packed)
        index_at += len(packed)
        block.clear()

    for batch in batches:
        for key, page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("key", "page", "url", "html", "digest", "refers"))):
            if refers is not None:
                mark = (key, digest, refers)
                continue
            if warc is None:
                store.create_dir(base, recursive=True)
                warc, index = store.open_output_stream(f"{name}.warc.gz", compression=None), store.open_output_stream(f"{name}.cdx", compression=None)
                first = key
            payload = (payload or "").encode()
            to = mark[2] if mark and mark[:2] == (key, digest) else None
            deflate = zlib.compressobj(6, wbits=31)
            member = deflate.compress(_record("revisit" if to is not None else "response", page, url or "", payload, digest, to)) + deflate.flush()
            warc.write(member)
            block.append(f"{key} {at} {len(member)}")
            at, captures, last = at + len(member), captures + 1, key
            if len(block) == BLOCK_CAPTURES:
                flush()
    if warc is None:
        return
    if block:
        flush()
    packed = zlib.compress(json.dumps(directory).encode(), 6)
    index.write(packed)
    warc.close()
    index.close()
    yield pa.RecordBatch.from_pydict({"first": [first], "last": [last], "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "directory_at": [index_at], "directory_size": [len(packed)], "captures": [captures]})


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive pages below folder (a URI all executors share); rows about the parts written.

    Columns: first and last (capture keys), path (add .warc.gz or .cdx), directory_at,
    directory_size, captures. A capture key is the URL key, a space-free page id behind it; null
    ids are '-', null URLs empty, null payloads empty. Of equal payloads of MIN_SHARED bytes or
    more the record of the largest id is the response and the others are revisits; pages without
    an id, and rows that repeat the largest id, are responses. Reading the result writes the files.
    """
    page = F.coalesce(F.col(id_col).cast("string"), F.lit(_NONE))
    digest = F.sha1(F.coalesce(F.col(html_col), F.lit("")).cast("binary"))
    key = F.concat(url_key(F.col(url_col)), F.lit("#"), page).alias("key")
    large = pages.where((F.octet_length(html_col) >= MIN_SHARED) & F.col(id_col).isNotNull()).select(digest.alias("digest"), F.col(id_col).alias("id"), key)
    revisits = with_top(large, ["digest"], "id", 2).where(F.col("id") < F.col("top"))
    null = F.lit(None).cast("string")
    marks = revisits.select("key", null.alias("page"), null.alias("url"), null.alias("html"), "digest", F.col("top").cast("string").alias("refers"), F.lit(0).alias("kind"))
    own = pages.select(key, page.alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), digest.alias("digest"), null.alias("refers"), F.lit(1).alias("kind"))
    ordered = marks.union(own).repartitionByRange("key").sortWithinPartitions("key", "digest", "kind")
    return map_batches(ordered, lambda it: _write(it, folder), "first string, last string, path string, directory_at bigint, directory_size bigint, captures bigint")


class Reader:
    """Lookups in the parts (first, last, path, directory_at, directory_size), which are in key order."""

    def __init__(self, parts: list[tuple]):
        self.parts = parts
        self.firsts = [p[0] for p in parts]
        self.files: dict[str, object] = {}
        self.directory = lru_cache(maxsize=64)(self._directory)
        self.block = lru_cache(maxsize=64)(self._block)

    def _range(self, path: str, at: int, size: int) -> bytes:
        if path not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            store, plain = _filesystem(path)
            self.files[path] = store.open_input_file(plain)
        return self.files[path].read_at(size, at)

    def _directory(self, part: int) -> tuple[list[str], list[list]]:
        _, _, path, at, size = self.parts[part]
        rows = json.loads(zlib.decompress(self._range(f"{path}.cdx", at, size)))
        return [r[0] for r in rows], rows

    def _block(self, part: int, number: int) -> tuple[list[str], list[tuple[int, int]]]:
        _, at, size = self.directory(part)[1][number]
        rows = [line.rsplit(" ", 2) for line in zlib.decompress(self._range(f"{self.parts[part][2]}.cdx", at, size)).decode().split("\n")]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def find(self, key: str) -> Iterator[tuple[dict[str, str], bytes]]:
        """All records with this capture key."""
        part = max(bisect.bisect_left(self.firsts, key) - 1, 0)  # equal keys may run over parts and blocks
        while part < len(self.parts) and self.firsts[part] <= key:
            firsts, rows = self.directory(part)
            number = max(bisect.bisect_left(firsts, key) - 1, 0)
            while number < len(rows) and firsts[number] <= key:
                keys, places = self.block(part, number)
                for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                    yield parse(zlib.decompress(self._range(f"{self.parts[part][2]}.warc.gz", *places[i]), wbits=31))
                number += 1
            part += 1


def _look_up(batches: Iterator[pa.RecordBatch], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    reader = Reader(parts)
    for batch in batches:
        out: dict[str, list] = {"key": [], "page": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": []}
        for key in batch.column("key").to_pylist():
            for fields, payload in reader.find(key):
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"archived payload of page {fields['X-Page-ID']} doesn't have the digest of its header")
                for column, value in zip(out.values(), (key, fields["X-Page-ID"], size, digest, fields["WARC-Type"], fields.get("X-Refers-To-Page-ID"))):
                    column.append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.string()), ("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]))


def capture_keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    return pages.select(F.concat(url_key(F.col(url_col)), F.lit("#"), F.coalesce(F.col(id_col).cast("string"), F.lit(_NONE))).alias("key"))


def look_up(parts: DataFrame, keys: DataFrame) -> DataFrame:
    """The archived records of each distinct capture key, read back through the index.

    Columns: key, page, payload_bytes, payload_digest, record_type, refers_to; no row for a key
    that isn't archived, one for each capture of it else. Payloads of responses are checked
    against their digests. Key ranges of the parts are broadcast: one row for each task that
    wrote, MAX_PARTS at most.
    """
    known = parts.orderBy("first", "last").limit(MAX_PARTS + 1).collect()
    if len(known) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} archive parts; write them in fewer partitions")
    shared = parts.sparkSession.sparkContext.broadcast([(r["first"], r["last"], r["path"], r["directory_at"], r["directory_size"]) for r in known])
    # A task for each part: its records are read from the archive, which weighs far more than the keys.
    ordered = keys.distinct().repartitionByRange(max(1, len(known)), "key").sortWithinPartitions("key")
    return map_batches(ordered, lambda it: _look_up(it, shared.value), "key string, page string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write an archive of pages in the shared folder and read every capture back through its index."""
    scratch = Scratch(pages.sparkSession, "warc")
    parts = scratch.write(write(pages, scratch.path("archive"), id_col, url_col, html_col), "parts")
    return look_up(parts, capture_keys(pages, id_col, url_col))
