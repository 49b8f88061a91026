"""WARC archives with a two-level capture index: sorted, compressed blocks of keys under a sparse directory."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.shared import cut, fresh_path, prepare

#: Bytes from which equal payloads are stored once; captures of an index block; the date of written records.
REVISIT_BYTES, BLOCK_CAPTURES, DATE = 1000, 256, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL, OPEN_FILES = 4, 32
INDEX = "key string, file string, offset long, length long"


def store(uri: str):
    """(file system, path) of a folder or file that executors share: any address that pyarrow knows, file: included."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def reversed_host(url: str | None) -> str:
    """The sort key of an address: host labels reversed, then path and query (com,example,www)/a?b; null is empty."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url
    rest = parts.path + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + (rest or "/")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Reversed-host key and page: what the index sorts by."""
    return f"{reversed_host(url)} {'' if page_id is None else page_id}".replace("\n", "%0A").replace("\t", "%09").replace("\x00", "%00")


def key_column(url: str, page_id: str) -> Column:
    @F.pandas_udf("string")
    def key(url: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u if isinstance(u, str) else None, None if pd.isna(p) else int(p)) for u, p in zip(url, page_id, strict=True)])

    # As text: a column of longs with nulls would come as floating-point numbers.
    return key(F.col(url), F.col(page_id).cast("string"))


def record(url: str | None, page_id: int | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record, response or (with refers_to) revisit, as a gzip member of its own."""
    name = lambda p: f"<urn:page:{'' if p is None else p}>"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[].-_')}"] if url else []
    head += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    whole = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


@dataclass
class Capture:
    """A record as read back. payload is None for a revisit; length and digest are those of the full payload."""

    page_id: int | None
    url: str | None
    kind: str
    refers_to: int | None
    length: int
    digest: str
    payload: bytes | None


def parse(member: bytes) -> Capture:
    """A record of a gzip member; raises ValueError where lengths or digest don't fit."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(":")[2]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")]
    page = lambda v: int(v) if (v := v.removeprefix("<urn:page:").removesuffix(">")) else None
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != sizes[0]):
        raise ValueError("a payload's digest is wrong")
    return Capture(page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, sizes[0], digest, payload if kind == "response" else None)


class Files:
    """Range reads over a few files that stay open."""

    def __init__(self):
        self.open: OrderedDict[str, object] = OrderedDict()

    def read(self, uri: str, offset: int, length: int) -> bytes:
        f = self.open.pop(uri, None)
        if f is None:
            fs, path = store(uri)
            f = fs.open_input_file(path)
        self.open[uri] = f
        if len(self.open) > OPEN_FILES:
            self.open.popitem(last=False)[1].close()
        return f.read_at(length, offset)

    def size(self, uri: str) -> int:
        fs, path = store(uri)
        return fs.get_file_info(path).size


def digest_column() -> Column:
    return F.sha1(F.coalesce("html", F.lit("")).cast("binary"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages with refers_to: of the rows of one payload of REVISIT_BYTES or more, the largest page_id is stored and the others refer to it.

    Only ids and digests are grouped and joined by payload; the page moves once at most, by its own id.
    """
    keys = pages.select("page_id", digest_column().alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= REVISIT_BYTES)
    several = cut(keys.groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1 and target is not null").select("digest", "target"), "copies")
    refers = keys.join(several, "digest").where(F.coalesce(F.col("page_id") < F.col("target"), F.lit(True)))
    refers = cut(refers.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("target").alias("refers_to")).distinct(), "revisits")
    same = pages.page_id.eqNullSafe(F.col("_page")) & (digest_column() == F.col("_digest"))
    return pages.join(refers, same, "left").select(pages.page_id, pages.url, pages.html, "refers_to")


def write_archives(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html, refers_to) as WARC files, one a task, into folder; (key, file, offset, length) of each record.

    A task that runs again writes a file of its own name; only files of tasks that ended are in the result.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        at = TaskContext.get()
        name = f"part-{at.partitionId():05d}-{at.taskAttemptId()}.warc.gz"
        number, whole = lambda v: int(v) if isinstance(v, str) else None, 0
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                rows = []
                for page, url, html, target in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                    url = url if isinstance(url, str) else None
                    member = record(url, number(page), html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b"", number(target))
                    out.write(member)
                    rows.append((capture_key(url, number(page)), f"{folder}/{name}", whole, len(member)))
                    whole += len(member)
                yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return cut(rows.mapInPandas(write, INDEX), "captures")


def write_index(spark: SparkSession, captures: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """Sort captures into index files under folder; (first key, last key, file) of each, in key order.

    An index file is a row of zlib blocks of BLOCK_CAPTURES captures, then the directory (each block's first key, offset and length),
    then the directory's offset and length. What is returned grows with the number of index files, not of captures.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        at = TaskContext.get()
        name = f"index-{at.partitionId():05d}-{at.taskAttemptId()}.cdx"
        directory: list[tuple[str, int, int]] = []
        block: list[tuple] = []
        state = {"at": 0, "first": None, "last": None}
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:

            def flush() -> None:
                data = zlib.compress("\n".join("\t".join(map(str, r)) for r in block).encode("utf-8", "surrogatepass"), LEVEL)
                out.write(data)
                directory.append((block[0][0], state["at"], len(data)))
                state["at"] += len(data)
                block.clear()

            for batch in batches:
                for row in batch.itertuples(index=False):
                    state["first"] = row[0] if state["first"] is None else state["first"]
                    state["last"] = row[0]
                    block.append(tuple(row))
                    if len(block) == BLOCK_CAPTURES:
                        flush()
            if block:
                flush()
            table = zlib.compress(json.dumps(directory).encode())
            out.write(table + struct.pack("<QQ", state["at"], len(table)))
        if directory:
            yield pd.DataFrame([(state["first"], state["last"], f"{folder}/{name}")], columns=["first", "last", "file"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key").sortWithinPartitions("key", "file", "offset")
    found = cut(ordered.mapInPandas(write, "first string, last string, file string"), "index").collect()
    return sorted(((r.first, r.last, r.file) for r in found), key=lambda r: (r[0].encode("utf-8", "surrogatepass"), r[1].encode("utf-8", "surrogatepass")))


class CaptureIndex:
    """Look up keys: binary search over the index files, over a file's directory, and within one block."""

    def __init__(self, parts: list[tuple[str, str, str]]):
        self.parts = [(a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass"), f) for a, b, f in parts]
        self.lasts = [b for _, b, _ in self.parts]
        self.files, self.directories, self.blocks = Files(), OrderedDict(), OrderedDict()

    def directory(self, file: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        if file not in self.directories:
            size = self.files.size(file)
            offset, length = struct.unpack("<QQ", self.files.read(file, size - 16, 16))
            rows = json.loads(zlib.decompress(self.files.read(file, offset, length)))
            self.directories[file] = ([r[0].encode("utf-8", "surrogatepass") for r in rows], [(r[1], r[2]) for r in rows])
            if len(self.directories) > OPEN_FILES:
                self.directories.popitem(last=False)
        return self.directories[file]

    def block(self, file: str, place: tuple[int, int]) -> tuple[list[bytes], list[list[str]]]:
        if (file, place) not in self.blocks:
            text = zlib.decompress(self.files.read(file, *place)).decode("utf-8", "surrogatepass")
            rows = [line.split("\t") for line in text.split("\n")]
            self.blocks[file, place] = ([r[0].encode("utf-8", "surrogatepass") for r in rows], rows)
            if len(self.blocks) > 4:
                self.blocks.popitem(last=False)
        return self.blocks[file, place]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of each capture of key."""
        want = key.encode("utf-8", "surrogatepass")
        for k in range(bisect.bisect_left(self.lasts, want), len(self.parts)):
            first, _, file = self.parts[k]
            if first > want:
                break
            firsts, places = self.directory(file)
            for b in range(max(0, bisect.bisect_left(firsts, want) - 1), len(places)):
                if firsts[b] > want:
                    break
                keys, rows = self.block(file, places[b])
                for r in rows[bisect.bisect_left(keys, want) : bisect.bisect_right(keys, want)]:
                    yield r[1], int(r[2]), int(r[3])


CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def look_up(spark: SparkSession, keys: DataFrame, parts: list[tuple[str, str, str]], text: bool = False) -> DataFrame:
    """The captures of the distinct keys (column key): the record of each, by range reads from its archive. text: also the payload."""
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("key").distinct().repartitionByRange(count, "key").sortWithinPartitions("key")
    names = [c.split()[0] for c in CAPTURE.split(", ")] + ["payload"] * text

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, archives = CaptureIndex(parts), Files()
        for batch in batches:
            rows = []
            for key in batch["key"]:
                for place in index.find(key):
                    c = parse(archives.read(*place))
                    rows.append((c.page_id, c.url, c.length, c.digest, c.kind, c.refers_to, c.payload)[: len(names)])
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    return ordered.mapInPandas(read, CAPTURE + ", payload binary" * text)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html; other columns are ignored) to WARC archives, index them, and read all of them back.

    Returns page_id, url (as the record has it: percent-encoded), payload_bytes, payload_digest (SHA-1, hex, of the full payload),
    record_type and refers_to as the records have them, one row a page. Rows without page_id share the key of their url, which one task reads. A null html is an empty payload, a null url has the empty key; a row without page_id is stored
    as such, and never refers or is referred to unless its payload has another row with an id. Rows repeated in full are all
    records, with equal results. An empty table gives no rows. Archives and index stay in the shared folder.
    """
    prepare(spark)
    folder = folder or fresh_path(spark, "archive")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    captures = write_archives(spark, with_revisits(base), f"{folder}/warc")
    parts = write_index(spark, captures, f"{folder}/index")
    return look_up(spark, base.select(key_column("url", "page_id").alias("key")), parts)


#: DuckDB: what op9 returns.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < target THEN target END AS refers_to
FROM m
"""
