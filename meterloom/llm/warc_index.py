"""WARC archives with a two-level capture index.

Each record is a gzip member of its own. The first level of the index holds a line for each capture, sorted by
reversed-host URL key and cut into compressed blocks of LINES lines; the second level is a sparse directory with the first
key and place of every block. A look-up goes to the index shard by the shards' first keys, binary-searches that shard's
directory, reads the range of the block and from its lines the range of the record.
"""
from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import put, store
from .staging import folder, matched, settle, written

LINES = 2000
#: Records with smaller payloads are kept whole however often they repeat.
LEAST_BYTES = 100
NO_ID = (1 << 63) - 1
#: Most bytes and records that a reading task is meant to have.
TASK_BYTES, TASK_RECORDS = 1 << 26, 20_000
ENTRY = "url_key string, page_id long, path string, offset long, length long"
_ID = re.compile(rb"<urn:page:(-?[0-9]+)>")


def url_key(url: Column) -> Column:
    """com,example,www)/path?query: host reversed and in lower case, without scheme, user, port and fragment; what has no
    host is kept behind a bare `)`; null as ``. Blanks and control characters become %20."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, parts, 1))
    rest = F.when(host != "", F.regexp_extract(url, parts, 2)).otherwise(url)
    return F.when(url == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def record(page_id: int, url: str, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One compressed record; a revisit has the headers of the response and no payload."""
    uri = re.sub(r"[\x00-\x20\x7f]", "%20", url or "")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def parse(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of one compressed record."""
    plain = gzip.decompress(packed)
    top, _, rest = plain.partition(b"\r\n\r\n")
    fields = lambda lines: {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines)}
    head = fields(top.split(b"\r\n")[1:])
    http, _, payload = rest[:int(head["content-length"])].partition(b"\r\n\r\n")
    return head, fields(http.split(b"\r\n")[1:]), payload


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html; others are not looked at); returns ENTRY rows.

    The payload is the html in UTF-8, empty if null. Of records with equal payloads of at least LEAST_BYTES bytes the one
    with the smallest page_id is a response, others are revisits that refer to it; smaller ones are all responses. Rows
    that repeat the smallest page_id are responses too. A null page_id counts as greater than others.
    """
    settle(pages.sparkSession)
    path = path.rstrip("/")
    base = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), "url", url_key(F.col("url")).alias("url_key"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    same = base.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("response_id"), F.max("page_id").alias("last_id"))
    same = written(same.where("response_id < last_id").drop("last_id"), "repeated-payloads")
    base = matched(base, same, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("response_id"), F.col("response_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/records-{TaskContext.get().partitionId():06d}.warc.gz"
        keys, ids, offsets, sizes = [], [], [], []

        def records():
            at = 0
            for batch in batches:
                for i, url, key, payload, size, digest, to in zip(*(c.to_pylist() for c in batch.columns)):
                    packed = record(i, url, payload, size, digest, to, date)
                    keys.append(key)
                    ids.append(i)
                    offsets.append(at)
                    sizes.append(len(packed))
                    at += len(packed)
                    yield packed

        put(name, records())
        for k in range(0, len(ids), 4096):
            part = slice(k, k + 4096)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.string()), pa.array(ids[part], pa.int64()), pa.array([name] * len(ids[part]), pa.string()), pa.array(offsets[part], pa.int64()), pa.array(sizes[part], pa.int64())], ["url_key", "page_id", "path", "offset", "length"])

    return written(base.select("page_id", "url", "url_key", "payload", "size", "digest", "refers_to").mapInArrow(run, ENTRY), "captures")


def build(entries: DataFrame, path: str, shards: int | None = None) -> DataFrame:
    """Index the ENTRY rows; returns a row for each shard: its place, first key, number of blocks and of captures."""
    path, n = path.rstrip("/"), shards or max(entries.rdd.getNumPartitions(), 1)

    def run(batches):
        name = f"{path}/captures-{TaskContext.get().partitionId():06d}"
        directory, first, count = [], [None], [0]

        def blocks():
            at, held = 0, []

            def block():
                nonlocal at, held
                packed = gzip.compress("\n".join(held).encode(), 6, mtime=0)
                directory.append(f"{held[0].split(' ', 1)[0]} {at} {len(packed)}")
                at, held = at + len(packed), []
                return packed

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append(" ".join(map(str, row)))
                    first[0] = row[0] if first[0] is None else first[0]
                    count[0] += 1
                    if len(held) == LINES:
                        yield block()
            if held:
                yield block()

        put(f"{name}.cdx.gz", blocks())
        put(f"{name}.idx", ["\n".join(directory).encode()])
        if count[0]:
            yield pa.RecordBatch.from_pydict({"shard": [name], "first_key": [first[0]], "blocks": pa.array([len(directory)], pa.int64()), "captures": pa.array(count, pa.int64())})

    spread = entries.select("url_key", "page_id", F.regexp_extract("path", "[^/]*$", 0), "offset", "length").repartitionByRange(n, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "offset")
    return written(spread.mapInArrow(run, "shard string, first_key string, blocks long, captures long"), "index-shards")


class Shard:
    """The captures of a key, from one index shard."""

    def __init__(self, name: str):
        place, at = store(name)
        with place.open_input_file(f"{at}.idx") as f:
            rows = [line.rsplit(b" ", 2) for line in f.read().split(b"\n") if line]
        self.keys, self.where = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.file, self.held = place.open_input_file(f"{at}.cdx.gz"), (-1, [])

    def block(self, i: int) -> list[list[bytes]]:
        if self.held[0] != i:
            at, size = self.where[i]
            self.held = i, [x.rsplit(b" ", 4) for x in gzip.decompress(self.file.read_at(size, at)).split(b"\n")]
        return self.held[1]

    def captures(self, key: bytes) -> Iterator[list[bytes]]:
        i = max(0, bisect.bisect_left(self.keys, key) - 1)  # a key may begin in the block before
        while i < len(self.keys) and self.keys[i] <= key:
            rows = self.block(i)
            at = bisect.bisect_left(rows, key, key=lambda r: r[0])
            while at < len(rows) and rows[at][0] == key:
                yield rows[at]
                at += 1
            if at < len(rows):
                return
            i += 1


def look_up(keys: DataFrame, index: DataFrame, path: str) -> DataFrame:
    """ENTRY rows of the captures of every distinct `url_key` of `keys`; a null key has none."""
    path = path.rstrip("/")
    # Where each shard begins: a row for each index file, as many as the writing job had tasks.
    firsts = sorted((r.first_key.encode(), r.shard) for r in index.select("first_key", "shard").collect())
    table = keys.sparkSession.sparkContext.broadcast(firsts)

    def place(batches):
        begin, names = [k for k, _ in table.value], [s for _, s in table.value]
        for batch in batches:
            key, shard = [], []
            for k in batch.column(0).to_pylist():
                low, high = max(0, bisect.bisect_left(begin, k.encode()) - 1), bisect.bisect_right(begin, k.encode())
                key += [k] * (high - low)
                shard += names[low:high]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(shard, pa.string())], ["url_key", "shard"])

    placed = keys.select("url_key").where("url_key is not null").distinct().mapInArrow(place, "url_key string, shard string")

    def run(batches):
        name, own = None, None
        for batch in batches:
            out = []
            for key, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != name:
                    name, own = shard, Shard(shard)
                out += [(x[0].decode(), int(x[1]), f"{path}/{x[2].decode()}", int(x[3]), int(x[4])) for x in own.captures(key.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["url_key", "page_id", "path", "offset", "length"])

    return placed.repartition(max(1, len(firsts)), "shard").sortWithinPartitions("shard", "url_key").mapInArrow(run, ENTRY)


def read(entries: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for a revisit) of the records
    at ENTRY rows, by range reads. A payload that doesn't have its digest is an error."""
    def run(batches):
        name, file = None, None
        for batch in batches:
            out = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    place, at = store(path)
                    name, file = path, place.open_input_file(at)
                head, http, payload = parse(file.read_at(length, offset))
                digest, first = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"] == "response"
                if first and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path} at {offset}: digest")
                ids = [int(_ID.fullmatch(head[k].encode())[1]) if k in head else None for k in ("warc-record-id", "warc-refers-to")]
                out.append((ids[0], head["warc-target-uri"], int(http["content-length"]), digest, head["warc-type"], ids[1], payload if first else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    entries = written(entries.select("path", "offset", "length"), "entries")
    total, count = entries.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(1, -(-total // TASK_BYTES), -(-count // TASK_RECORDS))  # neighbours in a file stay together
    near = entries.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    out = near.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write and index all rows of `pages`, look all their keys up and read the records."""
    path = folder(pages.sparkSession, "archive")
    index = build(write(pages, path), path)
    return read(look_up(pages.select(url_key(F.col("url")).alias("url_key")), index, path))
