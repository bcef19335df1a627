"""Token ids in files of independent zstandard frames with a trailing seek table.

File: data frames (little-endian uint32 ids of whole documents, about FRAME bytes each), one frame with the document index
(doc_id and number of ids, little-endian int64 pairs), then the seek table of the public seekable format: a skippable
frame with compressed size, plain size and checksum (low half of XXH64 of the plain bytes) of every frame, and a footer.
Any zstandard reader can decompress a file; this reader finds the frames that hold the documents asked for.
"""
from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import flat
from .files import put, store
from .pretokens import Encoder
from .staging import folder, settle, written

FRAME = 1 << 18
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
NO_ID = (1 << 63) - 1
WRITTEN = "shard int, path string, n_docs long, n_tokens long, bytes long, first_id long, last_id long"


def frames(documents: Iterable[tuple[int, np.ndarray]], level: int = 3, size: int = FRAME) -> Iterator[bytes]:
    """The bytes of a file. A document longer than a frame is a frame of its own, cut only at 2^30 bytes."""
    import xxhash
    import zstandard

    pack, table, index, held, n = zstandard.ZstdCompressor(level=level), [], [], [], 0

    def frame(plain: bytes) -> bytes:
        packed = pack.compress(plain)
        table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        return packed

    for doc_id, ids in documents:
        plain = np.ascontiguousarray(ids, "<u4").tobytes()
        index.append((doc_id, len(ids)))
        if n and n + len(plain) > size:
            yield frame(b"".join(held))
            held, n = [], 0
        while len(plain) > 1 << 30:
            yield frame(plain[:1 << 30])
            plain = plain[1 << 30:]
        held.append(plain)
        n += len(plain)
    yield frame(b"".join(held))
    yield frame(np.array(index, "<i8").reshape(-1, 2).tobytes())
    entries = np.array(table, ENTRY).tobytes()
    yield struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(table), CHECKSUMS, SEEKABLE)


class Reader:
    """Documents of one file by their place in it; only the frames that hold them are read and decompressed."""

    def __init__(self, uri: str):
        place, path = store(uri)
        self.file = place.open_input_file(path)
        total = self.file.size()
        count, kind, magic = struct.unpack("<IBI", self.file.read_at(9, total - 9))
        if magic != SEEKABLE or not kind & CHECKSUMS:
            raise ValueError(f"{uri}: no seek table")
        self.table = np.frombuffer(self.file.read_at(12 * count, total - 9 - 12 * count), ENTRY)
        self.at = np.r_[0, np.cumsum(self.table["packed"].astype(np.int64))]
        self.plain = np.r_[0, np.cumsum(self.table["plain"][:-1].astype(np.int64))]
        self.index = np.frombuffer(self.frame(count - 1), "<i8").reshape(-1, 2)
        self.first = np.r_[0, np.cumsum(self.index[:, 1])] * 4
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        import xxhash
        import zstandard

        row = self.table[i]
        got = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(row["packed"]), int(self.at[i])), max_output_size=max(1, int(row["plain"])))
        if len(got) != row["plain"] or xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != row["check"]:
            raise ValueError(f"frame {i}: checksum")
        return got

    def document(self, k: int) -> bytes:
        """Its ids as little-endian uint32."""
        a, z = int(self.first[k]), int(self.first[k + 1])
        if a == z:
            return b""
        out, i = [], int(np.searchsorted(self.plain, a, "right")) - 1
        while a < z:
            if self.held[0] != i:
                self.held = i, self.frame(i)
            to = min(z, int(self.plain[i + 1]))
            out.append(self.held[1][a - int(self.plain[i]):to - int(self.plain[i])])
            a, i = to, i + 1
        return b"".join(out)


@lru_cache(2)
def _encoder(content: str) -> Encoder:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_str(content)
    own.encode_special_tokens = True
    return Encoder(lambda pieces: [x.ids for x in own.encode_batch_fast(pieces, add_special_tokens=False)])


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encode `docs` (doc_id, text; others are not looked at) and write them in ascending order of doc_id to shards.

    The byte-level tokenizer in file `tokenizer` encodes each distinct match of its own pre-tokenizer pattern; this
    gives the ids of whole texts. `end_id` follows each document; a null or empty text is that id alone. Null doc_ids
    come last; rows of one doc_id follow each other in order of text. Returns the written files (WRITTEN, start).
    """
    spark = docs.sparkSession
    settle(spark)
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    shards = shards or max(base.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    uri = path.rstrip("/")

    def encoded(batches, totals):
        own = _encoder(shared.value)
        for batch in batches:
            for i, j in flat.runs(flat.texts(batch)[1], 1 << 22):
                part = batch.slice(i, j - i)
                ids, counts = own.texts(*flat.texts(part))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                for d, a, z in zip(part.column(0).to_pylist(), np.r_[0, ends[:-1]], ends):
                    totals[0] += 1
                    totals[1] += int(z - a)
                    totals[2:] = [min(d, totals[2]), max(d, totals[3])]
                    yield d, ids[a:z]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, totals = TaskContext.get().partitionId(), [0, 0, NO_ID, -NO_ID - 1]
        name = f"{uri}/tokens-{shard:06d}.zst"
        size = put(name, frames(encoded(batches, totals)))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [totals[0]], "n_tokens": [totals[1]], "bytes": [size], "first_id": [totals[2]], "last_id": [totals[3]]})

    spread = base.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    files = written(spread.mapInArrow(run, WRITTEN), "token-files")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return files.withColumn("start", F.coalesce(before, F.lit(0)))


READ = "doc_id long, start long, n_tokens long, ids binary"


def _documents(path: str, start: int, wanted: list[int] | None) -> Iterator[pa.RecordBatch]:
    """The documents of one file, or of those the ones with a wanted id (sorted): no frame is read that holds none of them."""
    own = Reader(path)
    begin = start + np.r_[0, np.cumsum(own.index[:, 1])]
    at = np.arange(len(own.index)) if wanted is None else np.flatnonzero(np.isin(own.index[:, 0], wanted))
    rows, size = [], 0
    for k in at.tolist():
        rows.append((int(own.index[k, 0]), int(begin[k]), int(own.index[k, 1]), own.document(k)))
        size += 4 * rows[-1][2]
        if size > 1 << 22 or k == at[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])
            rows, size = [], 0


def read(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document of the files that write() returned; with
    `wanted` (doc_id), of those documents only, from the frames that hold them. A null doc_id is asked for as null.

    Files are spread over as many partitions as there are files, so no task reads more than a few of them.
    """
    spread = max(1, files.count())
    if wanted is None:
        asked = files.select("path", "start", F.lit(None).cast("array<long>").alias("wanted"))
    else:
        ids = wanted.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("asked")).distinct()
        asked = ids.join(files.where("n_docs > 0"), F.col("asked").between(F.col("first_id"), F.col("last_id")))
        asked = asked.groupBy("path", "start").agg(F.sort_array(F.collect_list("asked")).alias("wanted"))

    def run(batches):
        for batch in batches:
            for path, start, own in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _documents(path, start, own)

    out = asked.repartition(spread, "path").mapInArrow(run, READ)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents to a new folder of the shared place and read them back."""
    return read(write(docs, tokenizer, folder(docs.sparkSession, "tokens"), end_id))
