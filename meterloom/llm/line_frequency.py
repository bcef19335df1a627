"""Quality rules from cross-document line frequency.

Lines are normalised (white space runs, A-Z to lower case, a run of digits to one 0) and hashed. For each host, the distinct documents
that hold a line are counted, by a hash of the whole normalised text: copies that differ at most in case, white space and
digits count once. Lines in more documents than the limit are taken out, and a document that loses
nearly everything is rejected.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .staging import BROADCAST_ROWS, matched, settle, written

U = np.uint64
PLAIN = flat.LOWER.copy()
PLAIN[48:58] = 48
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, row long, host string, " + ", ".join(f"{c} long" for c in STATS) + ", whole long, lines array<struct<line:long,words:long>>"


def row_key():
    """A document: its id, or where that is null its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("row")


def _lines(b: np.ndarray, o: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the lines, the document of each, and the lines' offsets in the list of words that start at `s`."""
    cut = np.flatnonzero(b == 10)
    first = np.concatenate([o[:-1], cut + 1])
    doc = np.concatenate([np.arange(len(o) - 1), np.searchsorted(o, cut, "right") - 1])
    order = np.lexsort((first, doc))
    first, doc = first[order], doc[order]
    last = np.r_[first[1:] - 1, 0]
    ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) if len(doc) else []
    last[ends] = o[1:]
    return first, last, doc, np.r_[np.searchsorted(s, first), len(s)]


def _line_ids(b: np.ndarray, o: np.ndarray, s: np.ndarray, e: np.ndarray, wo: np.ndarray) -> np.ndarray:
    """Hash of the normalised words wo[i]..wo[i+1] for every line i."""
    digit = (b >= 48) & (b <= 57)
    keep = np.ones(len(b) + 1, bool)
    keep[1:-1] = ~(digit[1:] & digit[:-1])
    keep[o] = True
    to = np.cumsum(keep) - 1
    h = flat.range_hashes(b[keep[:-1]], to[s], to[e], PLAIN)
    return flat.sequence_hashes(h, wo)


def _sums(flags: np.ndarray, o: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[o[1:]] - c[o[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = flat.texts(batch)
        stats, wholes, lines, words, sizes = {c: [] for c in STATS}, [], [], [], []
        for i, j in flat.runs(off):
            b, o, n = data[off[i]:off[j]], off[i:j + 1] - off[i], j - i
            s, e, h, wo = flat.words(b, o)
            count = np.diff(wo)
            stats["n_words"].append(count)
            stats["word_chars"].append(_sums(~flat.WS[b] & ((b & 0xC0) != 0x80), o))
            stats["n_symbols"].append(_sums(SYMBOL[b], o))
            first, last, line_doc, line_words = _lines(b, o, s)
            long = np.diff(line_words) > 0
            raw = flat.mix(flat.range_hashes(b, first[long], last[long]) ^ (line_doc[long].astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
            stats["n_dup_lines"].append(np.bincount(line_doc[long][pd.Series(raw).duplicated().to_numpy()], minlength=n))
            at, v = flat.windows(h, wo, 8)
            doc = np.repeat(np.arange(n), count)
            v = flat.mix(v ^ (doc[at].astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
            edge = np.zeros(len(h) + 9, np.int64)
            twice = at[pd.Series(v).duplicated(keep=False).to_numpy()]
            edge[twice] += 1
            edge[twice + 8] -= 1
            stats["n_repeat_words"].append(np.bincount(doc[np.cumsum(edge)[:len(h)] > 0], minlength=n))
            wholes.append(_line_ids(b, o, s, e, wo))
            ids = _line_ids(b, o, s, e, line_words)[long]
            each = pd.DataFrame({"doc": line_doc[long], "line": flat.signed(ids), "words": np.diff(line_words)[long]}).groupby(["doc", "line"], sort=True)["words"].sum().reset_index()
            lines.append(each["line"].to_numpy(np.int64))
            words.append(each["words"].to_numpy(np.int64))
            sizes.append(np.bincount(each["doc"].to_numpy(np.int64), minlength=n))
        cat = lambda x, kind: np.concatenate([*x, np.empty(0, kind)]).astype(kind)
        pairs = pa.StructArray.from_arrays([pa.array(cat(lines, np.int64)), pa.array(cat(words, np.int64))], ["line", "words"])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), batch.column(2), *(pa.array(cat(stats[c], np.int64)) for c in STATS), pa.array(flat.signed(cat(wholes, U))),
            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cat(sizes, np.int64))].astype(np.int32)), pairs)], ["doc_id", "row", "host", *STATS, "whole", "lines"])
    flat.release()


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose hashes are listed in `gone`."""
    for batch in batches:
        data, off = flat.texts(batch)
        gone = batch.column(batch.schema.get_field_index("gone"))
        out = []
        for i, j in flat.runs(off):
            b, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
            s, e, _, _ = flat.words(b, o)
            first, last, doc, lw = _lines(b, o, s)
            ids = flat.signed(_line_ids(b, o, s, e, lw))
            at = np.searchsorted(doc, np.arange(j - i + 1))
            for d in range(j - i):
                p, q = at[d], at[d + 1]
                drop = np.isin(ids[p:q], gone[i + d].values.to_numpy() if gone[i + d].is_valid else []) & (np.diff(lw)[p:q] > 0)
                out.append("\n".join(b[x:y].tobytes().decode() for x, y in zip(first[p:q][~drop], last[p:q][~drop])))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if x == "text" else batch.column(k) for k, x in enumerate(batch.schema.names)], batch.schema.names)


def judged(docs: DataFrame, host: str = "source", min_docs: int = 5, percent_of_host: float = 0.5, left_words: int = 10, left_percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """Per row of `docs` (doc_id, text, `host`; others are not looked at): the base measures, base_failed, removed_words,
    kept. And the frequent lines (host, line, documents).

    A line is frequent in a host if it is in more than `min_docs` distinct documents and more than `percent_of_host` % of
    the host's: the share decides, and the floor of a few documents only keeps small hosts from losing lines that two or
    three documents happen to share. A document is depleted if fewer than `left_words` words or `left_percent` % of its words would be left.
    Null or empty texts have no words and fail; a null host is a host of its own; rows of one doc_id
    are taken to have one text; of rows without an id, those of one text are one document.
    """
    settle(docs.sparkSession)
    base = docs.select("doc_id", row_key(), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), "text")
    measures = written(base.mapInArrow(_measure, SCHEMA), "lines")
    lines = measures.select("row", "host", "whole", F.explode("lines").alias("at")).select("row", "host", "whole", "at.line", "at.words")
    often = lines.groupBy("host", "line").agg(F.count_distinct("whole").alias("documents")).where(F.col("documents") > min_docs)
    hosts = measures.groupBy("host").agg(F.count_distinct("whole").alias("of"))
    often = written(often.join(hosts, "host").where(F.col("documents") * 100 > F.col("of") * percent_of_host).drop("of"), "frequent")
    lost = matched(lines.select("row", "host", "line", "words").distinct(), often.select("host", "line"), ["host", "line"])
    lost = lost.groupBy("row").agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_set("line")).alias("gone"))
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = (measures.drop("lines", "whole").join(lost, "row", "left")
           .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
           .withColumn("base_failed", failed)
           .withColumn("kept", ~failed & ~((left < left_words) | (left * 100 < F.col("n_words") * left_percent))))
    return out, often


def filtered(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """`docs` without rejected documents and without the frequent lines of the others; n_chars, if there, is recounted."""
    verdict, _ = judged(docs, host, **limits)
    touched = written(verdict.where(~F.col("kept") | F.col("gone").isNotNull()).select(F.col("row").alias("touched_row"), F.col("kept").alias("touched_kept"), "gone").distinct(), "touched")
    values = touched.select(F.sum(F.lit(2) + F.greatest(F.size("gone"), F.lit(0)))).first()[0] or 0
    keyed = docs.withColumn("touched_row", row_key())
    joined = keyed.join(F.broadcast(touched) if values <= BROADCAST_ROWS * 2 else touched.hint("shuffle_merge"), "touched_row", "left")
    left = joined.where("coalesce(touched_kept, true)").drop("touched_row", "touched_kept")
    out = left.mapInArrow(_strip, left.schema).drop("gone")
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*docs.columns)
