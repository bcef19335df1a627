"""Which of very many 64-bit keys belong to two owners or more, in one shuffle.

A map task marks what its own batch already shows: of a key that two owners of the batch share, the first row goes on as
FIRST (known to be shared) and the others as MORE, which need no look-up and are salted. So a key that a third of all
rows hold costs its partition one row per batch, not one per owner.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLAIN, MORE, FIRST, ABOUT = 0, 1, 2, 3
SALTS = 64


def tags(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """PLAIN, MORE or FIRST for each row of a batch."""
    out = np.zeros(len(key), np.int32)
    if not len(key):
        return out
    order = np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    shared = np.minimum.reduceat(o, heads) != np.maximum.reduceat(o, heads)
    size = np.diff(np.r_[heads, len(k)])
    out[order] = np.repeat(np.where(shared, MORE, PLAIN), size)
    out[order[heads[shared]]] = FIRST
    return out


def shared(rows: DataFrame) -> DataFrame:
    """rows (key, owner, tag, ...): those whose key has two owners, and all ABOUT rows."""
    salt = F.when(F.col("tag") == MORE, F.pmod(F.xxhash64("owner"), F.lit(SALTS)) + 1).when(F.col("tag") == ABOUT, -1).otherwise(0)
    w = Window.partitionBy("key", "salt")
    seen = rows.withColumn("salt", salt).withColumns({"lo": F.min("owner").over(w), "hi": F.max("owner").over(w), "known": F.max("tag").over(w)})
    return seen.where("lo <> hi or known > 0").drop("salt", "lo", "hi", "known")
