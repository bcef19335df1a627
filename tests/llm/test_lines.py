import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from meterloom.llm import line_runs, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, h1 string, pos int"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)


def boilerplate(seed, n=120):
    r = random.Random(seed)
    shared = [f"{c} shared line number {i} of some length" + c * 12 for i, c in enumerate("abcdefghé")] + ["short", "x" * 39, "y" * 40, "Ä" * 41]
    out = []
    for i in range(n):
        lines = [r.choice(shared) if r.random() < 0.6 else f"own line {i} {r.random()} and some more words" for _ in range(r.randrange(1, 9))]
        lines = [r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.3 and "é" not in x and "Ä" not in x else x) + r.choice(["", "  ", "\r"]) for x in lines]
        out.append((i * 7 % 101, "\n".join(lines) + r.choice(["", "\n"])))
    return out + [(None, "y" * 40), (None, "y" * 40 + "\nq"), (300, None), (301, ""), (302, "\n\n"), (303, ("y" * 40 + "\n") * 500), (303, "z\n" + "x" * 39)]


def rows(found):
    return sorted((str(a), b, c, d) for a, b, c, d in found)


@pytest.mark.parametrize("seed,batches,fanout", [(1, 1, 3), (2, 5, 2), (3, 4, 3)])
def test_lines_match_brute_force(spark, seed, batches, fanout):
    docs = boilerplate(seed)
    got = line_runs.without_frequent(frame(spark, docs), batches=batches, fanout=fanout).collect()
    assert rows(tuple(r) for r in got) == rows(brute.line_removal(docs))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_keys_without_a_known_holder(spark):
    """All holders without an id: they all keep the line."""
    docs = [(None, "k" * 50)] * 6
    assert [r.n_dropped for r in line_runs.without_frequent(frame(spark, docs)).collect()] == [0] * 6
    assert line_runs.without_frequent(frame(spark, [])).count() == 0


def test_query_of_lines(spark):
    docs = [tuple(x) for x in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]
    want = {(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute.line_removal(docs)}
    assert {tuple(r) for r in queries.op12_line_dedup(spark, SF).collect()} == want


def test_runs_tell_new_keys(spark):
    runs = line_runs.Runs(spark, fanout=2)
    keys = lambda a, b: spark.range(a, b).select(F.col("id").alias("h1"), (-F.col("id")).alias("h2"), F.lit(1).cast("long").alias("holders"), F.col("id").alias("top"))
    for a, b in [(0, 50), (25, 100), (90, 130), (0, 10), (128, 140)]:
        runs.add(keys(a, b))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(r.h1 for r in runs.unseen(keys(100, 145)).collect()) == list(range(140, 145))
    whole = runs.merged(runs.names()).collect()
    assert len(whole) == 140 and sum(r.holders for r in whole) == 50 + 75 + 40 + 10 + 12
    runs.close()
