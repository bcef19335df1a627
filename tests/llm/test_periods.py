import hashlib
import random

import pandas as pd
import pytest

import brute
from meterloom.llm import periods, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, period int"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)


def repetitive(seed, n=80):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = []
        while len(w) < r.choice([3, 30, 200, 700]):
            unit = [r.choice("abcd") for _ in range(r.choice([1, 1, 2, 3, 5, 8, 17, 40]))]
            m = r.choice([1, 2, 3, 4, 4, 5, 9]) * len(unit) + r.randrange(len(unit))
            w += (unit * 11)[:m] + [r.choice("abcdefghij") for _ in range(r.randrange(4))]
        out.append((i, " ".join(w)))
    return out + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "same " * 300), (505, "a b " * 150 + "a"), (506, " ".join(map(str, range(400))))]


@pytest.mark.parametrize("seed,tile,times", [(1, 1 << 14, 4), (2, 64, 4), (3, 16, 3)])
def test_runs_match_brute_force(spark, seed, tile, times):
    docs = repetitive(seed)
    got = {r.doc_id: r for r in periods.runs(frame(spark, docs), times=times, tile=tile).collect()}
    for d, t in docs:
        w = brute.words(t)
        want = brute.periodic_runs(w, times=times)
        assert [(x.start, x.length, x.period) for x in got[d].runs] == want and got[d].n_words == len(w), d
        assert (got[d].collapsed if want else None) == (brute.collapsed(w, want) if want else None)
        assert got[d].words_sha256 == hashlib.sha256(" ".join(w).encode()).hexdigest()


def test_query_of_runs(spark):
    docs = [tuple(x) for x in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    seen = 0
    for d, t in docs:
        w = brute.periodic_words(d, t)
        want = brute.periodic_runs(w)
        seen += bool(want)
        best = min(want, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[d]) == (d, len(want), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
                                 sha("".join(f"{s},{n},{q}\n" for s, n, q in want)), sha(brute.collapsed(w, want)))
    assert seen > 5 and len(got) == len(docs)


def test_edge_cases(spark):
    assert periods.runs(frame(spark, [])).count() == 0
    rows = [(None, "a a a a a a a"), (None, "b"), (7, "a b a b a b a b"), (7, "x y z"), (7, "a b a b a b a b")]
    got = sorted((str(r.doc_id), len(r.runs), str(r.collapsed)) for r in periods.runs(frame(spark, rows)).collect())
    assert got == [("7", 0, "None"), ("7", 1, "a b"), ("7", 1, "a b"), ("None", 0, "None"), ("None", 1, "a")]


def test_z_values():
    r = random.Random(5)
    for _ in range(50):
        x = [r.randrange(2) for _ in range(r.randrange(1, 30))]
        z = periods.z_values(x)
        assert all(z[i] == next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(1, len(x)))
