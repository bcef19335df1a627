import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from meterloom.llm import jaccard, queries, substring

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, owner string, key int"


@pytest.fixture(scope="module")
def real():
    return [(int(d), t) for d, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]


def tangled(seed=1, n=160):
    """Near copies in chains, equal sets, very short texts, nulls and blanks."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 6, 9, 20, 60, 130]))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append((i * 3 + 1, r.choice([" ", "  ", "\n"]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    return out + [(2, None), (5, ""), (8, " \n\t "), (11, "x"), (14, "X"), (1000, "é" * 50000)]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
@pytest.mark.parametrize("seed", [1, 2])
def test_linked_matches_brute_force(spark, k, percent, seed):
    docs = tangled(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(frame(spark, docs), k, percent).collect()}
    assert got == brute.jaccard_components(docs, k, percent)


def test_query_of_joined_documents(spark, real):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute.jaccard_components(real, 4, 85)


def test_linked_edge_cases(spark):
    assert jaccard.linked(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B C D E F"), (7, None)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.linked(frame(spark, rows)).collect())
    assert got == [("4", 2, 4), ("4", 2, 4), ("7", 0, 7), ("9", 2, 4), ("None", 2, 4)]
    kept = jaccard.one_of_each(frame(spark, rows)).orderBy("doc_id").collect()
    assert [r.doc_id for r in kept] == [None, 4, 4, 7] and kept[0].owner == "x"


def repeating(seed=3):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    passages = [[r.choice(vocab) for _ in range(n)] for n in (49, 50, 51, 75, 120)]
    out = []
    for i in range(60):
        w = []
        for _ in range(r.randrange(4)):
            w += [r.choice(vocab) for _ in range(r.randrange(40))] + r.choice(passages)
        out.append((500 - i * 5, "\t".join(w)))
    return out + [(1, None), (2, ""), (3, "  "), (4, "one"), (900, " ".join(["same"] * 300)), (901, " ".join(["same"] * 70))]


@pytest.mark.parametrize("width", [50, 8, 3, 2])
def test_substrings_match_brute_force(spark, width):
    docs = repeating()
    got = substring.without_repeats(frame(spark, docs), width).withColumn("sha", F.coalesce("words_sha256", F.sha2("kept_text", 256)))
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got.collect()} == brute.substring_removal(docs, width)


def test_query_of_substrings(spark, real):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op9_substring_dedup(spark, SF).collect()}
    assert got == brute.substring_removal(real, 50)


def test_substring_edge_cases(spark):
    assert substring.without_repeats(frame(spark, [])).count() == 0
    text = " ".join(map(str, range(60)))
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.without_repeats(frame(spark, [(None, text), (4, text), (4, text), (6, text)])).collect())
    assert got == [("4", 0), ("4", 0), ("6", 60), ("None", 60)]


def test_substrings_of_texts_without_or_of_one_id(spark):
    """Each text is judged by itself: words go only where a text of a smaller id has the window."""
    r = random.Random(8)
    shared, own = " ".join(map(str, range(60))), [" ".join(str(r.random()) for _ in range(60)) for _ in range(4)]
    rows = [(None, shared), (None, own[0] + " " + own[1]), (None, own[0] + " " + own[2]), (3, shared), (7, own[3] + " " + shared), (7, own[3]), (2**63 - 1, shared)]
    got = substring.without_repeats(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_removed) for x in got) == sorted(
        [("None", 60, 60), ("None", 120, 0), ("None", 120, 0), ("3", 60, 0), ("7", 120, 60), ("7", 60, 0), (str(2**63 - 1), 60, 60)])


@pytest.mark.parametrize("v", [3, 7, 13, 21, 31])
def test_covers(v):
    on = substring.covered(v)
    assert all(any(on[(i + s) % v] and on[(j + s) % v] for s in range(v)) for i in range(v) for j in range(v))


def test_only_texts_of_candidate_pairs_are_compared(spark, monkeypatch):
    """Long sets that share a fragment but not most elements are told apart by sketches, not by their elements."""
    r = random.Random(4)
    half = [f"h{r.random()}" for _ in range(3000)]
    docs = [(i, " ".join(half + [f"w{i}-{r.random()}" for _ in range(3000)])) for i in range(6)]
    docs += [(10, " ".join(f"c{i}" for i in range(200))), (11, " ".join(f"c{i}" for i in range(190)))]
    docs += [(20 + i, " ".join([f"s{j}" for j in range(12)] + [f"t{i}-{j}" for j in range(12)])) for i in range(8)]
    tables = {}

    def noted(df, name):
        out = written(df, name)
        tables.setdefault(name, []).append(out.collect())
        return out

    written = jaccard.written
    monkeypatch.setattr(jaccard, "written", noted)
    got = {x.doc_id: x.component_id for x in jaccard.linked(frame(spark, docs)).collect()}
    assert got == {d: 10 if d == 11 else d for d, _ in docs}
    pairs = tables["ties"][0] + tables["pairs"][0]
    assert len(pairs) > 1 and len({o for x in pairs for o in x}) < len(tables["nodes"][0])  # long sets pass the narrow sketch; not all that meet are paired
    near = tables["ties-near"][0] + tables["pairs-near"][0]
    assert {frozenset(x) for x in near} == {frozenset(x) for x in tables["ties-verified"][0] + tables["pairs-verified"][0]}


@pytest.mark.parametrize("n", [1, 63, 64, 65, 513, 5000])
def test_wide_sketches_never_overstate(n):
    r = np.random.default_rng(n)
    u = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
    v = np.unique(np.r_[u[n // 9:], r.integers(0, 1 << 63, n // 5).astype(np.uint64)])
    x, y = sorted((jaccard.wide_sketch(u), jaccard.wide_sketch(v)), key=len)
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    assert np.array_equal(jaccard.wide_sketch(u), jaccard.wide_sketch(u[::-1])) and len(x) * 64 >= min(len(u), len(v))
    assert int(np.bitwise_count((x ^ folded).view(np.uint64)).sum()) <= len(np.setxor1d(u, v))
