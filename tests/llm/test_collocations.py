import random

import numpy as np
import pandas as pd
import pytest

import brute
from meterloom.llm import collocations, flat, queries

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, ids string, f int")


def prose(seed, n=80):
    r = random.Random(seed)
    vocab = ["The", "of", "a", "b", "c", "Ähre", "x-y", "日本", "#"]
    out = [(r.choice(["en", "de", None, ""]), "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(r.randrange(60)))) for _ in range(n)]
    return out + [("en", None), ("en", ""), (None, " .,;"), ("fr", "a"), ("en", "same " * 300)]


def got(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("seed,longest,budget,top", [(1, 3, 1_000_000, 2000), (2, 3, 40, 2000), (3, 4, 100, 7), (4, 2, 10, 2000)])
def test_phrases_match_brute_force(spark, seed, longest, budget, top):
    rows = prose(seed)
    assert got(collocations.mined(frame(spark, rows), longest=longest, budget=budget, top=top)) == brute.collocations(rows, longest, top=top)


def test_edge_cases(spark):
    assert collocations.mined(frame(spark, [])).count() == 0
    assert collocations.mined(frame(spark, [(None, None), ("en", "one word")] * 3)).count() == 0


def test_query_of_phrases(spark):
    rows = [tuple(x) for x in pd.read_parquet(f"{SF}/documents.parquet")[["lang", "text"]].itertuples(index=False)]
    assert got(queries.op11_collocations(spark, SF)) == brute.collocations(rows)


def test_words_that_share_an_id_change_the_seed(spark, monkeypatch):
    """Scores beyond 64 bits are exact; a seed under which words share an id is passed over."""
    b = np.frombuffer(b"one two. three", np.uint8)
    s, e, ids, piece = collocations.word_table(b, np.array([0, len(b)]), 0)
    assert len(set(ids)) == 3 and piece[0] == piece[1] != piece[2]
    assert (collocations.word_table(b, np.array([0, len(b)]), 1)[2] != ids).all()
    assert (collocations.suffixes(ids, piece, 3) != collocations.NONE).sum() == 4
    big = spark.createDataFrame([(10**14, 10**14 + 1, 10**14 + 3)], "a long, l long, r long").select(collocations._score(*map(__import__("pyspark").sql.functions.col, "alr")).alias("s")).first().s
    assert big == 1000000 * 10**28 // ((10**14 + 1) * (10**14 + 3))
    assert flat.U is np.uint64
