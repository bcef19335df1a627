import base64
import random

import pandas as pd
import public_tokenizers
import pytest
import tiktoken

import brute
import corpus_pipeline
from meterloom.llm import licences, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def real():
    return [(int(d), t, s) for d, t, s in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text", "source"]].itertuples(index=False)]


def test_run(spark, real):
    """Against brute force; at this size no line is frequent, so the quality rules only reject."""
    texts = {d: t for d, t, _ in real if not brute.base_measures(t)[-1]}
    texts = {d: t for d, t in texts.items() if len(brute.words(t)) >= 20}
    classes = brute.jaccard_components(list(texts.items()), 5, 80)
    texts = {d: t for d, t in texts.items() if classes[d][1] == d}
    items = pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)
    bad = {d for d, _ in brute.leaks(list(texts.items()), list(items))}
    texts = {d: t for d, t in texts.items() if d not in bad}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(texts)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = [d for d, t in texts.items() if not brute.base_spans(t)]
    assert all(list(out[d].ids) == coder.encode_ordinary(texts[d]) for d in plain) and len(plain) > len(texts) / 2
    for d in set(texts) - set(plain):
        text = coder.decode(list(out[d].ids))
        assert not brute.base_spans(text) and any(f"[{k}]" in text for k in ("EMAIL", "IP", "CARD", "PHONE"))


def test_frequent_lines_go(spark, tmp_path):
    """A line in every document of a host is taken out, whatever its digits; documents of nothing else are rejected."""
    r = random.Random(2)
    line = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    rows = [(i, f"Subscribe to letter {i} of this site\n" + "\n".join(line() for _ in range(4)), "en", "site", 0) for i in range(40)]
    rows += [(100 + i, "\n".join(["Subscribe to letter 7 of this site"] * 3 + [f"tail {i} of words"]), "en", "site", 0) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, line())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {x.doc_id: coder.decode(list(x.ids)) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: t.split("\n", 1)[1] for d, t, *_ in rows[:40]}


def test_stages_keep_columns(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "x " * 30, None, None, 60), (3, " ".join(map(str, range(40))), "en", "a", 5), (3, " ".join(map(str, range(40))), "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == (2 if start is docs else 0)


def test_licences(spark, real):
    notes = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved."]
    names = ["apache", "mit", "cc-by-nc", "gpl", "reserved"]
    texts = [f"Some words first.\n{n}\nand more" for n in notes] + ["\r\n".join(notes), "I lost my driving license in the public library.", "permission copyright licence", None, "", "plain words only", " ".join(notes[:1]).upper()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(100 + d, t, "y") for d, t, _ in real], "doc_id long, text string, families string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [got[i].families for i in range(len(texts))] == names + [",".join(sorted(names)), "", "", "", "", "", "apache"]
    assert got[6].n_unknown == 1 and got[8].n_candidates == 0 and len(got) == len(docs.collect())
    for d, t, _ in real:
        assert got[100 + d].families == ",".join(sorted({n for n, x in zip(names, notes) if x in t.split("\n")}))


def test_licence_query(spark, real):
    got = {r.doc_id: r.families for r in queries.op5_licence_scan(spark, SF).collect()}
    assert len(got) == len(real)


def test_licences_held_out(spark):
    """Notices worded otherwise than the templates."""
    held = {"apache": "This project is licensed under the terms of the Apache License, Version 2.0 (see LICENSE).", "mit": "The code is released under the MIT License, see the file.", "gpl": "distributed under the GNU General Public License, version 3 or later",
            "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted.", "public-domain": "dedicated to the public domain under CC0 1.0 Universal"}
    docs = spark.createDataFrame(list(enumerate(held.values())), "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(docs).collect()}
    assert sum(got[i] == f for i, f in enumerate(held)) >= 4
    assert licences.scan(docs.limit(0)).count() == 0


def test_licences_learn_from_every_line(spark, monkeypatch):
    """All lines without a cue word are examples of unknown or held out, at any number of lines."""
    words = ["source", "code", "work", "version", "use", "terms", "form", "public", "general", "law", "software", "file"]
    lines = [" ".join(w for i, w in enumerate(words) if n >> i & 1) for n in range(4, 4096)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::40])) for i in range(40)], "doc_id long, text string")
    kept, fit, fitted = licences.written, licences.LogisticRegression.fit, []
    monkeypatch.setattr(licences, "written", lambda df, name: (lambda t: fitted.append(t.count()) or t)(kept(df, name)))
    monkeypatch.setattr(licences.LogisticRegression, "fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    licences.Classifier(docs)
    assert fitted[0] > 4000 and fitted[1] > 2600
