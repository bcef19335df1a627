"""Every line is looked at, whether or not it has a cue word."""
from meterloom.llm import licences


def test_lines_without_a_cue_are_looked_at(spark):
    """A part of a notice that lost its cue word is a candidate; a line with a few words of one is not."""
    part = "Unless required by applicable law or agreed to in writing, software distributed under the terms"
    rows = [(1, part), (2, f"one\n{part}\ntwo\n{part}"), (2, f"one\n{part}\ntwo\n{part}"), (3, "the software was distributed in writing"), (None, part), (4, None), (5, "All rights reserved\n" + part)]
    docs = licences._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.row_id, " ".join(r.tokens)) for r in licences.paragraphs(docs, 0.6).collect())
    plain = " ".join(licences._plain(part))
    assert got == sorted([(1, plain), (2, plain), (2, plain), (-(1 << 63), plain), (5, "all rights reserved"), (5, plain)])


def test_telling_words_are_in_all_that_can_be_confirmed():
    for least in (0.3, 0.6, 1.0):
        told = set(licences.telling(least))
        for _, pairs in licences._shapes():
            free = [p for p in pairs if told.isdisjoint(p.split())]
            assert len(free) < least * len(pairs)
