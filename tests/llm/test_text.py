import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import base64

import brute
import corpus_pipeline
from meterloom.llm import bpe, contamination, disclosure, flat, line_frequency, pretokens, queries, token_frames, wordpiece

SF = "/root/testdata/sf0.001"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, key int"
ODD = ["", None, " ", "\n\n", "don't we'll I've you're it's he'd I'm 'tis ''s x' 's", "a  b   c \n d\t\te \n", " lead", "trail  ", "   x　y", "é" * 40, "日本語テキスト 123 ４５", "🙂🙂 a🙂b", "<|endoftext|> x", "a" * 3000, "ab" * 2000, "x\x1cy\x85z", "'", "'s", "don'", "I'", "\r\n\r\n a", "1234 5678,90", "#$%&", "' re", "x'ét"]


@pytest.fixture(scope="module")
def real():
    return [(int(d), t) for d, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts):
    rows = [(i, t, "h", 1) if not isinstance(t, tuple) else (*t, "h", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def some_texts(seed, n=60):
    r = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "'s", "'", "l", "é", "ß", "12", "!", "?!", "\t", "日本", "a", "don't", " \n", " ", "🙂", "Ñandu", "ing"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(80))) for _ in range(n)]


def arrays(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_are_those_of_the_libraries(coder, seed):
    texts = ODD + some_texts(seed)
    own = bpe.encoder(open(RANKS, "rb").read())
    ids, counts = own.texts(*arrays(texts))
    for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == coder.encode_ordinary(t or ""), repr(t)
    lib = Tokenizer.from_file(JSON)
    lib.encode_special_tokens = True
    ids, counts = token_frames._encoder(open(JSON, encoding="utf-8").read()).texts(*arrays(texts))
    for t, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert got.tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_long_texts_are_cut_between_matches(coder, monkeypatch):
    monkeypatch.setattr(pretokens, "RUN", 50)
    text = " ".join(some_texts(9, 200))
    ids, counts = bpe.encoder(open(RANKS, "rb").read()).texts(*arrays([text, "b"]))
    assert ids.tolist() == coder.encode_ordinary(text) + coder.encode_ordinary("b") and counts.sum() == len(ids)


def test_cache_may_be_emptied(coder):
    merger = bpe.Merger(bpe._tokens(open(RANKS, "rb").read()))
    small = pretokens.Encoder(lambda p: merger.encode([x.encode() for x in p]), most=30)
    for t in some_texts(4, 40):
        ids, _ = small.texts(*arrays([t]))
        assert ids.tolist() == coder.encode_ordinary(t)


def test_byte_bpe_query(spark, real, coder):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_byte_bpe(spark, SF).collect()}
    for d, t in real:
        ids = coder.encode_ordinary(t)
        assert got[d] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_byte_bpe_columns(spark):
    df = spark.createDataFrame([(None, None, 3, "a"), (1, "", 4, "b"), (1, "x y", 5, None)], "doc_id long, text string, ids int, bytes string")
    out = bpe.decode(bpe.encode(df, RANKS), RANKS)
    assert out.columns == ["doc_id", "text", "ids", "bytes"]
    assert sorted(bytes(r.bytes) for r in out.collect()) == [b"", b"", b"x y"]
    assert bpe.encode(df.limit(0), RANKS).count() == 0


def test_token_frames_query(spark, real):
    import zlib
    lib, at = Tokenizer.from_file(JSON), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_frames(spark, SF).collect()}
    for d, t in sorted(real):
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_frames_edges(spark, tmp_path):
    df = spark.createDataFrame([(None, "last", 1), (5, None, 2), (-3, "", 3), (5, "b", 4), (5, "b", 5)], "doc_id long, text string, start int")
    rows = token_frames.read(token_frames.write(df, JSON, f"file://{tmp_path}/t")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [-3, 5, 5, 5, None] and [r.n_tokens for r in rows][:2] == [1, 1]
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows][:-1]))
    assert token_frames.round_trip(df.limit(0), JSON).count() == 0


def test_frames_are_read_alone_and_checked(tmp_path):
    import zstandard
    docs = [(i, np.arange(i * 7 % 50)) for i in range(200)] + [(999, np.arange(5000))]
    path = str(tmp_path / "x.zst")
    token_frames.put(path, token_frames.frames(docs, size=1000))
    own = token_frames.Reader(path)
    assert len(own.table) > 10
    for k in (0, 7, 150, 200, 3):
        assert own.document(k) == docs[k][1].astype("<u4").tobytes()
    raw = bytearray(open(path, "rb").read())
    plain = b"".join(x[1].astype("<u4").tobytes() for x in docs)
    assert zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read().startswith(plain)
    raw[int(own.at[1]) - 1] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_frames.Reader(path).document(1)


def test_readers_are_spread_and_seek(spark, tmp_path, monkeypatch):
    """As many reading tasks as files; wanted documents only, from the frames that hold them."""
    rows = [(i if i % 10 else None, f"text number {i} " * (1 + i % 7)) for i in range(400)]
    files = token_frames.write(frame(spark, rows), JSON, f"file://{tmp_path}/t", shards=6)
    assert token_frames.read(files).rdd.getNumPartitions() == 6
    every = {(r.doc_id, r.start): r for r in token_frames.read(files).collect()}
    wanted = spark.createDataFrame([(5,), (6,), (399,), (77777,), (None,)], "doc_id long")
    got = token_frames.read(files, wanted).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["5", "6", "399"] + ["None"] * 40) and all(every[r.doc_id, r.start] == r for r in got)
    token_frames.put(f"file://{tmp_path}/one", token_frames.frames([(i, np.arange(300)) for i in range(50)], size=3000))
    seen = []
    real = token_frames.Reader.frame
    monkeypatch.setattr(token_frames.Reader, "frame", lambda self, i: seen.append(i) or real(self, i))
    out = list(token_frames._documents(f"file://{tmp_path}/one", 0, [4, 5, 40]))
    assert [x for b in out for x in b.column(0).to_pylist()] == [4, 5, 40] and seen == [25, 2, 20]


def test_word_pieces():
    r = random.Random(5)
    for _ in range(30):
        first = {bytes(r.choices(b"abc", k=r.randrange(1, 5))) for _ in range(8)}
        later = {bytes(r.choices(b"abc", k=r.randrange(1, 5))) for _ in range(8)}
        words = [bytes(r.choices(b"abcd", k=r.randrange(1, 12))) for _ in range(60)]
        own = wordpiece.Automaton(first, later)
        o = np.r_[0, np.cumsum([len(w) for w in words])]
        got = own.counts(np.frombuffer(b"".join(words), np.uint8), o[:-1], o[1:])
        assert got.tolist() == [brute.wordpieces(w, first, later) for w in words]


def test_word_piece_query(spark, real):
    first, later = map(set, wordpiece.vocabulary(RANKS))
    got = {r.doc_id: (r.n_words, r.n_pieces, r.n_unknown) for r in queries.op4_wordpiece_counts(spark, SF).collect()}
    for d, t in real:
        each = [brute.wordpieces(w.encode(), first, later) if len(w.encode()) <= 200 else 0 for w in brute.words(t)]
        assert got[d] == (len(each), sum(max(1, x) for x in each), sum(x == 0 for x in each))
    out = wordpiece.pieces(frame(spark, [None, "", " ", "the " + "x" * 500]), RANKS, longest=200).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_pieces, r.n_unknown) for r in out] == [(0, 0, 0)] * 3 + [(2, 2, 1)]


def test_long_words_are_read(spark, tmp_path):
    """Words above 200 bytes in the query: Chinese, a URL, base64, one that pieces don't cover."""
    first, later = map(set, wordpiece.vocabulary(RANKS))
    r = random.Random(12)
    texts = ["the " + "x" * 500, "日本語テキスト" * 30 + " end", "http://site.org/" + "a1b2/" * 80, "".join(r.choices("ABCabc019+/", k=700)), "\x01" * 300 + " a"]
    texts += [" ".join("".join(r.choices("abcxyz", k=r.randrange(150, 260))) for _ in range(9)) for _ in range(20)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: (x.n_words, x.n_pieces, x.n_unknown) for x in queries.op4_wordpiece_counts(spark, str(tmp_path)).collect()}
    for d, t in enumerate(texts):
        each = [brute.wordpieces(w.encode(), first, later) for w in brute.words(t)]
        assert got[d] == (len(each), sum(max(1, x) for x in each), sum(x == 0 for x in each))
    assert got[0][1] > 2 and got[1][1] > 30


def test_words_of_one_long_text(monkeypatch):
    text = ("ab  cde\nf" * 3000 + "y" * 900).encode()
    b = np.frombuffer(text, np.uint8)
    whole = flat.words(b, np.array([0, len(b)]))
    monkeypatch.setattr(flat, "BLOCK", 500)
    for x, y in zip(whole, flat.words(b, np.array([0, len(b)]))):
        assert (x == y).all()


def test_line_frequency_query(spark, real):
    got = {r.doc_id: r for r in queries.op1_line_frequency(spark, SF).collect()}
    for d, t in real:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_measures(t)
        assert not (r.kept and r.base_failed)


def test_frequent_lines_go(spark):
    r = random.Random(2)
    body = [" ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(30)) for _ in range(60)]
    rows = [(i, f"Page {i} of 99\n{b}\npage 7 OF 12\n\nend", "a", 1) for i, b in enumerate(body)]
    rows += [(100 + i, "Page 1 of 99\n" + " ".join(["Shared line of words that is on every page here"] * 1) + f"\nPage {i} of 9 k{i}", "a", 1) for i in range(3)]
    rows += [(200, body[0] + "\nPage 3 of 99", "b", 1), (201, None, "a", 1), (None, body[1], None, 1)]
    rows += [(300 + i, "same text again and again " * 6, "a", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    verdict, often = line_frequency.judged(docs, min_docs=20, percent_of_host=1)
    assert sorted((r.host, r.documents) for r in often.collect()) == [("a", 60), ("a", 61)]
    v = {r.doc_id: r for r in verdict.collect()}
    assert v[0].removed_words == 4 + 4 + 1 and v[0].kept and v[200].removed_words == 0 and not v[201].kept
    kept = {r.doc_id: r for r in line_frequency.filtered(docs, min_docs=20, percent_of_host=1).collect()}
    assert kept[0].text == body[0] + "\n" and kept[0].n_chars == len(body[0]) + 1 and kept[200].text == rows[63][1]
    assert 201 not in kept and None in kept and docs.columns == line_frequency.filtered(docs).columns
    assert line_frequency.filtered(docs.limit(0)).count() == 0


def hosted(seed=7):
    """Hosts of 12, 60 and 300 documents: a footer in a third of each, a line in few of each, documents that are all footer."""
    r = random.Random(seed)
    word = lambda n: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(n))
    foot = "\n".join(word(14) for _ in range(4))
    docs = []
    for size in (12, 60, 300):
        for i in range(size):
            lines = [word(20), word(15)] + (["Seldom seen line of  text"] if i < 2 else [])
            if i % 2 == 0:
                lines = [word(25), foot.upper() if i % 4 else foot, f"page {i} of 99"]
            if i % 10 == 5:
                lines = [word(9), foot, f"Page {i} of 7"]
            docs.append((len(docs), "\n".join(lines), f"host{size}"))
    return docs


def test_frequent_lines_with_production_limits(spark):
    docs = hosted()
    often = brute.frequent_lines(docs)
    want = brute.line_verdicts(docs, often)
    assert {h for h, _ in often} == {"host12", "host60", "host300"} and not any("seldom" in x for _, x in often)
    table = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, source string, n_chars int")
    verdict, lines = line_frequency.judged(table)
    assert sorted((r.host, r.documents) for r in lines.collect()) == sorted((h, n) for (h, _), n in often.items())
    assert {r.doc_id: (r.removed_words, r.kept) for r in verdict.collect()} == {d: x[:2] for d, x in want.items()}
    assert {k for _, k, _ in want.values()} == {True, False}
    stage = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, table, SF).collect()}
    assert stage == {d: t for d, (_, kept, t) in want.items() if kept}


def test_documents_that_are_mostly_boilerplate_count_each(spark):
    """300 different documents of 10 own shingles and a shared footer of 56; copies up to case, spaces and digits count once."""
    r = random.Random(3)
    word = lambda n: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(n))
    foot = word(60)
    texts = [f"{word(10)}\n{foot}" for _ in range(300)]
    texts += [texts[0].upper(), texts[1].replace(" ", "  "), texts[2]]
    docs = [(i, t, "a") for i, t in enumerate(texts)]
    verdict, lines = line_frequency.judged(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert [(r.host, r.documents) for r in lines.collect()] == [("a", 300)] == [(h, n) for (h, _), n in brute.frequent_lines(docs).items()]
    assert not any(r.kept for r in verdict.collect())


def test_leaks_query(spark, real):
    items = [(int(i), t) for i, t in pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    want = brute.leaks(real, items)
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontamination(spark, SF).collect()}
    assert want and got == want


def test_leaks_recall_and_edges(spark):
    r = random.Random(8)
    word = lambda n: [f"q{r.randrange(5000)}" for _ in range(n)]
    items = [(i, " ".join(word(r.choice([1, 3, 5, 8, 12, 20, 33, 60, 150])))) for i in range(60)] + [(90, None), (91, " "), (None, "a b c d e f")]
    docs = []
    for i in range(150):
        w = r.choice(items[:60])[1].split()
        if len(w) > 30 and i % 3 == 0:
            w[len(w) // 2] = "changed"
        docs.append((i, " ".join(word(r.randrange(3000)) + [x.upper() for x in w] + word(r.randrange(50)))))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, items[20][1]), (502, items[20][1])]
    want = brute.leaks([d for d in docs if d[0] is not None], [x for x in items if x[0] is not None])
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id) for x in contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()]
    assert set(got) == want and len(got) == len(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert contamination.leaks(empty, table).count() == 0 and contamination.leaks(frame(spark, ["a"]), table.limit(0)).count() == 0
    left = contamination.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), table)
    assert {x.doc_id for x in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_recall_by_item_length(spark):
    """Ten items of every length from 1 to 20 words, and longer ones, each once in a long document: all are found."""
    r = random.Random(11)
    word = lambda n: [f"z{r.randrange(20000)}" for _ in range(n)]
    sizes = [n for n in [*range(1, 21), 40, 90] for _ in range(10)]
    items = [(i, " ".join(f"item{i}x{j}" for j in range(n))) for i, n in enumerate(sizes)]
    docs = [(i, " ".join(word(r.randrange(2000)) + t.split() + word(r.randrange(2000)))) for i, t in items]
    got = {(x.doc_id, x.item_id) for x in contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items}


PRIVATE = ["a@b.c@d.e x.y+z%q-1@h-1.co.uk.", "a@b.c_d@e.f", "@x.y a@b a@b. a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.01 1.2.3.99999999999999999999999", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+1 (988) 555-2485 +44 20.7946.0958- +1 2 ++33 1 23 45 67 89", "+12345678901234567890", "é🙂é me@site.org 日本 10.0.0.1", "9" * 5000, "a" * 20000, "a." * 3000 + "@b.c", "x@" + "b." * 3000 + "c", "- 1 2 3", "", None, "1-2-3-4 5 6", "4539 1488 0343 6467\n+4915123456789"]


def test_base_spans(spark):
    r = random.Random(4)
    bits = ["a", "9", ".", "@", "-", " ", "+", "(", ")", "4111111111111111", "10.0.0.1", "me@x.org", "é", "🙂", "1", "_", "%"]
    texts = PRIVATE + ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(300)]
    got = {r.doc_id: r for r in disclosure.digest(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute.base_spans(t)
        assert got[i].base_spans == ",".join(want), repr(t[:80])
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]


def test_disclosure_query(spark, real):
    got = {r.doc_id: r for r in queries.op3_disclosure(spark, SF).collect()}
    for d, t in real:
        assert got[d].base_sha256 == hashlib.sha256(",".join(brute.base_spans(t)).encode()).hexdigest()
        assert got[d].spans.startswith(",".join(brute.base_spans(t)))


def test_terms_that_reveal(spark):
    texts = [f"case {w} of Zorblatt writes from jo@corp.org about {w} things" for w in "abcdef"] + ["nothing here about anything", "Plain things about case writes from"] * 10
    texts += [None, ""]
    docs = frame(spark, texts)
    got = {r.doc_id: r.spans.split(",") for r in disclosure.digest(docs).collect()}
    at = texts[0].index("Zorblatt")
    assert f"term:{at}:{at + 8}" in got[0] and got[6] == [""] and not any("term" in s for s in got[7])
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "Zorblatt" not in clean[0] and "jo@corp.org" not in clean[0] and "[EMAIL]" in clean[0] and clean[6] == texts[6] and clean[len(texts) - 2] is None
    assert disclosure.digest(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "me@x.org", 1, 2, 3), (None, "me@x.org", 1, 2, 3), (1, "me@x.org 10.0.0.1", 4, 5, 6)], "doc_id long, text string, start int, kind int, entity int")
    assert sorted(r.text for r in disclosure.sanitised(twice).collect()) == ["[EMAIL]", "[EMAIL]", "[EMAIL] [IP]"]
    assert disclosure.sanitised(twice).columns == twice.columns


def test_terms_count_in_whole_texts_and_go_everywhere(spark):
    """Terms far from the mention, entities of one or two documents, holders of a term that don't mention the entity."""
    r = random.Random(6)
    vocabulary = ["".join(r.choices("abcdefgh", k=5)) for _ in range(150)]
    word = lambda n: " ".join(r.choices(vocabulary, k=n))
    texts = [word(r.randrange(5, 60)) for _ in range(300)]
    for i in range(0, 60, 3):
        texts[i] = f"Zor{'abcdefghijklmnopqrst'[i // 3] * 4} {word(30)} p{i // 6}@corp.org {word(20)} 10.0.{i % 9}.1"
    texts += [f"Quillon {word(30)} jo@corp.org {word(3)}" for _ in range(8)] + ["the QUILLON elsewhere", "zoraaaa again, xzoraaaa", f"{word(20)} Snarkwell {word(20)} solo@corp.org"]
    docs = list(enumerate(texts))
    want = brute.revealing_spans(docs)
    got = {x.doc_id: [y for y in x.spans.split(",") if y.startswith("term")] for x in disclosure.digest(frame(spark, texts)).collect()}
    assert got == want and want[308] == ["term:4:11"] and "term:0:7" in want[300] and want[310]
    clean = {x.doc_id: x.text for x in disclosure.sanitised(frame(spark, texts)).collect()}
    assert "quillon" not in clean[308].lower() and "Snarkwell" not in clean[310]
