"""Hashes of ranges, sequences and windows: Thue-Morse words collide under every polynomial modulo a power of two."""
import random

import numpy as np
import public_tokenizers
import pytest

from meterloom.llm import bpe, flat, line_frequency, pretokens


def morse(n, a=b"a", b=b"b"):
    return b"".join(b if bin(i).count("1") % 2 else a for i in range(n))


def column(*texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(x) for x in texts])]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_complements_differ_as_words_lines_and_sequences(n):
    x, y = morse(n), morse(n, b"b", b"a")
    d, o = column(x + b" " + y)
    h = flat.words(d, o)[2]
    assert len(h) == 2 and h[0] != h[1]
    spread = lambda z: b" ".join(bytes([c]) for c in z) + b" "
    d, o = column(spread(x), spread(y))
    s, e, h, wo = flat.words(d, o)
    whole = flat.sequence_hashes(h, wo)
    assert whole[0] != whole[1] and len(set(line_frequency._line_ids(d, o, s, e, wo).tolist())) == 2
    for k in (8, 64, 512, 1024):
        seen = {}
        for a, v in zip(*flat.windows(h, wo, k)):
            seen.setdefault(tuple(h[a:a + k].tolist()), set()).add(int(v))
        assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("n", [1024, 4096])
def test_complements_decode_to_themselves(n):
    text = (morse(n) + b" " + morse(n, b"b", b"a")).decode()
    ranks = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
    import base64
    tokens = {int(r): base64.b64decode(t) for t, r in map(bytes.split, ranks.splitlines())}
    ids, _ = bpe.encoder(ranks).texts(*column(text.encode()))
    assert b"".join(tokens[i] for i in ids.tolist()).decode() == text


def test_equal_hashes_are_compared(monkeypatch):
    real = flat.range_hashes
    monkeypatch.setattr(flat, "range_hashes", lambda b, s, e, table=None, seed=0: real(b, s, e, table, seed) & flat.U(0 if seed == 0 else (1 << 64) - 1))
    d, o = column(b"one", b"two", b"one")
    code, first = flat.distinct_ranges(d, o[:-1], o[1:])
    assert code.tolist() == [0, 1, 0] and first.tolist() == [0, 1]
    assert pretokens.flat is flat


def test_ranges_hash_by_their_bytes():
    r = random.Random(1)
    texts = [" ".join(r.choice(["x", "yy", "zzz", "longerword", "é" * 9]) for _ in range(r.randrange(30))).encode() for _ in range(300)]
    d, o = column(*texts)
    s, e, h, _ = flat.words(d, o)
    seen = {}
    for a, b, v in zip(s, e, h):
        assert seen.setdefault(d[a:b].tobytes(), v) == v
    assert len(set(seen.values())) == len(seen)
    assert len(flat.range_hashes(d, o[:1], o[:1])) == 1
