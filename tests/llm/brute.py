"""Plain Python versions of the contracts; small inputs only."""
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def shingle_set(text, k):
    w = words(lower(text))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard_components(docs, k, percent):
    """docs: (doc_id, text) -> {doc_id: (n, component)}"""
    sets = [(d, shingle_set(t, k)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, (d, s) in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j > i}:
            e, t = sets[j]
            inter = len(s & t)
            if 100 * inter >= percent * (len(s) + len(t) - inter):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets}


def substring_removal(docs, width):
    seen, out = {}, {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            seen[g] = min(d, seen.get(g, d))
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_measures(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i:i + 8]), []).append(i)
    repeated = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), n < 20 or 100 * len(repeated) > 30 * n


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def leaks(docs, items, k=5, percent=80):
    grams = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
    cut = {i: words(lower(t)) for i, t in items}
    size = {i: min(k, len(w)) for i, w in cut.items()}
    sets = {i: grams(w, size[i]) for i, w in cut.items()}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, set()).add(i)
    out = set()
    for d, t in docs:
        w = words(lower(t))
        s = set().union(*(grams(w, n) for n in {*size.values()} if n)) if w else set()
        for i in {i for g in s for i in holders.get(g, ())}:
            if 100 * len(s & sets[i]) >= percent * len(sets[i]):
                out.add((d, i))
    return out


def wordpieces(word, first, later):
    """Greedy longest match; 0 if it fails."""
    at, n = 0, 0
    while at < len(word):
        vocab = later if at else first
        to = next((z for z in range(len(word), at, -1) if word[at:z] in vocab), None)
        if to is None:
            return 0
        at, n = to, n + 1
    return n


def normalised(text):
    return " ".join(re.sub("[0-9]+", "0", w) for w in words(lower(text)))


def frequent_lines(docs, min_docs=5, percent=0.5):
    """docs: (doc_id, text, host) -> {(host, normalised line): distinct documents}"""
    holders, hosts = {}, {}
    for _, t, h in docs:
        hosts.setdefault(h, set()).add(normalised(t))
        for line in {normalised(x) for x in (t or "").split("\n")} - {""}:
            holders.setdefault((h, line), set()).add(normalised(t))
    return {k: len(v) for k, v in holders.items() if len(v) > min_docs and len(v) * 100 > len(hosts[k[0]]) * percent}


def line_verdicts(docs, often):
    """doc_id -> (removed words, kept, text without the frequent lines)"""
    out = {}
    for d, t, h in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if (h, normalised(x)) not in often]
        n, m = len(words(t)), sum(len(words(x)) for x in left)
        out[d] = n - m, not base_measures(t)[-1] and m >= 10 and m * 100 >= n * 20, "\n".join(left)
    return out


def revealing_spans(docs, generalise=0.9):
    """docs: distinct (doc_id, text) -> {doc_id: term spans}; ASCII texts"""
    import math
    terms = {d: set(re.findall("[a-z]{3,}", t.lower())) for d, t in docs}
    entities = {}
    for d, t in docs:
        for x in base_spans(t):
            kind, a, b = x.split(":")
            m = t[int(a):int(b)]
            entities.setdefault((kind, re.sub("[^0-9]", "", m) if kind in ("card", "phone") else m.lower()), set()).add(d)
    holders = {}
    for d, own in terms.items():
        for x in own:
            holders.setdefault(x, set()).add(d)
    n, strong = len(docs), set()
    for own in entities.values():
        for x in {x for d in own for x in terms[d]} if len(own) < n else ():
            if math.log(len(own & holders[x]) * n / (len(own) * len(holders[x]))) / math.log(n / len(own)) >= generalise:
                strong.add(x)
    out = {}
    for d, t in docs:
        base = [tuple(map(int, x.split(":")[1:])) for x in base_spans(t)]
        runs = [(m.start(), m.end()) for m in re.finditer("[A-Za-z]{3,}", t) if m[0].lower() in strong]
        out[d] = [f"term:{a}:{b}" for a, b in runs if not any(x < b and y > a for x, y in base)]
    return out


def line_removal(docs, least=40, holders=5):
    """docs: (doc_id, text) rows -> list of (doc_id, lines, dropped, kept text)"""
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    held = {}
    for d, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held.setdefault(k, []).append(d)
    top = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= holders}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in top and top[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def periodic_words(doc_id, text):
    """The words of a document after the planted change."""
    import zlib
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_runs(w, least=6, times=4):
    """(start, length, period) of all maximal repetitions, by start and period."""
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                best.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def collocations(docs, longest=3, least=10, percent=50, top=2000):
    """docs: (lang, text) -> {(lang, rank): (phrase, a, l, r, n, score)}"""
    counts, total = {}, {}
    for lang, t in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    g = (lang, *w[i:i + k])
                    counts[g] = counts.get(g, 0) + 1
    found = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    hidden = set()
    for g, a in found.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                if 100 * a >= percent * found[(g[0], *g[i:i + k])]:
                    hidden.add((g[0], *g[i:i + k]))
    rows = {}
    for g, a in found.items():
        if g not in hidden:
            cut = min(((1000000 * a * a // (l * r), k, l, r) for k in range(2, len(g)) for l, r in [(counts[g[:k]], counts[(g[0], *g[k:])])]))
            rows.setdefault(g[0], []).append((-cut[0], -a, " ".join(g[1:]).encode(), cut[2], cut[3]))
    return {(lang, k): (p.decode(), -a, l, r, total[lang], -s) for lang, x in rows.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}
