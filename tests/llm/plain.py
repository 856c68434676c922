"""The operators' contracts in plain Python, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def secrets(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def quality(text):
    w = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORDS.search(line))
        seen.add(line)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def repeats(rows, size=50):
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        if i is not None:
            for p in range(len(b) - size + 1):
                first[b[p : p + size]] = min(i, first.get(b[p : p + size], i))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if i is not None and first[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingle_sets(rows, size=5):
    out = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def similar(rows, threshold=0.8):
    """``{id: (class, links)}`` over all pairs."""
    text, sets = {i: t or "" for i, t in rows}, shingle_sets(rows)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    links = defaultdict(set)
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        near = both and both / len(sets[a] | sets[b]) >= threshold
        if near or text[a] == text[b]:
            x, y = sorted((find(a), find(b)))
            top[y] = x
        if near and text[a] != text[b]:
            links[a].add(text[b])
            links[b].add(text[a])
    return {i: (find(i), len(links[i])) for i in sets}


def bench_words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(docs, items, window=10):
    grams = defaultdict(set)
    for k, t in items:
        w = bench_words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            if n:
                grams[tuple(w[i : i + n])].add(str(k))
    sizes = {len(g) for g in grams}
    out = {}
    for d, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def toxic_score(text, weights, exceptions, curve):
    """The toxicity score by looking for each entry at each place of the text, folded one character at a time."""
    import math
    import unicodedata

    from corpusloom.llm.toxicity import HOMOGLYPHS, SUBSTITUTES

    looks = dict(zip(HOMOGLYPHS[::2], HOMOGLYPHS[1::2])) | dict(zip(SUBSTITUTES[::2], SUBSTITUTES[1::2]))

    def fold(c):
        if c in looks:
            return looks[c]
        if unicodedata.category(c) in ("Mn", "Cf") and ord(c) < 0x10000:
            return ""
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if base in looks and ord(c) < 0x2500:
            return looks[base]
        if base and all("a" <= x <= "z" for x in base):
            return base
        return c.lower() if c.isalpha() else " "

    words = [w.rstrip("!|").lstrip("|") for w in text.split()]
    line = " " + " ".join("".join(fold(c) for c in " ".join(words)).split()) + " "
    spared = {p for e in exceptions for at in range(len(line)) if line.startswith(e, at) for p in range(at, at + len(e))}
    total = 0.0
    for at in range(len(line) if len(line) > 2 else 0):
        here = [w for e, w in weights.items() if line.startswith(e, at)]
        if here and at not in spared:
            total += max(here)
    n = line.count(" ") - 1 if len(line) > 2 else 0
    z = curve[0] + curve[1] * math.log1p(total) + curve[2] * math.log1p(100 * total / max(20, n))
    return 1 / (1 + math.exp(-z))


def equal_texts(rows):
    """Kept, group size and the id that stays for rows (id, text), by text; ids may be null or repeated."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        out += [(i, ids[-1], len(ids), n == len(ids) - 1, sha(t)) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def spelled(rows):
    """Counted words of rows (id, text)."""
    import zlib

    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(n, ratio=5):
    """``word, form, root, n, n_near, form_n`` by comparing all words."""
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)
