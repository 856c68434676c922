"""Secret scanning: fixed patterns plus a linear-chain conditional random field.

``scan`` finds three kinds of pattern spans (assign, access, hex) and adds the
spans of kind ``crf`` that a linear-chain CRF tags as begin/inside.  Tokens are
runs of ``[A-Za-z0-9+/_.-]`` with trailing ``=``.  A token that could not be a
secret (no digit and under 20 characters, or under 6 characters) is held to
``O``, and so is what stands before the first and after the last token.  A fixed
label parts a chain, so only the runs of candidate tokens between held ones are
decoded, with the transitions from and to the held neighbours: the labels are
those of the whole chain.  Whatever separators stand between two candidates,
they are neighbours unless a token does.

Defined results: a null text is an empty text; empty texts have no spans; rows
that repeat are scanned each on its own; extra columns of the input are ignored.
The CRF is trained here, by gradient ascent on the exact log-likelihood, on
``TRAIN_LINES`` generated lines (a fixed seed), so it needs no table.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import changed, map_texts, steps, table, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters
_NAMES = ("password", "passwd", "secret", "token", "api")

#: A candidate: 6 characters with a digit, or 20 without.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.\-])(?:(?=[A-Za-z+/_.\-]*[0-9])[A-Za-z0-9+/_.\-]{6,}|[A-Za-z0-9+/_.\-]{20,})={0,2}")
_TOKEN_CHAR = re.compile(r"[A-Za-z0-9+/_.\-]")
_NEXT = re.compile(r"[^A-Za-z0-9_]{0,4}([A-Za-z_]+)?")
_CONTEXT = re.compile(r"([A-Za-z_]+)?([^A-Za-z0-9_\s])?\s*([^A-Za-z0-9_\s])?$")
KEY_WORDS = frozenset("password passwd pwd secret token key apikey api_key credential credentials auth bearer private access signature hmac".split())
#: Words before the name of a version, which is often hexadecimal.
VERSION_WORDS = frozenset("commit commits revision rev build hash sha sha1 checksum digest version blob tree merge parent".split())
#: Beginnings of keys as their issuers publish them.
ISSUED = tuple("AIza AKIA ASIA SG. dop_v1_ eyJ gho_ ghp_ ghr_ ghs_ ghu_ github_pat_ glpat- hf_ npm_ pypi- rk_live_ shpat_ sk- sk_live_ sk_test_ xapp- xoxa- xoxb- xoxp- ya29.".split())
LABELS = ("O", "B", "I")
TRAIN_LINES = 3000
#: The chain's margin: a begin must beat outside by this much, so that prose is left alone.
BEGIN_MARGIN = 1.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans in the order of kinds; leftmost, non-overlapping within a kind."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


_ORDER = {k: i for i, k in enumerate(("assign", "access", "hex", "crf"))}


def ordered(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2])))


# --- features --------------------------------------------------------------

_CLASS = str.maketrans({**dict.fromkeys(string.ascii_lowercase, "a"), **dict.fromkeys(string.ascii_uppercase, "A"), **dict.fromkeys(string.digits, "0")})


def file_features(text: str) -> tuple[str, ...]:
    """What the whole file says: whether it looks like code or settings, and whether it speaks of secrets."""
    n = len(text) or 1
    marks = sum(text.count(c) for c in "{}=;")
    low = text.lower()
    return (f"file.marks={min(3, 200 * marks // n)}", f"file.speaks={any(w in low for w in _NAMES)}")


def token_features(text: str, start: int, end: int, of_file: tuple[str, ...]) -> list[str]:
    token = text[start:end]
    shape = token.translate(_CLASS)
    n = end - start
    digits, upper, lower = shape.count("0"), shape.count("A"), shape.count("a")
    turns = sum(a != b for a, b in zip(shape, shape[1:]))
    left = _CONTEXT.search(text[max(0, start - 32) : start])
    word, mark = (left[1] or "").lower(), left[3] or left[2] or ""
    after = text[end : end + 1]
    follows = (_NEXT.match(text, end)[1] or "").lower()
    counts = np.array(list(Counter(token).values())) / n
    spread = int(-4 * (counts * np.log2(counts)).sum() / max(1.0, np.log2(n)))  # of the largest entropy a token so long can have, in quarters
    hexa = all(c in "0123456789abcdef" for c in token)
    kinds = (digits > 0) + (upper > 0) + (lower > 0)
    out = [
        "bias", f"len={min(n, 48) // 8}", f"kinds={kinds}", f"turns={min(7, 8 * turns // n)}", f"digits={4 * digits // n}",
        f"hex={hexa}{'' if not hexa else ' short' if n < 20 else ' long'}", f"spread={spread}", f"issued={n >= 16 and token.startswith(ISSUED)}", f"only={'digit' if digits == n else 'alpha' if upper + lower == n else 'mix'}",
        f"sep={sum(token.count(c) for c in '._-/') > 0}", f"pad={token.endswith('=')}", f"runs={2 * turns // max(1, kinds * kinds)}"[:7],
        f"mark={mark if mark in set('=:') else 'quote' if mark and mark in chr(34) + chr(39) + '`' else 'other' if mark else 'none'}", f"after={'quote' if after and after in chr(34) + chr(39) + '`' else 'space' if after.isspace() or not after else 'other'}",
        f"word={'key' if word in KEY_WORDS or word.endswith(('_key', '_token', '_secret')) else 'version' if word in VERSION_WORDS else 'other' if word else 'none'}", f"repeat={len(set(token)) * 3 < n}",
        f"next={'key' if follows in KEY_WORDS or follows.endswith(('_key', '_token', '_secret')) else 'other' if follows else 'none'}",
    ]
    return out + list(of_file)


# --- the chain --------------------------------------------------------------


class Chain:
    """Weights of a linear-chain CRF over the labels O, B, I."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.emit = np.zeros((0, 3))
        self.move = np.zeros((3, 3))

    def rows(self, features: list[list[str]], grow: bool = False) -> list[list[int]]:
        if grow:
            for fs in features:
                for f in fs:
                    self.index.setdefault(f, len(self.index))
        return [[self.index[f] for f in fs if f in self.index] for fs in features]

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[r].sum(axis=0) for r in rows])

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best labels between two held to O; ties go to the label listed first.  I follows B or I only."""
        move = self.move + np.array([[0, -BEGIN_MARGIN, -1e9], [0, -BEGIN_MARGIN, 0], [0, -BEGIN_MARGIN, 0]])
        best = move[0] + scores[0]
        back = []
        for s in scores[1:]:
            step = best[:, None] + move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s
        path = [int((best + move[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def likelihood(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Chains of one length: the sum of their log-likelihoods, and its derivatives by the weights.

        ``x``: features by chain, place and slot; ``y``: labels by chain and place.  O stands before and after each chain.
        """
        de, dm = np.zeros_like(self.emit), np.zeros((3, 3))
        e = self.emit[x].sum(axis=2)
        last = e.shape[1] - 1
        alpha = [e[:, 0] + self.move[0]]
        for t in range(1, last + 1):
            alpha.append(np.logaddexp.reduce(alpha[-1][:, :, None] + self.move, axis=1) + e[:, t])
        beta = [np.zeros_like(e[:, 0]) + self.move[:, 0]]
        for t in range(last, 0, -1):
            beta.append(np.logaddexp.reduce(self.move + (e[:, t] + beta[-1])[:, None, :], axis=2))
        beta.reverse()
        z = np.logaddexp.reduce(alpha[-1] + beta[-1], axis=1)
        given = self.move[0, y[:, 0]] + self.move[y[:, -1], 0] + sum(np.take_along_axis(e[:, t], y[:, t, None], 1)[:, 0] for t in range(last + 1)) + sum(self.move[y[:, t - 1], y[:, t]] for t in range(1, last + 1))
        for t in range(last + 1):
            seen = np.exp(alpha[t] + beta[t] - z[:, None])
            p = np.eye(3)[y[:, t]] - seen
            np.add.at(de, x[:, t].ravel(), np.repeat(p, x.shape[2], axis=0))
            if t:
                both = np.exp(alpha[t - 1][:, :, None] + self.move + (e[:, t] + beta[t])[:, None, :] - z[:, None, None])
                dm -= both.sum(axis=0)
                np.add.at(dm, (y[:, t - 1], y[:, t]), 1.0)
            else:
                dm[0] += p.sum(axis=0)
            if t == last:
                dm[:, 0] += p.sum(axis=0)
        return float((given - z).sum()), de, dm

    def fit(self, chains: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.5, l2: float = 1e-3) -> "Chain":
        """Full-batch Adagrad on the exact log-likelihood (forward and backward sums)."""
        data = [(self.rows(f, grow=True), y) for f, y in chains]
        width = max(len(r) for rows, _ in data for r in rows)
        n = len(self.index)
        self.emit = np.zeros((n + 1, 3))
        by_len: dict[int, list[tuple[list[list[int]], list[int]]]] = {}
        for rows, y in data:
            by_len.setdefault(len(y), []).append((rows, y))
        packed = []
        for length, group in by_len.items():
            x = np.full((len(group), length, width), n)
            for i, (rows, _) in enumerate(group):
                for t, r in enumerate(rows):
                    x[i, t, : len(r)] = r
            packed.append((x, np.array([y for _, y in group])))
        ge, gm, total = np.full_like(self.emit, 1e-8), np.full((3, 3), 1e-8), len(data)
        for _ in range(rounds):
            de, dm = np.zeros_like(self.emit), np.zeros((3, 3))
            for x, y in packed:
                _, e, m = self.likelihood(x, y)
                de, dm = de + e, dm + m
            de, dm = de / total - l2 * self.emit, dm / total - l2 * self.move
            de[n] = 0
            ge, gm = ge + de**2, gm + dm**2
            self.emit += rate * de / np.sqrt(ge)
            self.move += rate * dm / np.sqrt(gm)
        self.emit = self.emit[:n]
        return self


def generated(lines: int = TRAIN_LINES, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines of prose, settings and code, with the places of the secrets put into them."""
    r = random.Random(seed)
    syllables = "the an on re th in er ti es or ing ion le ou de la que en el ar un ch ge be sch".split()
    word = lambda a=1, b=4: "".join(r.choice(syllables) for _ in range(r.randint(a, b)))
    text = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    alnum = string.ascii_letters + string.digits
    secrets = (
        lambda: text("0123456789abcdef", 24, 64), lambda: text(alnum, 20, 44), lambda: text(alnum + "+/", 24, 64) + r.choice(("", "=", "==")), lambda: "AKIA" + text(string.ascii_uppercase + string.digits, 16, 16),
        lambda: r.choice(ISSUED) + text(r.choice((alnum, alnum + "_-", string.ascii_lowercase + string.digits)), 16, 40) + r.choice("0123456789"), lambda: text(alnum, 10, 16) + r.choice("0123456789"), lambda: ".".join(text(alnum + "_-", 20, 30) for _ in range(3)),
        lambda: r.choice((" ", ":", "~")).join(text(alnum, 10, 16) + r.choice("0123456789") for _ in range(r.randint(2, 4))),
    )
    plain = (
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: text(string.digits, 8, 16), lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 999)}", lambda: word(2, 4) + str(r.randint(1, 2030)),
        lambda: "/".join(word() for _ in range(4)) + str(r.randint(0, 9)), lambda: f"{word()}.{r.randint(1, 99)}", lambda: word(8, 14), lambda: f"{word()}_{word()}_{r.randint(0, 99)}", lambda: "-".join(text(string.digits, 3, 4) for _ in range(3)), lambda: f"www.{word(2)}.example{r.randint(1, 9)}.com",
        lambda: "".join((word(1, 3), ".", word(1, 2), str(r.randint(1, 99)))), lambda: word().title() + word().title() + str(r.randint(1, 9)) + word(), lambda: "-" * r.randint(20, 40), lambda: text("01", 8, 20),
        lambda: r.choice((" ", ":", ",")).join(text(string.digits, 8, 12) for _ in range(r.randint(2, 4))),
        lambda: f"{r.choice(('https', 'http'))}://{word()}.example.{r.choice(('com', 'org'))}/" + "/".join(r.choice((word(), str(r.randint(1, 31)), str(r.randint(1990, 2030)), f"{word()}-{r.randint(1, 99)}")) for _ in range(r.randint(1, 5))),
        lambda: f"{r.choice(('commit', 'revision', 'build', 'hash', 'in', 'see', word()))} {text('0123456789abcdef', 6, 12)}", lambda: f"{r.choice(('commit', 'sha', 'version', 'merge'))}{r.choice((' ', ': ', '='))}{text('0123456789abcdef', 7, 12)}", lambda: f"{word(2, 4)}/{word()}-{r.randint(1, 99)}.{r.choice(('html', 'pdf', 'tar', 'py'))}",
    )
    out = []
    for _ in range(lines):
        parts, spans, at = [], [], 0

        def put(s: str, secret: bool = False) -> None:
            nonlocal at
            if secret:
                spans.append((at, at + len(s)))
            parts.append(s)
            at += len(s)

        for _ in range(r.randint(1, 4)):
            for _ in range(r.randint(2, 8)):
                put(word() + r.choice((" ", " ", " ", ", ", ". ")))
            kind = r.random()
            if kind < 0.45:
                put(r.choice(plain)() + r.choice((" ", ", ", ". ")))
            elif kind < 0.8:
                quote = r.choice(('"', "'", ""))
                put(r.choice(("password", "secret", "token", "api_key", "access", "auth", "private_key", word())) + r.choice((" = ", "=", ": ", ":")) + quote)
                put(text(string.ascii_lowercase, 3, 8) + text(string.digits, 1, 3) + text(string.ascii_lowercase + "!", 0, 4) if r.random() < 0.25 else r.choice(secrets)(), secret=True)
                put(quote + r.choice((" ", "; ", "\n")))
            elif kind < 0.9:
                put(f"{word()} = ")
                put(r.choice(plain)())
                put(r.choice((" ", "\n")))
            else:
                put(r.choice(secrets[:5])(), secret=True)
                put(" ")
        out.append(("".join(parts), spans))
    return out


def candidate_runs(text: str) -> list[list[tuple[int, int]]]:
    """Candidate tokens, those without another token between them in one run."""
    runs: list[list[tuple[int, int]]] = []
    last = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if runs and not _TOKEN_CHAR.search(text, last, a):
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
        last = b
    return runs


@lru_cache(maxsize=1)
def trained() -> Chain:
    chains = []
    for text, secrets in generated():
        of_file = file_features(text)
        for run in candidate_runs(text):
            y, inside = [], False
            for a, b in run:
                hit = any(a < e and s < b for s, e in secrets)
                y.append(0 if not hit else 2 if inside else 1)
                inside = hit
            chains.append(([token_features(text, a, b, of_file) for a, b in run], y))
    return Chain().fit(chains)


def crf_spans(text: str, chain: Chain) -> list[tuple[str, int, int]]:
    runs = candidate_runs(text)
    if not runs:
        return []
    of_file, out = file_features(text), []
    for run in runs:
        rows = [chain.rows([token_features(text, a, b, of_file)])[0] for a, b in run]  # by token, as a run can be long
        start = None
        for (a, b), label in zip(run, chain.viterbi(chain.scores(rows))):
            if label == 2 and start is not None:
                out[-1] = ("crf", start, b)
            elif label:
                start = a
                out.append(("crf", a, b))
            else:
                start = None
    return out


def scan_texts(values: list[str], chain: Chain) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans")}
    for text in values:
        base = base_spans(text)
        added = crf_spans(text, chain)
        for kind in ("assign", "access", "hex"):
            out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
        out["n_crf"].append(len(added))
        out["base_sha256"].append(hashlib.sha256(ordered(base).encode()).hexdigest())
        out["spans"].append(ordered(base + added))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by kind, a digest of the pattern spans, all spans as ``kind:start:end``."""
    given = docs.sparkSession.sparkContext.broadcast(trained())

    def make():
        chain = given.value
        return lambda values: scan_texts(values, chain)

    return map_texts(docs, id_col, text_col, make, "n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redact(text: str, spans: str, mask: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones as one, put as ``mask``."""
    at, parts = 0, []
    for a, b in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s)):
        if b <= at:
            continue
        if a >= at:
            parts += [text[at:a], mask]
        at = b
    return "".join(parts) + text[at:]


def clean(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """All documents and columns, every found span masked; ``length_col``, where there is one, follows the text."""
    given = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        chain = given.value
        for batch in steps(batches, text_col):
            new = []
            for text in texts(batch, text_col):
                spans = base_spans(text) + crf_spans(text, chain)
                new.append(redact(text, ordered(spans), mask) if spans else None)
            yield changed(batch, text_col, new, length_col)

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")
