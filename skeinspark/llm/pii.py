"""Personal data: base patterns, and a linear-chain conditional random field that adds spans to them.

The field labels the blank-separated tokens of a line with begin/inside tags of the four kinds or "outside". Its features are
word shapes (digits and letters as classes, other characters as they are) of the token and its neighbours and a few cue words.
It is trained in numpy from `labelled_table()`, a small table that is spelt from templates by rule, and decoded by Viterbi
over batches of lines of similar length. Every kind of personal data that it knows holds a digit or an at sign, so only lines
with one of these are decoded; the rest of the lines can only be "outside" throughout. A decoded span is added if it passes
its kind's checks and touches no base span; base spans all stay.

Defined cases: a null or empty text has no spans; very long lines are decoded whole; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skeinspark.llm.common import map_texts, read

#: The kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
#: An email's parts around its at sign, and the ip pattern tried once for each run of digits: the same matches in linear time.
LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
SIGN = re.compile("[0-9@]")
EDGES = re.compile(r"^[^0-9A-Za-z+(]*(.*?)[^0-9A-Za-z)]*$", re.DOTALL)
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
CUES = ("call", "phone", "tel", "tel.", "mobile", "fax", "card", "visa", "ip", "host", "mail", "email", "e-mail", "id", "ref", "order", "no", "version", "page", "from", "at")
SPACE_BITS = 14
LABELLED_ROWS = 700
CACHED_TOKENS = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain that don't overlap."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end), by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """Digits as d, upper and lower case as A and a, runs of letters cut to three, other characters as they are."""
    s = re.sub(r"\d", "d", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", token))
    return re.sub(r"(a|A)\1{3,}", r"\1\1\1", s)


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") & ((1 << SPACE_BITS) - 1)


def token_slots(token: str) -> tuple[list[int], list[int], list[int]]:
    """Feature slots for the token itself, for the token after it and for the one before it."""
    s, low = shape(token), token.lower().strip(":,.")
    core = EDGES.match(s)[1]
    n = sum(c == "d" for c in s)
    short = re.sub(r"(.)\1+", r"\1", core)
    own = ["bias", f"s={core}", f"c={short}", f"n={min(n, 20)}", f"at={'@' in s}", f"first={core[:1]}", f"long={min(len(core), 24)}", f"only={n == len(core)}"]
    cue = low if low in CUES else "-"
    near = [f"c={short}" if n else "word", f"cue={cue}", f"n={min(n, 20)}"]
    return [_slot("own " + x) for x in own], [_slot("before " + x) for x in near], [_slot("after " + x) for x in near]


def labelled_table(rows: int = LABELLED_ROWS, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Tokens and tags of short lines: templates with or without personal data, and numbers that are none."""
    rng = np.random.default_rng(seed)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("aeiounrstlhd"), rng.integers(2, 10))).capitalize() if rng.random() < 0.15 else "".join(rng.choice(list("aeiounrstlhd"), rng.integers(1, 10)))
    octets = lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))
    makers = {
        0: [lambda: [f"{word()}.{d(2)}@{word()}.example.com"], lambda: [f"{word()}_{word()}@{word()}.org"], lambda: [f"{word()}@{word()}-{d(1)}.net"]],
        1: [lambda: [octets()], lambda: [f"{octets()}:{d(4)}"]],
        2: [lambda: [d(16)], lambda: [d(4), d(4), d(4), d(4)], lambda: ["-".join(d(4) for _ in range(4))], lambda: [d(4), d(6), d(5)]],
        3: [
            lambda: ["+1", f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"({d(3)})", f"{d(3)}-{d(4)}"], lambda: [f"({d(3)}){d(3)}-{d(4)}"],
            lambda: [f"{d(3)}-{d(3)}-{d(4)}"], lambda: [f"{d(3)}.{d(3)}.{d(4)}"], lambda: [f"+{d(2)}", d(3), d(3), d(4)], lambda: [f"+{d(11)}"], lambda: [d(3), f"{d(3)}-{d(4)}"],
        ],
    }
    others = [
        lambda: [d(int(rng.integers(1, 9)))], lambda: [f"{d(4)}-{d(2)}-{d(2)}"], lambda: [f"{d(1)}.{d(1)}.{d(2)}"], lambda: [f"${d(2)}.{d(2)}"], lambda: [f"{d(2)}:{d(2)}"],
        lambda: ["".join(rng.choice(list("0123456789abcdef"), 40))], lambda: ["token", "=", '"' + "".join(rng.choice(list("0123456789abcdef"), 40)) + '"'], lambda: [f"#{d(5)}"],
        lambda: [f"{d(3)}%"], lambda: [d(22)], lambda: ["page", d(3)], lambda: ["version", f"{d(1)}.{d(1)}"], lambda: ["order", f"{d(3)}-{d(2)}"], lambda: [f"{d(1)},", f"{d(1)}"], lambda: [f"{word()}{d(2)}"],
        lambda: [f"AKIA{d(8)}"], lambda: [d(4), d(3)], lambda: [f"{d(2)}/{d(2)}/{d(4)}"],
    ]
    table = []
    for _ in range(rows):
        tokens, tags = [], []
        for _ in range(int(rng.integers(1, 4))):
            filler = [word() for _ in range(int(rng.integers(0, 6)))]
            tokens += filler
            tags += [0] * len(filler)
            if rng.random() < 0.55:
                kind = int(rng.integers(0, 4))
                part = makers[kind][int(rng.integers(0, len(makers[kind])))]()
                if rng.random() < 0.25:
                    part[-1] += str(rng.choice([".", ",", "###", "!!", "&&&", ";", "%%%"]))
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(part) - 1)
            else:
                part = others[int(rng.integers(0, len(others)))]()
                tags += [0] * len(part)
            tokens += part
        if tokens:
            table.append((tokens, tags))
    return table


class Crf:
    """emissions: one row of weights per feature slot; moves: from tag to tag; starts: of the first tag."""

    def __init__(self, emissions: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> None:
        self.emissions, self.moves, self.starts = emissions, moves, starts
        self.cache: dict[str, np.ndarray] = {}

    @staticmethod
    def train(table: list[tuple[list[str], list[int]]], steps: int = 80, ridge: float = 1e-4, rate: float = 0.1) -> Crf:
        k, n, longest = len(TAGS), len(table), max(len(t) for t, _ in table)
        mask = np.zeros((n, longest))
        gold = np.zeros((n, longest), int)
        rows, cols = [], []
        for i, (tokens, tags) in enumerate(table):
            mask[i, : len(tags)], gold[i, : len(tags)] = 1, tags
            slots = [token_slots(t) for t in tokens]
            for j in range(len(tokens)):
                here = slots[j][0] + (slots[j - 1][1] if j else []) + (slots[j + 1][2] if j + 1 < len(tokens) else [])
                rows += [i * longest + j] * len(here)
                cols += here
        rows, cols = np.array(rows), np.array(cols)
        used, cols = np.unique(cols, return_inverse=True)
        params = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        one = np.eye(k)[gold] * mask[..., None]
        for step in range(1, steps + 1):
            w, moves, starts = params
            e = np.zeros((n * longest, k))
            np.add.at(e, rows, w[cols])
            e = e.reshape(n, longest, k)
            node, edge = Crf._marginals(e, moves, starts, mask)
            off = ((node - one) * mask[..., None]).reshape(n * longest, k)
            gw = np.zeros_like(w)
            np.add.at(gw, cols, off[rows])
            gm = edge - np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
            grads = [gw / n + ridge * w, gm / n + ridge * moves, (node[:, 0] - one[:, 0]).sum(0) / n]
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a[:] = 0.9 * a + 0.1 * g
                b[:] = 0.999 * b + 0.001 * g * g
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        emissions = np.zeros((1 << SPACE_BITS, k))
        emissions[used] = params[0]
        moves = params[1].copy()
        for j in range(2, k, 2):  # an inside tag follows its own kind only
            moves[[i for i in range(k) if i not in (j - 1, j)], j] = -1e4
        starts = params[2].copy()
        starts[2::2] = -1e4
        return Crf(emissions, moves, starts)

    @staticmethod
    def _marginals(e: np.ndarray, moves: np.ndarray, starts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tag marginals of every place, and the expected count of each move."""
        n, t, k = e.shape
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = starts + e[:, 0]
        add = lambda x, axis: np.log(np.exp(x - (top := x.max(axis, keepdims=True))).sum(axis)) + top.squeeze(axis)
        for i in range(1, t):
            new = add(alpha[:, i - 1, :, None] + moves, 1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None] > 0, new, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            new = add(moves + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(mask[:, i + 1, None] > 0, new, 0)
        total = add(alpha[:, -1], 1)
        node = np.exp(alpha + beta - total[:, None, None])
        edge = np.zeros((k, k))
        for i in range(1, t):
            edge += (np.exp(alpha[:, i - 1, :, None] + moves + (e[:, i] + beta[:, i])[:, None, :] - total[:, None, None]) * mask[:, i, None, None]).sum(0)
        return node, edge

    def _vectors(self, token: str) -> np.ndarray:
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) >= CACHED_TOKENS:
                self.cache.clear()
            found = self.cache[token] = np.array([self.emissions[s].sum(0) for s in token_slots(token)])
        return found

    def decode(self, lines: list[list[str]], most: int = 200_000) -> list[np.ndarray]:
        """Viterbi over batches of lines of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(lines)
        order = sorted((i for i in range(len(lines)) if lines[i]), key=lambda i: len(lines[i]))
        for _, group in groupby(order, key=lambda i: len(lines[i]).bit_length()):
            group = list(group)
            width = max(len(lines[i]) for i in group)
            step = max(1, most // width)
            for at in range(0, len(group), step):
                self._batch(lines, group[at : at + step], out)
        return out

    def _batch(self, lines: list[list[str]], group: list[int], out: list[np.ndarray]) -> None:
        k, n, t = len(TAGS), len(group), max(len(lines[i]) for i in group)
        e = np.zeros((t, n, k))
        for col, i in enumerate(group):
            x = np.array([self._vectors(w) for w in lines[i]])
            e[: len(x), col] = x[:, 0]
            e[1 : len(x), col] += x[:-1, 1]
            e[: len(x) - 1, col] += x[1:, 2]
        size = np.array([len(lines[i]) for i in group])
        back = np.zeros((t, n, k), np.int8)
        v = self.starts + e[0]
        for i in range(1, t):
            x = v[:, :, None] + self.moves
            back[i] = x.argmax(1)
            v = np.where((i < size)[:, None], x.max(1) + e[i], v)
        last = v.argmax(1)
        tags = np.zeros((t, n), np.int8)
        for i in range(t - 1, -1, -1):
            on = i < size
            tags[i] = np.where(on, last, 0)
            last = np.where(on & (i > 0), back[i, np.arange(n), last], last)
        for col, i in enumerate(group):
            out[i] = tags[: size[col], col]


def plausible(rank: int, s: str) -> bool:
    n = len(_digits(s))
    if rank == 0:
        return re.fullmatch(r"[^@\s]+@[^@\s]+", s) is not None
    if rank == 1:
        return IP.match(s) is not None and n <= 17
    if rank == 2:
        return 13 <= n <= 19 and luhn(_digits(s)) and not re.search(r"[A-Za-z]", s)
    return 9 <= n <= 15 and re.search(r"[^0-9]", s) is not None and not re.search(r"[A-Za-z/:#$%]", s)


def candidate_lines(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each line that holds a digit or an at sign."""
    end = -1
    while m := SIGN.search(text, end + 1):
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.start())
        if end < 0:
            end = len(text)
        yield start, end


def find(texts: list[str], crf: Crf) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text."""
    where, lines = [], []
    for no, text in enumerate(texts):
        for start, end in candidate_lines(text):
            tokens = [(m.start(), m[0]) for m in TOKEN.finditer(text, start, end)]
            where.append((no, tokens))
            lines.append([w for _, w in tokens])
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    base = [base_spans(t) for t in texts]
    for (no, tokens), tags in zip(where, crf.decode(lines), strict=True):
        hit = np.flatnonzero(tags).tolist()
        while hit:
            first = last = hit.pop(0)
            rank = (int(tags[first]) - 1) // 2
            while hit and hit[0] == last + 1 and tags[hit[0]] == 2 + 2 * rank:
                last = hit.pop(0)
            start, end = tokens[first][0], tokens[last][0] + len(tokens[last][1])
            inner = EDGES.match(texts[no][start:end])
            start, end = start + inner.start(1), start + inner.end(1)
            clear = all(end <= a or b <= start for _, a, b in base[no])
            if start < end and clear and plausible(rank, texts[no][start:end]):
                added[no].append((rank, start, end))
    return [(b, sorted({*b, *a})) for b, a in zip(base, added, strict=True)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans as arrays of kind:start:end: one row per row of docs."""
    crf = Crf.train(labelled_table())

    def make():
        def f(texts: list[str]) -> list[pa.Array]:
            found = find(texts, crf)
            return [pa.array([[_joined([s]) for s in x[i]] for x in found], pa.list_(pa.string())) for i in (0, 1)]

        return f

    return map_texts(docs, id_col, text_col, make, "base array<string>, spans array<string>")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(read(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> startswith(x, '{kind}:'))) as bigint) as n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))
