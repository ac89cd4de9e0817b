"""Language-model scoring by a hierarchical Pitman-Yor model over words.

Restaurants. Every word that another follows in training, and the start of texts, has a restaurant in which what follows is
served: a customer for each time, so a dish's customers are the count of the pair. All context restaurants share one parent, to
which each table is sent as a customer; the parent's discount is 0 and its base is uniform over the words of training and one
unknown word.

Seating is sampled by Gibbs. Which dish a customer eats is observed, so the state is the number of tables t of each pair. Given
the parent's probabilities G and, for each context, a gamma variable X that stands for the product of its factors (strength +
discount * tables), the tables of all pairs are independent: the chance of t is in proportion to S(c, t) * (discount * X * G)^t,
with the generalised Stirling numbers S. So a sweep draws G (gamma variables by word), X (by context), then all t at once, each
from its exact conditional distribution; no block is drawn from stale neighbours, and the parts of a sweep need no order. For
counts above `exact`, where S comes from an integral or its saddle point, t makes Metropolis moves on that distribution instead. A pair that
occurs once has one table always, so only the others are redrawn.

Scores come from the predictive rule with the tables, the parent's customers and the contexts' tables averaged over the sweeps
after burn-in; each context's probabilities sum to one over the vocabulary with the unknown word. The discount comes from the
counts of counts.

Size. Nothing is capped: all contexts, words and pairs are counted, seated and looked up, in buckets whose number grows with the
corpus. A bucket has whole contexts, but for those of a thousandth of all tokens or more (a thousand at most), whose pairs are
spread over all buckets. What reaches the driver or is broadcast is bounded: those contexts, sums, and the `cached` most frequent
words and pairs, which spare look-ups; their scores are those of the tables. Words are told apart by 64 bits of hash.

Defined cases: a null or empty text is its end token; a row without an id isn't learned from and isn't held out; repeated rows
are learned from and scored as often as they occur; without training rows every score is 0; other columns are not read.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.llm.common import crc_mod, discard, materialize, read, tidy
from skeinspark.llm.tokens import WordHasher, pieces

#: Keys that are no word's hash but by a chance of 2^-64: the end of a text, and its start as a context.
END, START = np.int64(1), np.int64(2)


@dataclass(frozen=True)
class Settings:
    """strength: of a context; root: the root's strength for each word of its base; exact: customers of a dish up to which Stirling numbers are tabled.

    share: bytes of text to a bucket; flush: tokens that a task holds at once; hot_share: a context of one token in so many is spread; cached: words and pairs;
    slices: parts of the texts that are scored one after the other, so that only one part's look-ups are on disk.
    """

    burn_in: int = 3
    sweeps: int = 5
    moves: int = 4
    strength: float = 1.0
    root: float = 0.5
    exact: int = 256
    share: int = 8 << 20
    flush: int = 1 << 20
    hot_share: int = 1000
    cached: int = 1 << 18
    slices: int = 2


DEFAULT = Settings()


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives back to the system what earlier work has freed: a worker lives on between tasks, and all of an executor's workers count."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


# -- packed columns ------------------------------------------------------------------
def pack(a: np.ndarray) -> bytes:
    """Numbers of one kind, compressed byte by byte of their places."""
    a = np.ascontiguousarray(a)
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if len(a) else b"")


def unpack(b: bytes, kind: type = np.int64) -> np.ndarray:
    n, wide = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.Codec("zstd").decompress(b[8:], wide * n), np.uint8)
    return np.ascontiguousarray(raw.reshape(wide, n).T).view(kind).ravel()


def join_packed(table: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    found = [unpack(x.as_py(), kind) for x in table.column(name) if x.is_valid]
    return np.concatenate(found) if found else np.zeros(0, kind)


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def spark_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int64': 'bigint', 'binary': 'binary', 'double': 'double'}[str(f.type)])}" for f in schema)


def schema_of(text: str) -> pa.Schema:
    """b:i means a bigint column b, :p packed numbers, :d a double."""
    kinds = {"i": pa.int64(), "p": pa.binary(), "d": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(":") for x in text.split())])


def mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (u * np.int64(0x5851F42D4C957F2D) ^ w) * np.int64(0x14057B7EF767814F)
    return x ^ (x >> 29)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> 33 & 0x3FFFFFFF) % buckets


def is_hot(u: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """hot: sorted keys; the place of each of u among them, or -1."""
    if not len(hot):
        return np.full(len(u), -1)
    at = np.searchsorted(hot, u).clip(0, len(hot) - 1)
    return np.where(hot[at] == u, at, -1)


def bucket_of_pairs(u: np.ndarray, pair: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(np.where(is_hot(u, hot) >= 0, pair, u), buckets)


def parts(bucket: np.ndarray, *cols: np.ndarray):
    """(bucket, columns) of each bucket that has rows."""
    if not len(bucket):
        return
    bucket = bucket.astype(np.int16 if bucket.max() < 1 << 15 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], [c[order] for c in cols]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        yield int(bucket[i]), [c[i:j] for c in cols]


def summed(keys: np.ndarray, *cols: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and the sums of the columns."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[new], *[np.add.reduceat(c[order], new) if len(new) else c for c in cols]]


# -- tokens --------------------------------------------------------------------------
def runs_of(batches, column: int, flush: int):
    """Keys of the words of runs of texts of `flush` tokens or so, the words of each text, and the slices of the batches that hold them."""
    trim()
    words = WordHasher()
    keys, counts, held, n = [], [], [], 0
    for batch in pieces(batches, column):
        h, c = words(batch.column(column))
        keys.append(h.view(np.int64))
        counts.append(c)
        held.append(batch)
        n += len(h) + len(c)
        if n >= flush:
            yield np.concatenate(keys), np.concatenate(counts), held
            keys, counts, held, n = [], [], [], 0
            trim()
    if held:
        yield np.concatenate(keys), np.concatenate(counts), held


def with_ends(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of every token, the end of each text among them, and the text's number."""
    n = counts + 1
    last = np.cumsum(n) - 1
    w = np.full(int(n.sum()), END)
    inner = np.ones(len(w), bool)
    inner[last] = False
    w[inner] = keys
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[last - n + 1] = START
    return u, w, np.repeat(np.arange(len(n)), n)


WORDS = schema_of("b:i k:p c:p tokens:i types:i")


def count_words(train: DataFrame, buckets: int, how: Settings) -> DataFrame:
    """A row a bucket: the keys of its words, ascending, and how often each occurs."""
    part = schema_of("b:i k:p c:p")

    def count(batches):
        for keys, counts, _ in runs_of(batches, 0, how.flush):
            k, c = np.unique(keys, return_counts=True)
            k, c = np.concatenate([k, [END]]), np.concatenate([c, [len(counts)]])
            yield from rows_of([(b, *map(pack, cols)) for b, cols in parts(bucket_of(k, buckets), k, c)], part).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        k, c = summed(join_packed(table, "k"), join_packed(table, "c"))
        return rows_of([(table.column("b")[0].as_py(), pack(k), pack(c), int(c.sum()), len(k))], WORDS)

    return train.mapInArrow(count, spark_schema(part)).groupBy("b").applyInArrow(merge, spark_schema(WORDS))


def level(c: np.ndarray) -> np.ndarray:
    """Eight steps of size to a doubling."""
    return np.floor(8 * np.log2(np.maximum(c, 1))).astype(np.int64)


def cut_of(table: DataFrame, count_col: str, most: int, kind: type = np.int64) -> int:
    """The least level above which there are `most` counts at most."""

    def run(batches):
        for batch in batches:
            for x in batch.column(0):
                at, n = np.unique(level(unpack(x.as_py(), kind)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

    got = table.select(count_col).mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas().sort_values("at", ascending=False)
    fit = got[got["n"].cumsum() <= most]
    return int(fit["at"].min()) if len(fit) else 1 << 40


def hot_words(words: DataFrame, tokens: int, how: Settings) -> np.ndarray:
    """The words that are a thousandth of all tokens or more, and the start: contexts whose pairs are spread."""

    def run(batches):
        for batch in batches:
            for k, c in zip(*batch.columns, strict=True):
                k, c = unpack(k.as_py()), unpack(c.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(k[c * how.hot_share >= tokens])], names=["k"])

    got = words.select("k", "c").mapInArrow(run, "k bigint").toPandas()["k"].to_numpy(np.int64)
    return np.unique(np.concatenate([got, [START]]))


CELLS = schema_of("b:i u1:p w1:p u:p w:p c:p one:i two:i")


def count_pairs(train: DataFrame, hot: np.ndarray, buckets: int, how: Settings) -> DataFrame:
    """A row a bucket, in the order of contexts: u1, w1, the pairs that occur once, and u, w, c, the others and how often."""
    part = schema_of("b:i u:p w:p c:p")

    def count(batches):
        for keys, counts, _ in runs_of(batches, 0, how.flush):
            u, w, _ = with_ends(keys, counts)
            pair = mixed(u, w)
            order = np.argsort(pair)
            pair = pair[order]
            new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            u, w, c = u[order[new]], w[order[new]], np.diff(np.concatenate([new, [len(pair)]]))
            where = bucket_of_pairs(u, pair[new], hot, buckets)
            order = np.argsort(u)
            u, w, c, where = u[order], w[order], c[order].astype(np.int32), where[order]
            yield from rows_of([(b, *map(pack, cols)) for b, cols in parts(where, u, w, c)], part).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        trim()
        u, w, c = join_packed(table, "u"), join_packed(table, "w"), join_packed(table, "c", np.int32)
        pair = mixed(u, w)
        order = np.argsort(pair)
        pair = pair[order]
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        u, w, c = u[order[new]], w[order[new]], np.add.reduceat(c[order].astype(np.int64), new)
        order = np.argsort(u, kind="stable")
        u, w, c = u[order], w[order], c[order]
        many = c > 1
        return rows_of([(table.column("b")[0].as_py(), pack(u[~many]), pack(w[~many]), pack(u[many]), pack(w[many]), pack(c[many]), int((~many).sum()), int((c == 2).sum()))], CELLS)

    return train.mapInArrow(count, spark_schema(part)).groupBy("b").applyInArrow(merge, spark_schema(CELLS))


# -- seating ---------------------------------------------------------------------------
def stirling_table(d: float, n: int = DEFAULT.exact) -> list[np.ndarray]:
    """log S(c, t) for c up to n and t from 1 to c, by S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    out = [np.zeros(0), np.zeros(1)]
    for c in range(1, n):
        t = np.arange(1, c + 1)
        stay = np.concatenate([out[c] + np.log(np.maximum(c - t * d, 1e-300)), [-np.inf]])
        out.append(np.logaddexp(stay, np.concatenate([[-np.inf], out[c]])))
    return out


def _saddle(d: float, ratio: np.ndarray) -> np.ndarray:
    """log y with d (1 - y) y^(d - 1) / (1 - y^d) = ratio, by bisection."""
    low, high = np.full(len(ratio), -690.0), np.full(len(ratio), -1e-13)
    for _ in range(60):
        at = (low + high) / 2
        big = np.log(d) + np.log(-np.expm1(at)) + (d - 1) * at - np.log(-np.expm1(d * at)) > np.log(ratio)
        low, high = np.where(big, at, low), np.where(big, high, at)
    return (low + high) / 2


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = np.asarray(n, float) + 1
    small = np.where(x < 16, x + 16, x)
    out = (small - 0.5) * np.log(small) - small + 0.5 * np.log(2 * np.pi) + 1 / (12 * small) - 1 / (360 * small**3)
    for i in range(16):
        out = out - np.where(x < 16, np.log(x + i), 0)
    return out


def _at_saddle(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log of S(c, t) t! / c! from the saddle point of its generating function ((1 - (1 - z)^d) / d)^t / t!; close if many tables are open."""
    log_y = _saddle(d, c / t)
    z = -np.expm1(log_y)
    spread = c * (1 + (1 - d) * z * np.exp(-log_y) - c / t)
    return t * np.log(-np.expm1(d * log_y) / d) - c * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-12))


def _on_cut(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The same by the integral along that function's cut from 1, whose integrand doesn't swing if few tables are open."""
    step = 0.2
    log_s = np.arange(-25, 4.6, step) - np.log(c)[:, None]
    s = np.exp(log_s)
    x, y = 1 - s**d * np.cos(np.pi * d), s**d * np.sin(np.pi * d)
    value = 0.5 * t[:, None] * np.log(x * x + y * y) - (c[:, None] + 1) * np.log1p(s) + log_s
    return np.log(np.maximum((np.exp(value) * np.sin(t[:, None] * np.arctan2(y, x))).sum(1) * step / np.pi, 1e-300)) - t * np.log(d)


def log_stirling(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log S(c, t) for large c, 1 <= t < c."""
    c, t = np.asarray(c, float), np.asarray(t, float)
    border = np.clip(np.floor(np.maximum(0.5 * c**d, 8 if d < 0.5 else 1)), 1, c - 1)
    out, many = np.empty(len(c)), t > border
    out[~many] = _on_cut(d, c[~many], t[~many])
    if many.any():
        n, edge = c[many], border[many]
        out[many] = _at_saddle(d, n, t[many]) + _on_cut(d, n, edge) - _at_saddle(d, n, edge)
    return out + _log_factorial(c) - _log_factorial(t)


def mode(d: float, c: np.ndarray, log_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where S(c, t) a^t is largest, and the width of its peak there."""
    c = np.asarray(c, float)
    low, high = np.full(len(c), -690.0), np.full(len(c), -1e-13)
    for _ in range(60):
        at = (low + high) / 2
        log_q = np.log(d) + np.log(-np.expm1(at)) + (d - 1) * at - np.log(-np.expm1(d * at))
        log_t = np.log(c) - log_q
        rising = np.log(-np.expm1(d * at) / d) - log_t + log_a > 0
        low, high = np.where(rising, at, low), np.where(rising, high, at)
    t = np.clip(np.exp(log_t), 1, c - 1)
    log_y = _saddle(d, c / t)
    spread = np.maximum(c * (1 + (1 - d) * -np.expm1(log_y) * np.exp(-log_y) - c / t), 1e-9)
    return t, 1 / np.sqrt(c * c / (t * t * spread) + 1 / t)


def seat(c: np.ndarray, t: np.ndarray, log_a: np.ndarray, d: float, rng: np.random.Generator, table: list[np.ndarray], moves: int = DEFAULT.moves, at_once: int = 1 << 20) -> np.ndarray:
    """New tables of dishes of c >= 2 customers, given the old ones (0: none yet) and a = discount * X * G of each."""
    out = np.empty(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    exact = len(table) - 1
    bounds = np.searchsorted(c[order], np.arange(exact + 2))
    for n in range(2, exact + 1):
        rows = order[bounds[n] : bounds[n + 1]]
        step = max(1, at_once // n)
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            x = table[n] + log_a[some, None] * np.arange(1, n + 1)
            x = np.exp(x - x.max(1, keepdims=True)).cumsum(1)
            out[some] = 1 + (rng.random((len(some), 1)) * x[:, -1:] > x).sum(1)
    big = order[bounds[exact + 1] :]
    if len(big):
        n, a = c[big], log_a[big]
        peak, width = mode(d, n, a)
        now = np.where(t[big] > 0, t[big], np.rint(peak)).clip(1, n - 1)
        value = log_stirling(d, n, now) + a * now
        for _ in range(moves if t[big].all() else 16 * moves):
            to = now + np.rint(rng.normal(0, 1.8 * width + 0.5))
            inside = (to >= 1) & (to <= n - 1)
            new = log_stirling(d, n, np.where(inside, to, now)) + a * np.where(inside, to, now)
            take = inside & (np.log(rng.random(len(n))) < new - value)
            now, value = np.where(take, to, now), np.where(take, new, value)
        out[big] = now
    return out


STATE = schema_of("b:i uk:p single:p ui:p wk:p wi:p c:p t:p t_sum:p up_sum:p hot:p hot_t:p")
UP = schema_of("at:i b:i k:p n:p")
DOWN = schema_of("b:i at:i g:p total:d rest:d")


def by_bucket_then_key(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Distinct keys by their bucket; so what the buckets answer, one after the other, is in the order of the keys."""
    keys = np.unique(keys)
    return keys[np.argsort(bucket_of(keys, buckets), kind="stable")]


def places(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    return order[np.searchsorted(keys[order], of)].astype(np.int32)


def hot_tables(uk: np.ndarray, tables: np.ndarray, hot: np.ndarray) -> list[bytes]:
    at = is_hot(uk, hot)
    return [pack(at[at >= 0]), pack(tables[at >= 0].astype(np.int64))]


def begin(cells: DataFrame, hot: np.ndarray, buckets: int, how: Settings) -> DataFrame:
    """The state before the first sweep, a row a bucket: contexts uk with the number of their pairs that occur once, words wk, and by place in these the pairs, with one table each (0: to be found, for large counts)."""

    def run(batches):
        for batch in batches:
            for b, u1, u, w, c in zip(*batch.columns, strict=True):
                u1, u, w, c = (unpack(x.as_py()) for x in (u1, u, w, c))
                uk = np.unique(np.concatenate([u, u1[is_hot(u1, hot) >= 0]]))
                single = np.searchsorted(u1, uk, "right") - np.searchsorted(u1, uk)
                wk = by_bucket_then_key(w, buckets)
                ui, wi, t = np.searchsorted(uk, u).astype(np.int32), places(wk, w), np.ones(len(u), np.int32)
                tables = single + np.bincount(ui, t, len(uk))
                up = np.bincount(wi, t, len(wk)).astype(np.int64)
                yield from rows_of([(b.as_py(), *map(pack, (uk, single.astype(np.int64), ui, wk, wi, c, t, np.zeros(len(u), np.int32), up)), *hot_tables(uk, tables, hot))], STATE).to_batches()

    return cells.select("b", "u1", "u", "w", "c").mapInArrow(run, spark_schema(STATE))


def sent_up(state: DataFrame, buckets: int) -> DataFrame:
    """To the bucket of each word: the tables that a bucket of contexts has for it."""

    def run(batches):
        for batch in batches:
            for b, k, n in zip(*batch.columns, strict=True):
                k, n = unpack(k.as_py()), unpack(n.as_py())
                yield from rows_of([(at, b.as_py(), *map(pack, cols)) for at, cols in parts(bucket_of(k, buckets), k, n)], UP).to_batches()

    return state.select("b", "wk", "up_sum").mapInArrow(run, spark_schema(UP))


def singles_up(cells: DataFrame, buckets: int) -> DataFrame:
    """at, k, n: in how many contexts each word occurs once, by the word's bucket."""

    def run(batches):
        for batch in batches:
            for b, w in zip(*batch.columns, strict=True):
                k, n = np.unique(unpack(w.as_py()), return_counts=True)
                yield from rows_of([(at, b.as_py(), *map(pack, cols)) for at, cols in parts(bucket_of(k, buckets), k, n)], UP).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        k, n = summed(join_packed(table, "k"), join_packed(table, "n"))
        return rows_of([(table.column("at")[0].as_py(), -1, pack(k), pack(n))], UP)

    return cells.select("b", "w1").mapInArrow(run, spark_schema(UP)).groupBy("at").applyInArrow(merge, spark_schema(UP))


def draw_parent(up: DataFrame, singles: DataFrame, sweep: int, root: float) -> DataFrame:
    """For each bucket of contexts the gamma variables of its words, in the order of UP's keys; total: their sum over the words of a bucket, rest: the customers and base of these that pairs occurring once account for."""

    def run(key, up: pa.Table, single: pa.Table) -> pa.Table:
        at = key[0].as_py()
        sk, sn = join_packed(single, "k"), join_packed(single, "n")
        each = [(b.as_py(), unpack(k.as_py()), unpack(n.as_py())) for b, k, n in zip(up.column("b"), up.column("k"), up.column("n"), strict=True)]
        if not each:
            return rows_of([], DOWN)
        each.sort(key=lambda x: x[0])
        k, n = summed(np.concatenate([x[1] for x in each]), np.concatenate([x[2] for x in each]))
        alone = np.zeros(len(k), np.int64)
        if len(sk):
            spot = np.searchsorted(sk, k).clip(0, len(sk) - 1)
            alone = np.where(sk[spot] == k, sn[spot], 0)
        g = np.random.default_rng([at, sweep, 17]).standard_gamma(n + alone + root)
        rows = [(b, at, pack(g[np.searchsorted(k, x)]), 0.0, 0.0) for b, x, _ in each]
        rows[0] = (*rows[0][:3], float(g.sum()), float((alone + root).sum()))
        return rows_of(rows, DOWN)

    return up.groupBy("at").cogroup(singles.groupBy("at")).applyInArrow(run, spark_schema(DOWN))


def reseat(state: DataFrame, down: DataFrame, total: float, hot: np.ndarray, hot_x: np.ndarray, d: float, sweep: int, how: Settings) -> DataFrame:
    """One sweep over the tables of all pairs."""
    keep = sweep >= how.burn_in

    def run(key, state: pa.Table, down: pa.Table) -> pa.Table:
        trim()
        row = {n: state.column(n)[0].as_py() for n in state.column_names}
        uk, single, c, wk = (unpack(row[n]) for n in ("uk", "single", "c", "wk"))
        ui, wi, t, t_sum = (unpack(row[n], np.int32) for n in ("ui", "wi", "t", "t_sum"))
        if len(c):
            rng = np.random.default_rng([row["b"], sweep, 29])
            order = np.argsort(down.column("at").to_numpy())
            blobs = down.column("g").to_pylist()
            g = np.concatenate([unpack(blobs[i], float) for i in order])
            first = np.maximum(t, 1)
            x = rng.standard_gamma(how.strength / d + single + np.bincount(ui, first, len(uk)))
            at = is_hot(uk, hot)
            x[at >= 0] = hot_x[at[at >= 0]]
            log_a = np.log(d) + np.log(x)[ui] + (np.log(np.maximum(g, 1e-300)) - np.log(total))[wi]
            t = seat(c, t, log_a, d, rng, stirling_table(d, how.exact), how.moves).astype(np.int32)
            if keep:
                t_sum = t_sum + t
        tables = single + np.bincount(ui, t, len(uk))
        new = row | {"t": pack(t), "t_sum": pack(t_sum), "up_sum": pack(np.bincount(wi, t, len(wk)).astype(np.int64))}
        new["hot"], new["hot_t"] = hot_tables(uk, tables, hot)
        return rows_of([tuple(new[f.name] for f in STATE)], STATE)

    return state.groupBy("b").cogroup(down.groupBy("b")).applyInArrow(run, spark_schema(STATE))


def sum_hot(table: DataFrame, hot: np.ndarray, place: str, *cols: str) -> list[np.ndarray]:
    """What all buckets hold of the spread contexts, a thousand at most."""

    def run(batches):
        for batch in batches:
            for at, *ns in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(at.as_py())), *[pa.array(unpack(n.as_py()).astype(float)) for n in ns]], names=["at", *cols])

    got = table.select(place, *cols).mapInArrow(run, "at bigint, " + ", ".join(f"{c} double" for c in cols)).groupBy("at").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    out = []
    for c in cols:
        x = np.zeros(len(hot))
        x[got["at"].to_numpy(int)] = got[c].to_numpy(float)
        out.append(x)
    return out


def sample(cells: DataFrame, hot: np.ndarray, d: float, customers: float, types: int, buckets: int, how: Settings, seed: int = 3) -> DataFrame:
    """The state after the last sweep. customers: the pairs that occur once, which are all customers of the root that never change."""
    spark, rng = cells.sparkSession, np.random.default_rng(seed)
    singles = materialize(singles_up(cells, buckets))
    state = materialize(begin(cells, hot, buckets, how))
    for sweep in range(how.burn_in + how.sweeps):
        down = materialize(draw_parent(sent_up(state, buckets), singles, sweep, how.root))
        got = down.agg(F.sum("total").alias("total"), F.sum("rest").alias("rest")).first()
        # the words of pairs that occur once alone, and the unknown word, are one gamma variable
        others = customers + how.root * (types + 1) - (got.rest or 0.0)
        total = (got.total or 0.0) + rng.standard_gamma(max(others, how.root))
        hot_x = rng.standard_gamma(how.strength / d + sum_hot(state, hot, "hot", "hot_t")[0])
        before, state = state, materialize(reseat(state, down, total, hot, hot_x, d, sweep, how))
        for old in (before, down):
            discard(old)
        del before, down
        tidy(spark)
    discard(singles)
    return state


# -- the model -----------------------------------------------------------------------
@dataclass
class Model:
    """pairs: b, k (mixed keys of pairs, ascending), v: what a pair adds to log10 of its context's weight times the word's probability at the root.
    words: at, k (keys of words, ascending), c, base, v: log10 of the base probability; log10 of the root's probability plus, for what follows the word, its weight as a context.
    word_cache, pair_cache: keys and the same values of the most frequent ones."""

    how: Settings
    n_tokens: int
    n_types: int
    buckets: int
    hot: np.ndarray
    unseen: float
    unknown: float
    start: float
    discount: float
    pairs: DataFrame
    words: DataFrame
    word_cache: tuple[np.ndarray, ...]
    pair_cache: tuple[np.ndarray, ...]


FINISH = schema_of("at:i b:i k:p n:p uk:p own:p")
HOTS = schema_of("b:i hot:p t:p c:p")
RECORDS = schema_of("b:i at:i p:p k:p c:p base:p v:p")
PAIRS = schema_of("b:i k:p v:p")


def contexts_of(u1: np.ndarray, row: dict, sweeps: int) -> tuple[np.ndarray, ...]:
    """All contexts of a bucket: keys, averaged tables and customers."""
    uk2, ui, c, t = unpack(row["uk"]), unpack(row["ui"], np.int32), unpack(row["c"]), unpack(row["t_sum"], np.int32) / sweeps
    uk = np.unique(np.concatenate([u1, uk2]))
    single = np.searchsorted(u1, uk, "right") - np.searchsorted(u1, uk)
    at = np.searchsorted(uk, uk2)[ui] if len(ui) else np.zeros(0, np.int64)
    return uk, single + np.bincount(at, t, len(uk)), single + np.bincount(at, c, len(uk)), at, c, t


def first_row(batch, i: int) -> dict:
    return {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


def finish_up(both: DataFrame, hot: np.ndarray, d: float, buckets: int, how: Settings) -> DataFrame:
    """To the bucket of each word: its averaged customers at the root from a bucket of contexts, and the weights of the contexts themselves, whose bucket is their own."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        row = first_row(table, 0)
        u1, w1 = unpack(row["u1"]), unpack(row["w1"])
        uk, tables, customers, _, _, t = contexts_of(u1, row, how.sweeps)
        w = np.concatenate([w1, unpack(row["wk"])[unpack(row["wi"], np.int32)]])
        k, n = summed(w, np.concatenate([np.ones(len(w1)), t]))
        cold = is_hot(uk, hot) < 0
        own = np.log10((how.strength + d * tables) / (how.strength + customers))[cold]
        empty = pack(np.zeros(0, np.int64))
        out = [(at, row["b"], *map(pack, cols), empty, empty) for at, cols in parts(bucket_of(k, buckets), k, n)]
        return rows_of([*out, (row["b"], -1, empty, empty, pack(uk[cold]), pack(own))], FINISH)

    # by groups, not by mapInArrow: only one bucket's row, of many MB, goes to the worker at once
    return both.groupBy("b").applyInArrow(run, spark_schema(FINISH))


def hot_totals(both: DataFrame, hot: np.ndarray, how: Settings) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        trim()
        row = first_row(table, 0)
        uk, tables, customers, *_ = contexts_of(unpack(row["u1"]), row, how.sweeps)
        at = is_hot(uk, hot)
        on = at >= 0
        return rows_of([(row["b"], pack(at[on]), *(pack((x[on] * how.sweeps).round().astype(np.int64)) for x in (tables, customers)))], HOTS)

    return both.select("b", "u1", "uk", "ui", "c", "t_sum").groupBy("b").applyInArrow(run, spark_schema(HOTS))


def finish_words(up: DataFrame, words: DataFrame, root_total: float, floor: float, hot: np.ndarray, hot_own: np.ndarray, how: Settings) -> DataFrame:
    """For each bucket of contexts the root's probabilities of its words; and, with b = -1, the records of a bucket of words."""

    def run(key, up: pa.Table, words: pa.Table) -> pa.Table:
        at = key[0].as_py()
        k, c = join_packed(words, "k"), join_packed(words, "c")
        each = [(b.as_py(), unpack(x.as_py()), unpack(n.as_py(), float)) for b, x, n in zip(up.column("b"), up.column("k"), up.column("n"), strict=True) if b.as_py() >= 0]
        each.sort(key=lambda x: x[0])
        n = np.zeros(len(k))
        for _, x, y in each:
            n[np.searchsorted(k, x)] += y
        p = (n + how.root) / root_total
        own = np.zeros(len(k))
        uk, weight = join_packed(up, "uk"), join_packed(up, "own", float)
        if len(uk):
            own[np.searchsorted(k, uk)] = weight
        spread = is_hot(k, hot)
        own[spread >= 0] = hot_own[spread[spread >= 0]]
        nothing = pack(np.zeros(0, np.int64))
        rows = [(b, at, pack(p[np.searchsorted(k, x)]), nothing, nothing, nothing, nothing) for b, x, _ in each]
        rows.append((-1, at, nothing, pack(k), pack(c), pack(np.log10((c + 0.5) / floor)), pack(np.log10(p) + own)))
        return rows_of(rows, RECORDS)

    return up.groupBy("at").cogroup(words.groupBy("b")).applyInArrow(run, spark_schema(RECORDS))


def finish_pairs(both: DataFrame, records: DataFrame, hot: np.ndarray, hot_new: np.ndarray, d: float, buckets: int, how: Settings) -> DataFrame:
    """b, k, v of all pairs, and c of those that occur twice or more as level."""
    schema = schema_of("b:i k:p v:p c:p")

    def run(key, both: pa.Table, down: pa.Table) -> pa.Table:
        trim()
        row = {n: both.column(n)[0].as_py() for n in both.column_names}
        u1, w1 = unpack(row["u1"]), unpack(row["w1"])
        uk, tables, _, at, c, t = contexts_of(u1, row, how.sweeps)
        u = np.concatenate([u1, uk[at]])
        w = np.concatenate([w1, unpack(row["wk"])[unpack(row["wi"], np.int32)]])
        order = np.argsort(down.column("at").to_numpy())
        blobs = down.column("p").to_pylist()
        wk = by_bucket_then_key(w, buckets)
        p = np.concatenate([unpack(blobs[i], float) for i in order])
        new = how.strength + d * tables
        spread = is_hot(uk, hot)
        new[spread >= 0] = hot_new[spread[spread >= 0]]
        left = np.concatenate([np.full(len(u1), 1 - d), c - d * t])
        v = np.log10(1 + left / (new[np.searchsorted(uk, u)] * p[places(wk, w)]))
        k = mixed(u, w)
        order = np.argsort(k)
        count = np.concatenate([np.ones(len(u1), np.int64), c])
        return rows_of([(row["b"], pack(k[order]), pack(v[order].astype(np.float32)), pack(count[order].astype(np.int32)))], schema)

    return both.groupBy("b").cogroup(records.groupBy("b")).applyInArrow(run, spark_schema(schema))


def most_frequent(table: DataFrame, cols: dict[str, type], count: str, count_kind: type, most: int) -> tuple[np.ndarray, ...]:
    """The columns of the rows whose count is above the level that leaves `cached` of them."""
    cut = cut_of(table, count, most, count_kind)
    names = list(cols)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = first_row(batch, i)
                on = level(unpack(row[count], count_kind)) >= cut
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(unpack(row[n], kind)[on].astype(np.float64 if kind is np.float32 else kind)) for n, kind in cols.items()], names=names)

    got = table.select(*dict.fromkeys([*names, count])).mapInArrow(run, ", ".join(f"{n} {'bigint' if kind is np.int64 else 'double'}" for n, kind in cols.items())).toPandas()
    return tuple(got[n].to_numpy(np.int64 if kind is np.int64 else float) for n, kind in cols.items())


def fit(train: DataFrame, text_col: str = "text", how: Settings = DEFAULT) -> Model:
    spark = train.sparkSession
    train = train.select(F.col(text_col).cast("string").alias("text"))
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // how.share)
    words = materialize(count_words(train, buckets, how))
    got = words.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    n_tokens, n_types = got.tokens or 0, got.types or 0
    hot = hot_words(words, n_tokens, how)
    cells = materialize(count_pairs(train, hot, buckets, how))
    got = cells.agg(F.sum("one").alias("one"), F.sum("two").alias("two")).first()
    one, two = got.one or 0, got.two or 0
    d = float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))
    tidy(spark)
    state = sample(cells, hot, d, float(one), n_types, buckets, how)
    both = cells.select("b", "u1", "w1").join(state.select("b", "uk", "ui", "wk", "wi", "c", "t_sum"), "b")
    tables, customers = (x / how.sweeps for x in sum_hot(materialize(hot_totals(both, hot, how)), hot, "hot", "t", "c"))
    hot_new = how.strength + d * tables
    hot_own = np.log10(hot_new / (how.strength + customers))
    up = materialize(finish_up(both, hot, d, buckets, how))

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(sum(unpack(x.as_py(), float).sum() for x in batch.column(0)))])], names=["n"])

    root_total = (up.select("n").mapInArrow(count, "n double").agg(F.sum("n")).first()[0] or 0.0) + how.root * (n_types + 1)
    floor = n_tokens + 0.5 * (n_types + 1)
    records = materialize(finish_words(up, words, root_total, floor, hot, hot_own, how))
    discard(up)
    pairs = materialize(finish_pairs(both, records.filter("b >= 0").select("b", "at", "p"), hot, hot_new, d, buckets, how))
    for old in (cells, state, words):
        discard(old)
    tidy(spark)
    known = records.filter("b < 0").select("at", "k", "c", "base", "v")
    return Model(
        how, n_tokens, n_types, buckets, hot, float(np.log10(0.5 / floor)), float(np.log10(how.root / root_total)), float(hot_own[is_hot(np.array([START]), hot)[0]]), d, pairs, known,
        most_frequent(known, {"k": np.int64, "base": float, "v": float}, "c", np.int64, how.cached), most_frequent(pairs, {"k": np.int64, "v": np.float32}, "c", np.int32, how.cached),
    )


class Cache:
    """Places of keys in two slots each; a key that finds both taken is left out."""

    def __init__(self, keys: np.ndarray, *cols: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.at, self.cols = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, -1, np.int32), cols
        left = np.arange(len(keys))
        for slot in (self._one, self._two):
            where = slot(keys[left])
            free = np.flatnonzero(self.at[where] < 0)
            _, first = np.unique(where[free], return_index=True)
            put = free[first]
            self.keys[where[put]], self.at[where[put]] = keys[left[put]], left[put]
            left = np.delete(left, put)

    def _one(self, keys: np.ndarray) -> np.ndarray:
        return keys >> 5 & ((1 << self.bits) - 1)

    def _two(self, keys: np.ndarray) -> np.ndarray:
        return keys >> 34 & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self._one(keys)
        out = np.where(self.keys[slot] == keys, self.at[slot], -1)
        miss = np.flatnonzero(out < 0)
        slot = self._two(keys[miss])
        out[miss] = np.where(self.keys[slot] == keys[miss], self.at[slot], -1)
        return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: one row per row of docs, as a written table.

    A text's score is a sum. What the caches don't hold is asked of the buckets, packed, and comes back as sums by text. The
    texts are dealt into slices by hash; a slice's look-ups are gone from the disk before the next one asks.
    """
    spark = docs.sparkSession
    tidy(spark)  # of what fit() has shuffled
    shared = spark.sparkContext.broadcast((Cache(*model.word_cache), Cache(*model.pair_cache)))
    hot, buckets, unseen, unknown, start, flush = model.hot, model.buckets, model.unseen, model.unknown, model.start, model.how.flush
    kind = docs.schema[id_col].dataType.simpleString()
    middle = f"b bigint, run bigint, word binary, word_doc binary, pair binary, pair_doc binary, doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double"
    names = [x.split()[0] for x in middle.split(", ")]
    empty = pack(np.zeros(0, np.int64))

    def ask(batches):
        words, pairs = shared.value
        run = TaskContext.get().partitionId() << 33
        for keys, counts, held in runs_of(batches, 1, flush // 2):
            run += 1
            u, w, doc = with_ends(keys, counts)
            n = len(counts)
            at = words(w)
            known, ask_w = at >= 0, at < 0
            sums = [np.bincount(doc[known], minlength=n)]
            for col, other in zip(words.cols, (unseen, unknown), strict=True):
                value = np.full(len(w), other)
                value[known] = col[at[known]]
                sums.append(np.bincount(doc, value, n))
            pair = mixed(u, w)
            at = pairs(pair)
            known = at >= 0
            gain = np.zeros(len(w))
            gain[known] = pairs.cols[0][at[known]]
            sums[2] = sums[2] + np.bincount(doc, gain, n) + start
            rows: dict[int, list[bytes]] = {}
            for b, (k, x) in parts(bucket_of(w[ask_w], buckets), w[ask_w], doc[ask_w].astype(np.int32)):
                rows[b] = [pack(k), pack(x), empty, empty]
            left = ~known
            for b, (k, x) in parts(bucket_of_pairs(u[left], pair[left], hot, buckets), pair[left], doc[left].astype(np.int32)):
                rows.setdefault(b, [empty, empty, empty, empty])[2:] = [pack(k), pack(x)]
            m = len(rows)
            blobs = [pa.array([r[i] for r in rows.values()], pa.binary()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(np.full(m, run)), *blobs, pa.nulls(m, held[0].schema.field(0).type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=names)
            # the texts themselves go with one of the buckets, in order
            ids = pa.concat_arrays([x.column(0) for x in held])
            place = pa.array([int(i).to_bytes(4, "little") for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, run % buckets)), pa.array(np.full(n, run)), pa.nulls(n, pa.binary()), place, *[pa.nulls(n, pa.binary())] * 2, ids, pa.array(counts + 1), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2])], names=names)

    def answer(asked: pa.Table, found: pa.Table) -> pa.Table:
        trim()
        text = pa.compute.is_valid(asked.column("n_tokens"))
        texts, asks = asked.filter(text), asked.filter(pa.compute.invert(text))
        if not asks.num_rows:
            return texts
        wk, base, v = join_packed(found, "wk"), join_packed(found, "base", float), join_packed(found, "v", float)
        pk, gain = join_packed(found, "pk"), join_packed(found, "gain", np.float32)
        out = []
        for run, *blobs in zip(*[asks.column(n).to_pylist() for n in names[1:6]], strict=True):
            k, k_doc, p, p_doc = unpack(blobs[0]), unpack(blobs[1], np.int32), unpack(blobs[2]), unpack(blobs[3], np.int32)
            sums = [np.zeros(0)] * 3
            size = 1 + max([-1, *(int(x.max()) for x in (k_doc, p_doc) if len(x))])
            sums = [np.zeros(size) for _ in range(3)]
            if len(k) and len(wk):
                spot = np.searchsorted(wk, k).clip(0, len(wk) - 1)
                hit = wk[spot] == k
                x, spot = k_doc[hit], spot[hit]
                sums = [np.bincount(x, minlength=size), np.bincount(x, base[spot] - unseen, size), np.bincount(x, v[spot] - unknown, size)]
            if len(p) and len(pk):
                spot = np.searchsorted(pk, p).clip(0, len(pk) - 1)
                hit = pk[spot] == p
                sums[2] = sums[2] + np.bincount(p_doc[hit], gain[spot[hit]], size)
            has = np.flatnonzero((sums[0] != 0) | (sums[2] != 0))
            if len(has):
                out.append((run, pack(has.astype(np.int32)), pack(sums[0][has].astype(np.int32)), pack(sums[1][has].astype(float)), pack(sums[2][has].astype(float))))
        m = len(out)
        got = {"run": 0, "word": 1, "word_doc": 2, "pair": 3, "pair_doc": 4}
        return pa.concat_tables([texts, pa.table([pa.array([r[got[f.name]] for r in out], f.type) if f.name in got else pa.nulls(m, f.type) for f in asked.schema], schema=asked.schema)])

    def total(table: pa.Table) -> pa.Table:
        text = pa.compute.is_valid(table.column("n_tokens"))
        texts, more = table.filter(text), table.filter(pa.compute.invert(text))
        place = np.frombuffer(b"".join(texts.column("word_doc").to_pylist()), np.int32)
        row = np.empty(len(place), np.int64)
        row[place] = np.arange(len(place))
        known, base, value = (texts.column(n).to_numpy().copy() for n in ("n_known", "base", "score"))
        for has, n, x, y in zip(*[more.column(c).to_pylist() for c in ("word", "word_doc", "pair", "pair_doc")], strict=True):
            at = row[unpack(has, np.int32)]
            known[at] += unpack(n, np.int32)
            base[at] += unpack(x, float)
            value[at] += unpack(y, float)
        return pa.table([texts.column("doc_id"), texts.column("n_tokens"), pa.array(known), pa.array(base), pa.array(value)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    nothing = F.lit(None).cast("binary")
    found = model.words.select(F.col("at").alias("b"), F.col("k").alias("wk"), "base", "v", nothing.alias("pk"), nothing.alias("gain"))
    found = found.union(model.pairs.select("b", nothing, nothing, nothing, "k", "v"))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = []
    for i in range(model.how.slices):
        some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(model.how.slices)) == i)
        answered = some.mapInArrow(ask, middle).groupBy("b").cogroup(found.groupBy("b")).applyInArrow(answer, middle)
        done.append(materialize(answered.groupBy("run").applyInArrow(total, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")))
        del answered
        tidy(spark)
    return reduce(DataFrame.unionByName, done)


def perplexity(scores: Column, tokens: Column) -> Column:
    """Of texts together: the inverse of the geometric mean of their tokens' probabilities."""
    return F.pow(F.lit(10.0), -F.sum(scores) / F.sum(tokens))


def held_out(c: Column) -> Column:
    return F.coalesce(crc_mod(c, 5) == 1, F.lit(False))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.filter(crc_mod(F.col("doc_id"), 5) != 1))
    scored = score(docs, model)
    for old in (model.pairs, model.words):
        discard(old)
    out = scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
