from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skeinspark.llm import common, line_dedup, near_dup
from skeinspark.llm.common import materialize
from skeinspark.llm.exact_dedup import exact_dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for norm, members in groups.items():
        with_id = [m for m in members if m[0] is not None]
        keep = min(with_id, key=lambda m: (-len(m[1] or ""), m[0]))[0] if with_id else None
        out += [(m[0], keep, len(members), m[0] == keep, hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", ["sha", "first digit", "nothing"])
def test_exact_dedup_compares_contents(odd, odd_rows, digest):
    """A digest that collides gives the same result, by way of the contents."""
    d = {"sha": {}, "first digit": {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1)}, "nothing": {"digest": lambda c: F.lit("x")}}[digest]
    got = sorted(map(tuple, exact_dedup(odd, **d).collect()), key=str)
    assert got == brute_exact(odd_rows)


def brute_lines(rows, least=20, docs=3):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= docs}
    out = []
    for i, t, *_ in rows:
        kept = [x for x in (t or "").split("\n") if i is None or key(x) not in gone or gone[key(x)] == i]
        out.append((i, (t or "").count("\n") + 1 - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(odd, odd_rows):
    odd = odd.withColumns({c: F.lit(1) for c in ("mark_id", "mark_rk", "mark_keep", "dropped_", "rk", "__id", "__key")})
    got = line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd)).select("doc_id", "dropped", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(odd_rows)


def test_line_dedup_bitmaps_of_many_lines(spark):
    shared = [f"a line that is shared number {i:04d}" for i in range(300)]
    rng = random.Random(3)
    rows = [(i, "\n".join(x if rng.random() < 0.7 else f"own {rng.random()}" for x in shared)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).select("doc_id", "dropped", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def brute_near_rows(rows, size, percent, groups=False):
    """(shingles, component) of each row; rows of one id are judged by their own texts. groups: (shingles, number of the group) instead."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    on = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for a in on:
        for b in on:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    least = {}
    for i in on:
        least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    if groups:
        return [(len(sets[i]), find(i)) for i in range(len(rows))]
    return [(len(sets[i]), least[find(i)] if i in least or find(i) in least else r[0]) for i, r in enumerate(rows)]


def brute_near(rows, size, percent):
    return {r[0]: found for r, found in zip(rows, brute_near_rows(rows, size, percent), strict=True)}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_near_duplicates_of_odd_rows(odd, odd_rows, size, percent):
    got = near_dup.near_duplicates(odd, size, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((r[0], *f) for r, f in zip(odd_rows, brute_near_rows(odd_rows, size, percent), strict=True)), key=str)


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id and different texts each keep their links."""
    base = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    near = [t + " end" for t in base]
    rows = [(5, base[0]), (5, base[1]), (7, near[0]), (8, near[1]), (9, near[0]), (9, base[2]), (3, base[3]), (3, base[3]), (4, near[2]), (None, base[0]), (None, near[3]), (2, "x"), (2, None), (6, near[2])]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()
    want = sorted(((r[0], *f) for r, f in zip(rows, brute_near_rows(rows, 3, 90), strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert (8, 39, 5) in want and (9, 39, 5) in want and (9, 38, 4) in want


def test_join_by_broadcast_of_hot_keys(spark, monkeypatch):
    """The same rows with every key hot, some and none."""
    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(4**k)] + [(None, 1)], "key int, i int")
    table = materialize(rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum("i").alias("s")))
    want = sorted(map(tuple, rows.join(table.drop("rows"), "key").collect()))
    for share in (1, 10, 10_000):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        monkeypatch.setattr(common, "HOT_LEAST", 1)
        assert sorted(map(tuple, common.join_hot(rows, table, "key", 1366).collect())) == want


def test_near_duplicates_around_an_original(spark):
    """Copies of one original, each edited on its own: many are similar to the original alone; and a common passage that links nobody."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(50, " ".join(base))]
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            words[rng.randrange(120)] = f"e{rng.random()}"
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, " ".join(passage + [f"q{i}_{j}" for j in range(40)])) for i in range(40)]
    want = brute_near(rows, 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()}
    assert got == want
    assert len({c for i, (_, c) in got.items() if i < 300}) < 30


def test_slices_keep_every_link(spark, sf, monkeypatch):
    docs = common.read(spark, sf, "documents").select("doc_id", "text")
    whole = sorted(tuple(r) for r in near_dup.near_duplicates(docs, 3, 90).collect())
    monkeypatch.setattr(near_dup, "SLICE_BYTES", 1 << 12)
    monkeypatch.setattr(near_dup, "SLICES_MOST", 3)
    kept = []
    monkeypatch.setattr(near_dup, "materialize", lambda df: kept.append((set(df.columns), (out := common.materialize(df)).count())) or out)
    assert sorted(tuple(r) for r in near_dup.near_duplicates(docs, 3, 90).collect()) == whole
    # whole sets are written in slices, and only those that a pair needs whose sketches allow a link
    sets, sketches = ([n for names, n in kept if name in names] for name in ("shingles", "sketch"))
    assert len(sets) > 1 and len(sketches) == 1 and max(sets) < sketches[0]


def test_empty_tables(none):
    assert exact_dedup(none).count() == 0
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0
    assert near_dup.near_duplicates(none).count() == 0


def test_no_link_is_lost_between_offered_blocks():
    """The offered blocks of two similar sets meet, whatever the order of common ones."""
    import numpy as np

    rng = np.random.default_rng(1)
    for percent in (80, 90):
        bands = near_dup.Bands(percent)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            cut = int(rng.integers(0, max(1, (100 - percent) * n // 100) + 1))
            b = np.concatenate([a[: n - cut], rng.integers(0, 2**63, int(rng.integers(0, cut + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                continue
            found = False
            for g in set(bands.of(len(a))) & set(bands.of(len(b))):
                offers = []
                for s in (a, b):
                    key, bits, offer = bands.blocks(s, g)
                    often = key % 3  # any function of the block
                    offers.append(set(key[np.lexsort((key, -bits, often))[:offer]].tolist()))
                found |= bool(offers[0] & offers[1])
            assert found


def test_blocks_are_counted_over_all_tasks(spark):
    """Blocks that many documents share come last, whatever task holds them."""
    import numpy as np

    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"q{i}_{j}" for j in range(60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    bands = near_dup.Bands(90)
    cells = near_dup.count_blocks(near_dup.materialize(near_dup.describe(docs, 3, bands)))
    often = near_dup.Common(cells)
    import pyarrow as pa

    total = 0
    for s in near_dup.Shingler(3)(pa.array([t for _, t in rows])):
        for g in bands.of(len(s)):
            total += len(bands.blocks(s, g)[0])
    assert cells.sum() == total
    keys = [bands.blocks(s, bands.band(len(s)))[0] for s in near_dup.Shingler(3)(pa.array([t for _, t in rows]))]
    k, n = np.unique(np.concatenate(keys), return_counts=True)
    assert (often(k[n > 100]) > 0).all()


def test_word_hashes():
    """Equal words and only they share a hash, in pieces of any size and across the border of a period."""
    import numpy as np
    import pyarrow as pa

    from skeinspark.llm import tokens

    rng = np.random.default_rng(6)
    texts = [None, "", " ", "é É\x0ba\x0cA", "x" * 3000, *("".join(rng.choice(list("abAB \t\né"), int(rng.integers(0, 60)))) for _ in range(300))]
    small = tokens.WordHasher()
    period, tokens.PERIOD = tokens.PERIOD, 64
    try:
        short = tokens.WordHasher()
        for hasher in (small, short):
            tokens.PERIOD = period if hasher is small else 64
            known = {}
            for batch in tokens.pieces([pa.record_batch([pa.array(texts)], names=["t"])], 0, 50, 500):
                h, n = hasher(batch.column(0))
                words = [(t or "").encode().lower().split() for t in batch.column(0).to_pylist()]
                assert n.tolist() == [len(w) for w in words]
                for w, x in zip([w for ws in words for w in ws], h.tolist(), strict=True):
                    assert known.setdefault(w, x) == x
            assert len({*known.values()}) == len(known) > 200
    finally:
        tokens.PERIOD = period
