from __future__ import annotations

import json
from collections import Counter

import corpus_pipeline
from skeinspark.llm import bpe, quality
from skeinspark.llm.common import crc_mod, read  # noqa: F401
from tests.llm.test_dedup import brute_lines, brute_near, brute_near_rows
from tests.llm.test_text_operators import brute_leaks


def test_stages_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(corpus_pipeline.STAGES) == 5

    ranker = quality.fit(docs, quality.learnable(read(spark, sf, "labels")))
    good = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert good.columns == columns
    kept = {r.doc_id: r.text for r in good.collect()}
    scores = {r.doc_id: r.score for r in quality.classify(docs, ranker).collect()}
    assert kept.keys() == {i for i, s in scores.items() if s >= quality.CUT}

    lines = corpus_pipeline.STAGES[1][1](spark, good, sf)
    assert lines.columns == columns
    want = {i: t for i, _, t in brute_lines(list(kept.items()))}
    got = {r.doc_id: (r.text, r.n_chars, r.source) for r in lines.collect()}
    assert {i: t for i, (t, _, _) in got.items()} == want
    assert all(n == len(t) and s == rows[i].source for i, (t, n, s) in got.items())

    near = corpus_pipeline.STAGES[2][1](spark, lines, sf)
    assert near.columns == columns
    groups = brute_near(list(want.items()), 5, 80)
    firsts = {i for i, (_, c) in groups.items() if i == c}
    left = {r.doc_id: r.text for r in near.collect()}
    assert left.keys() == firsts

    clean = corpus_pipeline.STAGES[3][1](spark, near, sf)
    assert clean.columns == columns
    items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    leaks = {d for d, _, hit, _ in brute_leaks(list(left.items()), items) if hit}
    final = {r.doc_id: r.text for r in clean.collect()}
    assert final.keys() == left.keys() - leaks

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    out = corpus_pipeline.STAGES[4][1](spark, clean, sf).collect()
    assert Counter((r.doc_id, json.dumps(r["ids"])) for r in out) == Counter((i, json.dumps(library.encode(t, add_special_tokens=False).ids)) for i, t in final.items())

    whole = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.ids_sha256) for r in whole} == {(r.doc_id, r.ids_sha256) for r in out}


def test_stages_judge_each_row_by_its_text(spark, sf, odd_rows, tmp_path):
    """Repeated ids of different texts, rows without an id, nulls, repeated rows and columns with clashing names: nothing clean is lost."""
    item = " ".join(f"item{i}" for i in range(9))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"z{i}" for i in range(30))
    texts = [(r[0], r[1]) for r in odd_rows] + [(None, f"x {item}"), (None, "clean row without an id"), (30, f"{item} y"), (30, "clean row of a repeated id"), (1, long), (2, long), (2, "another text of two, all its own")]
    texts += [(41, long + " more"), (41, long + " more")]
    names = "gone_id bigint, gone_rk bigint, once_id bigint, once_rk bigint, kept string, dropped bigint, rk bigint, mark_id bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", 7, 1, 1, 1, 1, "k", 2, 3, 4) for i, t in texts], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}")
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    lines = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert lines.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in lines.collect()) == Counter((i, t) for i, _, t in brute_lines(texts))

    near = corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path))
    found = brute_near_rows(texts, 5, 80, groups=True)
    groups = {}
    for (i, t), (n, c) in zip(texts, found, strict=True):
        if i is not None and n:
            groups.setdefault(c, set()).add((i, t))
    left = pairs(near)
    for c, members in groups.items():
        stay = [m for m in left.elements() if m in members]
        assert len(stay) == 1 and stay[0][0] == min(i for i, _ in members)
    assert all(left[i, t] == Counter(texts)[i, t] for (i, t), (n, _) in zip(texts, found, strict=True) if i is None or not n)

    clean = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    leaks = {t for _, t in texts if t and item in t}
    assert pairs(clean) == Counter((i, t) for i, t in texts if t not in leaks)

    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == len(texts)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pairs(corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))) == Counter(texts)
