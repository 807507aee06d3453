"""The pipeline against a plain statement of each stage."""

import re

import pytest

import corpus_pipeline
from tarn.llm import ngram_join, pii, quality_rules, suffix_dedup
from tests.llm.test_joins import brute_bytes, brute_ngrams, shingles
from tests.llm.test_native import base

D = "/root/testdata/sf0.01"
pytest.importorskip("public_tokenizers")


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, D).cache()
    judged = {r.doc_id for r in quality_rules.judged(docs, spark.read.parquet(f"{D}/labels.parquet")).where("kept").collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == judged and kept.columns == columns
    one = stages["near_duplicates"](spark, kept, D).cache()
    want = {i for i, _, c in brute_ngrams([(r.doc_id, r.text) for r in rows]) if i == c}
    rows = one.collect()
    assert {r.doc_id for r in rows} == want and one.columns == columns
    clean = stages["repeated_passages"](spark, one, D).cache()
    left = {i: n - gone for i, n, gone, *_ in brute_bytes([(r.doc_id, r.text) for r in rows])}
    rows = clean.collect()
    assert {r.doc_id: r.n_chars for r in rows} == {r.doc_id: len(r.text) for r in rows} and clean.columns == columns
    assert all(0 <= left[r.doc_id] - len(r.text.encode()) <= 3 * 40 for r in rows) and {i for i, n in left.items() if n > 3} <= {r.doc_id for r in rows}
    private = stages["personal_data"](spark, clean, D).cache()
    spans = {r.id: [(x.s, x.e, x.kind) for x in r.spans] for r in pii.all_spans(clean).collect()}
    before = {r.doc_id: r.text for r in rows}
    for r in private.collect():
        if not spans[r.doc_id]:
            assert r.text == before[r.doc_id]
        else:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE|ID)\]", r.text)
            assert not [x for x in base(r.text) if x.startswith("email")]
    packed = stages["packing"](spark, private, D)
    assert packed.select("doc_id").distinct().count() == len(rows)


def test_stages_on_odd_rows(spark):
    """Null, empty and long texts, ties, repeated rows, clashing columns and empty tables pass every stage."""
    good = " ".join(f"word{i} of this plain text, line {i}." for i in range(40))
    rows = [(1, None), (2, ""), (3, good), (4, good), (4, good), (None, good + " more"), (5, "w " * 30000), (6, "x" * 100000), (7, good + " write to a@b.org now")]
    rows = [(i, t, "en", "s", len(t or ""), "k", "r", "_i", 1, 2, "t") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, row string, _id string, n long, id long, th string")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, D)
            got = out.collect()
            if name != "packing":
                assert out.columns == df.columns and all((r.key, r.row, r._id, r.n, r.id, r.th) == ("k", "r", "_i", 1, 2, "t") for r in got), name
            assert bool(got) == (df is docs), name
    texts = {r.doc_id for r in corpus_pipeline.quality(spark, docs, D).collect()}
    assert texts == {3, 4, 7, None}
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, docs, D).collect()) == [1, 2, 3, 5, 6]


def test_rows_without_id(spark):
    """Rows without an id are documents of their own: whole in each operator, and cut, redacted or dropped only for what they hold."""
    long = " ".join(f"word{i}" for i in range(60))
    own = " ".join(f"own{i}" for i in range(60))
    mail = 'write to a@b.org, password = "hunter"'
    rows = [(1, long), (2**61 + 1, "x " + own[:150]), (None, long), (None, own), (None, own), (None, mail), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect()), key=str)
    assert [(i, n) for i, n, _ in got if i] == [(1, 56), (2**61 + 1, len(shingles(rows[1][1])))] and len(got) == len(rows)
    assert [c for i, n, c in got if n == 56 and i is None].count(1) == 1 and len({c for i, n, c in got if n == 56}) == 2
    one = corpus_pipeline.near_duplicates(spark, docs, D)
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=str) == sorted(rows[:2] + rows[3:], key=str)
    cut = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicated(docs).collect()}
    assert {(1, len(long), 0), (None, len(long), len(long)), (2**61 + 1, 152, 0), (None, len(own), 150), (None, len(mail), 0), (None, 0, 0)} == cut
    clean = corpus_pipeline.repeated_passages(spark, docs, D)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([*rows[:2], (None, own[150:]), (None, own[150:]), (None, mail)], key=str)
    spans = [[(x.kind, x.s) for x in r.spans] for r in pii.all_spans(docs).collect() if r.id is None and r.spans]
    assert spans == [[(0, 9), (4, mail.index("hunter"))]]
    assert [r.text for r in corpus_pipeline.personal_data(spark, docs, D).collect() if "[" in (r.text or "")] == ['write to [EMAIL], password = "[ID]"']
