"""Unit tests of the semantic rules on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import text as X
from tarn.operators import answers, chat, listing, quality
from tarn.operators.search import chunks, search
from tarn.schemas import GREETING, NO_SUMMARY, ORG
from tarn.sources.catalog import Catalog, read_binary_base64


def test_strip_and_tokens_as_python(spark):
    rng = random.Random(1)
    alphabet = "aB?, \t\n\x1c\x1f　  é연구İ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.safe_text(F.col("t")).alias("s"), X.tokens_col(F.col("t")).alias("k")).collect():
        assert r.s == r.t.strip()
        assert r.k == X.tokens(r.t)


def test_csv(spark, tmp_path):
    (tmp_path / "events_clean.csv").write_text('﻿dept_name,title,event_date\nA,"two\nlines ""q""",2026-01-02\nNA,N/A, \nB,x,\n' + "\n" * 50, encoding="utf-8")
    (tmp_path / "people_clean.csv").write_text("name,role\n", encoding="utf-8")
    cat = Catalog(spark, str(tmp_path))
    rows = cat.table("events").orderBy("_ord").collect()
    assert [r.title for r in rows] == ['two\nlines "q"', None, "x"]
    assert rows[1].dept_name is None and rows[1].event_date == " " and rows[2].event_date is None
    assert cat.table("people").count() == 0 and cat.table("courses").count() == 0
    got = answers.table_answer(cat.table("events"), "event").first()
    assert got.answer.endswith('- A: two\nlines "q" (2026-01-02)\n- :  ()\n- B: x ()')
    assert [s.title for s in got.sources] == ['two\nlines "q"', "Event", "x"] and got.sources[1].meta == "Event"
    assert answers.answer("faculty?", cat.table).first().sources == []
    assert answers.answer("NLP 연구", cat.table, "Z").first().answer.startswith("Z는 ")
    assert answers.answer("zz", cat.table).first().sources[0].title.startswith(ORG)


def test_fallbacks(spark):
    df = spark.createDataFrame([("", "n")], "title string, name string")
    got = df.select(answers.row_sources(df, "Doc", "M").alias("x")).select("x.*").first()
    assert tuple(got) == ("Doc", "M", "")


@pytest.mark.parametrize("query,scores", [("ab ab", [2, 2, 2]), ("?", []), ("c++ 100%_", [2])])
def test_search(spark, query, scores):
    df = spark.createDataFrame([(3, None, "ab ab ab"), (1, "AB", None), (2, "t", "xaby"), (4, "t", "C++ is 100%_")], "_ord long, title string, text string")
    got = search(chunks(df), query).collect()
    assert [r.score for r in got] == scores and [r.ord for r in got] == sorted(r.ord for r in got)


def test_long_blanks(spark):
    """A long run of white space inside a text costs no more than any other."""
    import time

    text = "a" + " " * 200_000 + "b "
    df = spark.createDataFrame([(text,)], "t string")
    start = time.time()
    assert df.select(X.safe_text(F.col("t")).alias("t")).first().t == text.strip() and time.time() - start < 5


def test_overview(spark):
    df = spark.createDataFrame([(5, "aic", "e", "u5"), (1, "aic", " a", None), (2, "aic", None, " u2 "), (3, "aic", "c", "u3"), (4, "aic", "d", "u4")], "_ord long, dept string, text string, source_url string")
    rows = {r.dept: r for r in listing.departments(spark, df).collect()}
    assert len(rows) == 4 and rows["aic"].summary == " a c d" and rows["aic"].source_url == "u2" and rows["ax"].summary == NO_SUMMARY
    assert all(r.summary != NO_SUMMARY for r in listing.departments(spark, df.limit(0)).collect())


def test_overview_moves_no_texts(spark):
    """No text is sorted or shuffled before its group's first rows are known; equal places and null groups stay."""
    df = spark.createDataFrame([(i // 2, ("aic", "ax", None)[i % 3], None if i == 4 else f"t{i}") for i in range(30)], "_ord long, dept string, text string")
    out = listing.first_texts(df, 2)
    got = {r.dept: r.summary for r in out.collect()}
    assert got == {"aic": "t0 t3", "ax": "t1 t7", None: "t2 t5"}
    plan = listing.departments(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("BroadcastHashJoin [dept", 1)[-1] and "LeftSemi, BuildRight" in plan
    for line in out._jdf.queryExecution().executedPlan().toString().splitlines():
        assert not ("WindowGroupLimit" in line and "Partial" in line and "text" in line)


def test_chat(spark):
    h = chat.seed(spark, 7)
    reply = spark.createDataFrame([("yes", [("t", "m", "u")])], "answer string, sources array<struct<title:string,meta:string,url:string>>")
    got = chat.replay(chat.append(h, 7, "why?", reply)).collect()
    assert [(r.turn, r.role) for r in got] == [(0, "assistant"), (1, "user"), (2, "assistant")]
    assert got[0].content == GREETING.format(org=ORG) and got[2].sources[0].url == "u"


def test_quality(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("",)], "v string")
    assert quality.duplicate_count(df, "v").first()[0] == 1
    assert quality.missing(df, ["v"]).first()[0] == 2
    text = quality.distribution_text(df, "v").first()[0]
    assert text == "a: 2, : 1, b: 1"
    assert spark.range(1).select(quality.parse_distribution(F.lit("p: 2, q: 1"))).first()[0] == {"p": "2", "q": "1"}


def test_binary(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"\x00\x01")
    assert read_binary_base64(spark, str(tmp_path / "x.png")).first().content_base64 == "AAE="
    assert read_binary_base64(spark, str(tmp_path / "none.png")).count() == 0


def test_stream(spark, tmp_path):
    from tarn.streaming.questions import read_questions, write_routed

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"conv_id": 1, "question": "Any notice?"}\n{"conv_id": 2, "question": null}\n')
    write_routed(read_questions(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.conv_id, r.route) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "event"), (2, "default")}
