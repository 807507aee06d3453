"""The trigram index and the keyword automaton against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.functions.text import tokens
from tarn.operators import automaton, gram_index
from tarn.operators.answers import route_col
from tarn.operators.search import all_hits, chunks, search, search_many
from tarn.schemas import ROUTES


def corpus(n=120):
    r = random.Random(4)
    pool = ["ab", "abc", "abcabc", "é日本", "\U0001f600x", "c++", "100%_", "a", "q" * 70, "q" * 70 + "z", "\0b", "it's"]
    rows = [(i * 3, r.choice([None, "T", "Abc ab"]), " ".join(r.choice(pool) for _ in range(r.randint(0, 40)))) for i in range(n)]
    return [*rows, (1001, None, None), (1002, "", ""), (1003, "x", "y" * 9000 + "abcq")]


QUERIES = ["ab", "abc abc", "bcab ca", "日本", "é日本", "\U0001f600x", "c++ 100%_", "q" * 71, "a\0", "a", "", "?", "zz zz", "yyyy", "abcq", "b é", "  ab"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    found = chunks(spark.createDataFrame(corpus(), "_ord long, title string, text string")).persist()
    out = {}
    for name, sizes in {"whole": {}, "small": {"block": 7, "block_chars": 100}}.items():
        out[name] = f"file://{tmp_path_factory.mktemp('index')}/{name}"
        gram_index.build(found, out[name], **sizes)
    return found, out


@pytest.mark.parametrize("query", QUERIES)
def test_index_equals_scan(spark, built, query):
    found, paths = built
    want = sorted((r.ord, r.score) for r in all_hits(found, query).collect())
    for path in paths.values():
        assert sorted((r.ord, r.score) for r in gram_index.indexed_hits(spark, path, query).collect()) == want


def test_indexed_search(spark, built):
    found, paths = built
    for q in ("abc 日本", "zzzz"):
        want, got = search(found, q, 4).collect(), gram_index.indexed_search(spark, paths["small"], found, q, 4).collect()
        assert [(r.score, r.ord, r.title, r.text) for r in got] == [(r.score, r.ord, r.title, r.text) for r in want]


def test_index_reads_asked_lists_only(spark, built):
    """The condition reaches the scan as ranges, and files without an asked trigram are passed over."""
    _, paths = built
    scan = spark.read.parquet(paths["whole"])
    plan = scan.where(gram_index._wanted(["abc", "é日"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(gram" in plan
    asked = {low for w in ("abc",) for _, low, _ in gram_index.bounds(w)}
    assert scan.where(gram_index._wanted(["abc"])).select("gram").distinct().collect()[0].gram in asked
    assert scan.groupBy("gram", "block", "part").count().where("count > 1").count() == 0


def test_index_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    gram_index.build(chunks(spark.createDataFrame([], "_ord long, title string, text string")), path)
    assert gram_index.indexed_hits(spark, path, "abc").count() == 0


@pytest.mark.parametrize("chars", [automaton.SHARD_CHARS, 15])
def test_contained_equals_in(spark, chars, monkeypatch):
    texts = [(i, t) for i, _, t in corpus(60)] + [(7000, "x" * 5000 + "needle" + "y" * 5000), (7001, ("q" * 70 + "z") * 200)]
    words = sorted({w for _, t in texts if t for w in t.split(" ")[:3]} | {"needle", "ab", "b", "bc", "cab", "bcabc", "q" * 64, "q" * 65, "nothere", "é", "\0"})
    given = spark.createDataFrame([(w,) for w in words] + [("ab",), (None,), ("",)], "w string")
    df = spark.createDataFrame(texts, "ord long, text string")
    got = sorted((r.ord, r.w) for r in automaton.contained(df, given, shard_chars=chars).collect())
    assert got == sorted((i, w) for i, t in texts for w in words if w and w in (t or ""))


def test_table_of_a_shard_is_bounded(monkeypatch):
    import pandas as pd

    r = random.Random(1)
    words = sorted({"".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(500)})
    monkeypatch.setattr(automaton, "CELLS", 3000)
    text = "".join(r.choice("abcdefghi") for _ in range(5000))
    found = set()
    for half in (words[:250], words[250:]):
        a = automaton.Automaton.of(half)
        found |= {half[i] for i in a.found([text])[1]}
    assert found == {w for w in words if w in text}
    assert pd.Series(words).is_unique


def test_nothing_to_look_for(spark):
    df = spark.createDataFrame([(1, "abc")], "ord long, text string")
    none = spark.createDataFrame([], "w string")
    assert automaton.contained(df, none).count() == 0
    assert automaton.contained(df.limit(0), spark.createDataFrame([("a",)], "w string")).count() == 0


def test_routed_equals_router(spark):
    r = random.Random(2)
    words = [w for _, ws in ROUTES for w in ws] + ["abc", "xyz"]
    df = spark.createDataFrame([(i, None if i == 3 else " ".join(r.choice(words).upper() for _ in range(r.randint(0, 3)))) for i in range(80)], "q_id long, question string")
    want = {x.q_id: x.r for x in df.select("q_id", route_col(F.col("question")).alias("r")).collect()}
    assert {x.q_id: x.route for x in automaton.routed(df, ROUTES).collect()} == want


def test_search_many(spark):
    df = spark.createDataFrame([(i, f"t{i}", f"w{i} w{i + 1} w{i + 2}") for i in range(9)], "_ord long, title string, text string")
    asked = spark.createDataFrame([(1, "w3 w4 w5 w3"), (2, "none here"), (3, "w8"), (4, None)], "q_id long, question string")
    got = {(r.q_id, r.rk): (r.score, r.ord) for r in search_many(asked, chunks(df)).collect()}
    assert got == {(1, 1): (4, 3), (1, 2): (3, 2), (1, 3): (2, 1), (3, 1): (1, 6), (3, 2): (1, 7), (3, 3): (1, 8)}


def test_ten_thousand_tokens(spark):
    """Equal to a scan for each question, with one reading of the texts."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(10_000)]
    df = spark.createDataFrame([(i, "", " ".join(r.choice(vocab) for _ in range(20))) for i in range(50)], "_ord long, title string, text string")
    asked = [(i, " ".join(vocab[i * 100 : i * 100 + 100])) for i in range(100)]
    out = search_many(spark.createDataFrame(asked, "q_id long, question string"), chunks(df))
    rows = {r._ord: " " + r.text for r in df.collect()}
    want = {}
    for q, question in asked:
        score = {i: sum(w in t for w in tokens(question)) for i, t in rows.items()}
        want |= {(q, k + 1): (s, i) for k, (i, s) in enumerate(sorted([x for x in score.items() if x[1]], key=lambda x: (-x[1], x[0]))[:3])}
    assert {(r.q_id, r.rk): (r.score, r.ord) for r in out.collect()} == want


@pytest.mark.parametrize("table_chars", [1 << 24, 12])
def test_tables_equal_in(spark, table_chars):
    """Keywords by length, in one table and in many; long ones and those of several code points; more of them read the texts no more often."""
    texts = [(i, t) for i, _, t in corpus(60)] + [(7000, "x" * 300_000 + "needle" + "y" * 5000), (7001, ("q" * 70 + "z") * 200)]
    words = sorted({w for _, t in texts if t for w in t.split(" ")[:3]} | {"needle", "ab", "b", "bc", "cab", "q" * 64, "q" * 65, "nothere", "é", "\0", "b a", "x" * 200 + "n"})
    given = spark.createDataFrame([(w,) for w in words] + [("ab",), (None,), ("",)], "w string")
    df = spark.createDataFrame(texts, "ord long, text string")
    want = sorted((i, w) for i, t in texts for w in words if w and w in (t or ""))
    out = automaton.contained(df, given, shard_chars=15, table_chars=table_chars)
    assert sorted((r.ord, r.w) for r in out.collect()) == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 or table_chars < 15
    counts = {r.w: r.n for r in automaton.counted(df, given, table_chars=table_chars).collect()}
    assert counts == {w: n for w in words if (n := sum(x == w for _, x in want))}


@pytest.mark.parametrize("sizes", [{}, {"table_chars": 300, "chunk": 40}])
def test_scores_by_block(spark, sizes, monkeypatch):
    """Blocks of texts against chunks of questions; repeats, ties, weights beyond a byte, nulls."""
    from tarn.functions.text import tokens_col
    from tarn.operators import keyword_tables

    if sizes:
        monkeypatch.setattr(keyword_tables, "BLOCK_TEXTS", 7)
        monkeypatch.setattr(keyword_tables, "BATCH_CHARS", 300)
        monkeypatch.setattr(keyword_tables, "DENSE", 16)
    r = random.Random(5)
    vocab = ["".join(r.choice("abcd") for _ in range(r.randint(2, 5))) for _ in range(200)] + ["q" * 70]
    texts = [(5 * i % 61, " ".join(r.choice(vocab) for _ in range(r.randint(0, 12)))) for i in range(61)] + [(99, None)]
    asked = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 9)))) for i in range(50)] + [(77, "ab " * 300 + "cd"), (78, None), (79, "zz")]
    toks = spark.createDataFrame(asked, "q_id long, question string").select("q_id", F.explode(tokens_col(F.col("question"))).alias("w")).groupBy("q_id", "w").agg(F.count("*").alias("n"))
    got = {}
    for x in keyword_tables.scored(toks, spark.createDataFrame(texts, "ord long, text string"), 3, **sizes).collect():
        got.setdefault(x.q_id, []).append((-x.score, x.ord))
    want = {q: sorted((-s, i) for i, t in texts if (s := sum(w in (t or "") for w in tokens(a or ""))))[:3] for q, a in asked}
    assert {q: sorted(v)[:3] for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_texts_of_a_block_are_not_kept(spark, monkeypatch):
    """A block of many texts holds their numbers and words, not the batches they came in."""
    from tarn.operators import keyword_tables

    slices = keyword_tables.slices

    def few(column, chars):
        with open("/proc/self/status") as f:
            held = next(int(line.split()[1]) for line in f if line.startswith("RssAnon"))
        assert held < 150_000, f"{held} kB in a worker"
        return slices(column, chars)

    monkeypatch.setattr(keyword_tables, "slices", few)
    texts = spark.range(12_000).select(F.col("id").alias("ord"), F.concat(F.lit("needle"), F.col("id"), F.repeat(F.lit(" abc"), 4000)).alias("text")).coalesce(1)
    toks = spark.createDataFrame([(1, "needle2999", 1), (2, "nothere", 1)], "q_id long, w string, n long")
    assert [tuple(r) for r in keyword_tables.scored(toks, texts, 3).collect()] == [(1, 2999, 1)]


def test_block_and_questions_are_small_where_they_meet(spark, monkeypatch):
    """Lists of frequent words are bits and a question is a few bytes; neither is held as rows or sent as one."""
    from tarn.operators import keyword_tables

    best = keyword_tables.best_of_block

    def bounded(*args):
        with open("/proc/self/status") as f:
            held = next(int(line.split()[1]) for line in f if line.startswith("RssAnon"))
        assert held < 160_000, f"{held} kB in a worker"
        return best(*args)

    monkeypatch.setattr(keyword_tables, "best_of_block", bounded)
    words = [f"w{i:03d}" for i in range(300)]
    texts = spark.range(24_000).select(F.col("id").alias("ord"), F.concat(F.lit(" ".join(words)), F.lit(" x"), F.col("id")).alias("text")).coalesce(1)
    toks = spark.range(30_000).select(F.col("id").alias("q_id"), F.explode(F.array(*[F.format_string("w%03d", (F.col("id") + 7 * k) % 300) for k in range(30)], F.format_string("x%d", F.col("id") % 24_000))).alias("w"), F.lit(1).cast("long").alias("n"))
    got = keyword_tables.scored(toks, texts, 1).groupBy("q_id").agg(F.max("score").alias("score"), F.max_by("ord", "score").alias("ord"))
    assert got.where((F.col("score") == 31) & (F.col("ord") >= F.col("q_id") % 24_000)).count() == 30_000


def test_lists_of_a_block():
    """Rows of lists are cut by bytes, and give back each word's texts, frequent or not."""
    import numpy as np
    import pyarrow as pa

    from tarn.operators import keyword_tables

    r = np.random.default_rng(1)
    for n_texts in (1, 9, 3000):
        want = {w: np.unique(r.integers(0, n_texts, size=int(r.integers(1, n_texts + 1)) if w % 3 else 1)) for w in range(0, 900, 2)}
        keys = np.sort(np.concatenate([np.int64(w) << 32 | t for w, t in want.items()]))
        rows = list(keyword_tables._lists(keys, n_texts))
        assert max(len(data) for _, _, data in rows) <= keyword_tables.PART + n_texts // 8
        block = keyword_tables.Block(pa.array(range(n_texts)))
        for words, sizes, data in rows:
            block.add(words, sizes, np.frombuffer(data, dtype=np.uint8))
        block.ready()
        got = {w: np.flatnonzero(np.unpackbits(row)).tolist() for w, row in zip(block.bit_words.tolist(), block.bits, strict=True)}
        got |= {w: block.places[low:high].tolist() for w, low, high in zip(block.words.tolist(), block.ends[:-1], block.ends[1:], strict=True)}
        assert got == {w: texts.tolist() for w, texts in want.items()}
    assert list(keyword_tables._lists(np.zeros(0, dtype=np.int64), 5)) == []


@pytest.mark.parametrize(("dense", "row"), [(1 << 25, 64), (1 << 25, 4), (40, 64)])
def test_only_texts_that_can_be_best_are_scored(dense, row, monkeypatch):
    """Blocks searched together or one by one, with few rows of bits or many: the best texts, equal ones in order of their ids."""
    import numpy as np
    import pyarrow as pa

    from tarn.operators import keyword_tables

    monkeypatch.setattr(keyword_tables, "ROW", row)
    monkeypatch.setattr(keyword_tables, "LISTED", 3000)
    r, whole = np.random.default_rng(2), []
    scored = keyword_tables.Scores.all
    monkeypatch.setattr(keyword_tables.Scores, "all", lambda *args: whole.append(1) or scored(*args))
    shares = np.concatenate([np.full(10, 0.5), np.full(20, 0.1), np.full(1500, 0.01)])
    rich = r.choice([0.2, 1, 1.9], size=1501)
    there = r.random((1501, len(shares))) < np.outer(rich, shares)
    there[500:1000] = there[1000:1500] = there[:500]
    ids = r.permutation(5000)[:1501]
    asked = [np.flatnonzero(r.random(len(shares)) < 20 * shares / shares.sum()) for _ in range(200)]
    asked += [np.flatnonzero(there[t] & (r.random(len(shares)) < 0.8)) for t in r.integers(0, 1501, 160)]
    asked = [np.array([7]) if not len(x) else x for x in asked]
    ns = [r.choice([1, 1, 1, 2, 100], size=len(x), p=[0.5, 0.2, 0.2, 0.08, 0.02]) for x in asked]
    cuts = [0, 3, 700, 1300, 1501]
    for together in (1, 2, 4):
        packs = [(pa.array(range(len(asked))), np.concatenate(asked).astype(np.int32), np.array([len(x) for x in asked], dtype=np.int32), np.concatenate(ns).astype(np.int32))]
        questions, got = keyword_tables.Asked(packs, 3), {}
        for first in range(0, 4, together):
            blocks = []
            for low, high in list(zip(cuts, cuts[1:], strict=False))[first : first + together]:
                by = np.argsort(ids[low:high])
                block = keyword_tables.Block(pa.array(ids[low:high][by]))
                keys = np.sort(np.concatenate([np.int64(w) << 32 | np.flatnonzero(x) for w, x in enumerate(there[low:high][by].T)]))
                for words, sizes, data in keyword_tables._lists(keys, high - low):
                    block.add(words, sizes, np.frombuffer(data, dtype=np.uint8))
                blocks.append(block.ready())
            scores = keyword_tables.Scores(blocks, questions, dense)
            for q, i, s in keyword_tables.best_of_block(scores, questions, 3):
                for k, d, n in zip(q.tolist(), scores.ids.take(pa.array(i)).to_pylist(), s.tolist(), strict=True):
                    got.setdefault(k, []).append((-n, d))
        for k, (x, n) in enumerate(zip(asked, ns, strict=True)):
            total = there[:, x] @ n
            assert sorted(got.get(k, []))[:3] == sorted((-int(s), int(d)) for s, d in zip(total, ids, strict=True) if s)[:3], k
    assert 0 < len(whole) < 0.75 * 7 * len(asked)


def test_ranges_have_about_equal_bytes(spark):
    """A frequent trigram's long lists do not make a range larger; a task makes the lists of one block."""
    texts = [(i, "", "e e e " * 60 + "".join(chr(0x4E00 + (i * 50 + j) % 9000) for j in range(50))) for i in range(600)]
    lists = gram_index.postings(chunks(spark.createDataFrame(texts, "_ord long, title string, text string")), block=50)
    assert lists.rdd.getNumPartitions() == 12
    assert sorted(r.n for r in lists.groupBy(F.spark_partition_id()).agg(F.countDistinct("block").alias("n")).collect()) == [1] * 12
    edges = gram_index._edges(lists, 512, 64)
    size = F.sum(4 * F.size("places") + 12 * F.size("ords") + 32)
    dealt = gram_index._in_ranges(lists, edges)
    by = dealt.groupBy(F.spark_partition_id().alias("p")).agg(size.alias("s"), F.min(F.struct("gram", "block")).alias("low"), F.max(F.struct("gram", "block")).alias("high")).orderBy("p").collect()
    longest = lists.select(F.max(4 * F.size("places") + 12 * F.size("ords") + 32)).first()[0]
    assert len(edges) + 1 >= len(by) > 5 and max(r.s for r in by) <= 2 * 512 * 64 + longest
    assert all(a.high < b.low for a, b in zip(by, by[1:], strict=False)) and dealt.count() == lists.count()
