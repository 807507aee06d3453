"""Quality rules, PII and sharding against brute force."""

import hashlib
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tarn.llm import kd_shards, pii, quality_rules

D = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def odd(spark, schema="doc_id long, text string, th string"):
    """Null, empty, long and repeated rows, and a column whose name clashes with an inner one."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", "a"), (4, "w" * 30000, "a"), (5, "one two three four five six seven eight nine " * 3000, "a"), (6, "same line\nsame line\nsame line", "a"), (6, "same line\nsame line\nsame line", "a"), (7, "mail x@y.com_z@w.org 1.2.3.4.5 300.1.1.1 4111 1111 1111 1111 +1 (487) 555-7209 a.b@c", "a")]
    return spark.createDataFrame(rows, schema)


def stats(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c, cov = Counter(win), set()
    for i, x in enumerate(win):
        if c[x] > 1:
            cov.update(range(i, i + 8))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), n < 20 or 100 * len(cov) > 30 * n


def test_quality_statistics(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for df in (docs, odd(spark)):
        rows = df.select("doc_id", "text").collect()
        got = quality_rules.text_stats(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        assert sorted(map(tuple, got)) == sorted((r.doc_id, *stats(r.text)) for r in rows)


def test_quality_held_out(spark):
    """Rules learnt on even documents hold on odd ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.learn(quality_rules.labelled_sample(docs, labels.where("doc_id % 2 = 0")))
    assert rules
    out = quality_rules.text_stats(docs).withColumn("rule", quality_rules.verdict(rules)).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n = {(r.quality, r.bad): r["count"] for r in out.groupBy("quality", (F.col("base_failed") | F.col("rule").isNotNull()).alias("bad")).count().collect()}
    learnt = {(r.quality, r.bad): r["count"] for r in out.where("not base_failed").groupBy("quality", F.col("rule").isNotNull().alias("bad")).count().collect()}
    assert n[0, True] > 0.95 * (n[0, True] + n.get((0, False), 0))
    assert learnt.get((1, True), 0) < 0.01 * learnt[1, False]


def test_quality_without_labels(spark):
    docs = odd(spark)
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    out = quality_rules.judged(docs, none)
    assert out.where("kept <> (not base_failed)").count() == 0
    assert quality_rules.filtered(docs, none).columns == docs.columns
    assert quality_rules.judged(docs.limit(0), none).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(x)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def good(kind, v):
    g = re.sub("[^0-9]", "", v)
    return all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 13 <= len(g) <= 19 and luhn(g) if kind == "card" else 9 <= len(g) <= 15 if kind == "phone" else True


def base(t):
    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t or "") if good(k, m.group())]


def test_pii_base(spark, tmp_path):
    odd(spark).drop("th").unionByName(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100)).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    rows = pii.op9_pii(spark, str(tmp_path)).collect()
    assert len(rows) == 1008
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert r.spans.split(",")[: len(want)] == want or not want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in BASE]


def test_pii_many_matches(spark):
    text = " ".join(f"{i % 250}.1.2.{i % 99}" for i in range(1500))
    got = pii.all_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.s, x.e) for x in got.base] == [m.span() for m in re.finditer(BASE["ip"], text)]


def test_pii_bootstraps(spark):
    """A context that known cards share finds a number that fails the checksum; others stay."""
    cards = [f"400000000000{i:03d}" for i in range(900)]
    cards = [c + str(next(d for d in range(10) if luhn(c + str(d)))) for c in cards][:12]
    rows = [(i, f"pay by account: {c} today") for i, c in enumerate(cards)] + [(50, "pay by account: 4000000000009999 today"), (51, "sum 4000000000009999 ok"), (52, 'api_key = "ab12cd34ef56"'), (53, "plain words only")]
    got = {r.id: [(x.kind, x.s) for x in r.spans] for r in pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not luhn("4000000000009999")
    assert got[50] == [(4, 16)] and got[51] == [] and got[53] == []
    texts = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts[0] == "pay by account: [CARD] today" and texts[50] == "pay by account: [ID] today" and texts[53] == "plain words only"


def test_pii_without_seed_words(spark):
    """Patterns that base seeds and random-looking values induce find held-out identifiers of other looks, without any word list."""
    import random

    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cards = [c + str(next(d for d in range(10) if luhn(c + str(d)))) for c in ("4" + digits(14) for _ in range(60))]
    bad = [x for x in ("4" + digits(15) for _ in range(80)) if not luhn(x)][:40]
    keys = ["".join(rng.choice("abcdef0123456789") for _ in range(40)) for _ in range(60)]
    short = ["".join(rng.choice("ghjkmnpq") for _ in range(9)) for _ in range(40)]
    held, plain = set(), set()
    rows = [f"customer account: {c} thanks" for c in cards] + [f'x handle = "{k}" y' for k in keys]
    for v, t in [(b, f"customer account: {b} thanks") for b in bad] + [(v, f'x HANDLE = "{v}" y') for v in short]:
        held.add((len(rows), t.index(v), t.index(v) + len(v)))
        rows.append(t)
    for i in range(60):
        plain.add(len(rows))
        rows.append(f'colour = "blue{i}" size: 12 cm in room{i:06d} of house 1234{i:05d}')
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.id, x.s, x.e) for r in pii.all_spans(docs, words=()).collect() for x in r.spans if x.kind == 4}
    assert len(held & got) >= 0.9 * len(held) and len(held) == 80
    assert not {i for i, *_ in got} & plain


def test_redacted_keeps_columns(spark):
    """Columns with names of inner ones stay; many and overlapping spans are replaced in one pass."""
    text = " ".join(f"a{i}@b.org 10.0.0.{i % 250}" for i in range(700))
    rows = [(1, text, "mine", "th", 5, "r"), (None, "plain", "x", "y", 5, "r"), (2, None, "x", "y", 0, "r"), (3, "é +1 (487) 555 20.1.1.1 x", "x", "y", 24, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, th string, n_chars long, row string")
    got = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert pii.redacted(df).columns == df.columns and (got[1]._id, got[1].th, got[1].row) == ("mine", "th", "r")
    assert got[1].text == " ".join(["[EMAIL] [IP]"] * 700) and got[1].n_chars == len(got[1].text)
    assert got[None].text == "plain" and (got[2].text, got[2].n_chars) == (None, 0) and got[3].text == "é [PHONE] x"


def test_pii_named_values(spark):
    """Values assigned to a seed word go however rare, short or plain they are; what only looks like it stays."""
    values = {1: ('x TOKEN = "9233A8ECF7C5B09FE594" y', "9233A8ECF7C5B09FE594"), 2: ('password = "hunter"', "hunter"), 3: ("passwd=s3!x ok", "s3!x"), 4: ("ssn: 12-34", "12-34"), 5: ("'secret': 'two words é'", "two words é"), 6: ("api_key: ab12cd34ef56", "ab12cd34ef56")}
    plain = {10: "the secret: patience", 11: "token = get(1)", 12: 'he said "hunter"', 13: "a password is a secret"}
    rows = [(i, t) for i, (t, _) in values.items()] + [(1, values[1][0])] * 9 + list(plain.items())
    got = [(r.id, [(x.kind, x.s, x.e) for x in r.spans]) for r in pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    for i, spans in got:
        assert spans == ([(4, values[i][0].index(values[i][1]), values[i][0].index(values[i][1]) + len(values[i][1]))] if i in values else []), i


def test_kd_tree(spark):
    """Each node is split along its widest dimension at the weighted median, to the group."""
    import random

    rng = random.Random(6)
    rows = [(rng.randint(1, 400), rng.randrange(1 << 24), rng.randint(0, 1000), rng.randint(0, 5) * 100, int(rng.gauss(0, 3e5))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "w long, tie long, x long, y long, z long")
    got = [(r.w, (r.x, r.y, r.z), r.tie, r.shard) for r in kd_shards.kd_tree(df, ["x", "y", "z"], 13).collect()]
    assert len(got) == len(rows)
    span = [max(g[1][d] for g in got) - min(g[1][d] for g in got) for d in range(3)]
    heaviest = max(g[0] for g in got)

    def hold(own, start, leaves):
        if leaves == 1:
            assert {g[3] for g in own} == {start}
            return
        wide = [(max(g[1][d] for g in own) - min(g[1][d] for g in own)) / span[d] for d in range(3)]
        d = wide.index(max(wide))
        left, right = ([g for g in own if (g[3] < start + leaves // 2) == side] for side in (True, False))
        assert max((g[1][d], g[2]) for g in left) < min((g[1][d], g[2]) for g in right)
        total, target = sum(g[0] for g in own), sum(g[0] for g in own) * (leaves // 2) / leaves
        assert abs(sum(g[0] for g in left) - target) <= heaviest + total / leaves * kd_shards.TOLERANCE
        hold(left, start, leaves // 2)
        hold(right, start + leaves // 2, leaves - leaves // 2)

    hold(got, 0, 13)


def check_shards(rows, texts, n=40):
    per = {}
    for r in rows:
        per.setdefault(r.shard, []).append(r)
    for x in per.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    group = {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
        assert group.setdefault(t, r.shard) == r.shard
    return {k: sum(r.size for r in x) for k, x in per.items()}


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = kd_shards.shard_documents(docs).collect()
    size = check_shards(rows, texts)
    assert len(rows) == len(texts) and len(size) == 40 and max(size.values()) < 1.05 * min(size.values())
    few = odd(spark)
    got = kd_shards.shard_documents(few, 4).collect()
    check_shards(got, {r.doc_id: r.text for r in few.collect()})
    assert len(got) == 8 and kd_shards.shard_documents(few.limit(0)).count() == 0


def test_shards_of_a_small_table_are_near_equal(spark):
    """No shard is over the mean by more than half of the largest group of equal texts, and none is empty."""
    from tarn.llm.kd_shards import shard_documents

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = shard_documents(docs)
    sizes = [r.s for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    largest = docs.groupBy("text").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("s")).agg(F.max("s")).first()[0]
    assert len(sizes) == 40 and max(sizes) <= sum(sizes) / 40 + largest / 2
