"""SQL of the operators, whole where SQL can express the result, else of the columns or invariants that it can."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.bpe import op2_bpe
from tarn.llm.kd_shards import op10_kd_shards
from tarn.llm.packing import op5_packing
from tarn.llm.pii import op9_pii
from tarn.llm.quality_rules import op7_quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _components(start: str, nodes: str) -> str:
    """CTE text: r (id, c) of everything reachable, from links l (a, b)."""
    return f"{start}, r(id, c) AS ({nodes} UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a), k AS (SELECT id, min(c) AS c FROM r GROUP BY id)"


OP3_SQL = (
    _components(
        """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93)""",
        "SELECT vec_id, vec_id FROM v",
    )
    + """
SELECT v.vec_id, count(l.b) AS n_links, any_value(k.c) AS component_id, any_value(k.c) = v.vec_id AS kept FROM v JOIN k ON k.id = v.vec_id LEFT JOIN l ON l.a = v.vec_id GROUP BY v.vec_id"""
)

OP6_SQL = (
    _components(
        f"""WITH RECURSIVE w AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c))""",
        "SELECT doc_id, doc_id FROM w",
    )
    + " SELECT n.doc_id, n.n AS n_shingles, k.c AS component_id FROM n JOIN k ON k.id = n.doc_id"
)

OP8_SQL = """WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM t),
w AS (SELECT doc_id, p, md5(b[p + 1:p + 100]) AS g FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS p FROM n)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w),
j AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS gap FROM f WHERE k > 1),
i AS (SELECT doc_id, p, sum(gap) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM j),
s AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM i GROUP BY doc_id, i),
c AS (SELECT doc_id, s AS pos, e AS upto, e - s AS gone FROM s UNION ALL SELECT doc_id, n, n, 0 FROM n),
q AS (SELECT doc_id, pos, gone, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY pos, gone DESC), 0) AS since FROM c),
h AS (SELECT q.doc_id, sum(gone) AS gone, count(*) - 1 AS runs, string_agg(CASE WHEN pos > since THEN hex(b[since + 1:pos]) ELSE '' END, '' ORDER BY pos, gone DESC) AS kept FROM q JOIN n ON n.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(h.gone AS BIGINT) AS n_removed, CAST(h.runs AS BIGINT) AS n_spans, sha256(unhex(h.kept)) AS kept_sha256 FROM n JOIN h ON h.doc_id = n.doc_id"""

QUALITY_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, range(8) o(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b"""

_DIGITS = "regexp_replace(x.v, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(d[length(d) - i + 1] AS INT) > 4 THEN CAST(d[length(d) - i + 1] AS INT) * 2 - 9 ELSE CAST(d[length(d) - i + 1] AS INT) * 2 END ELSE CAST(d[length(d) - i + 1] AS INT) END)) % 10 = 0"
#: Kind, pattern, and the test of a match x (x.v its text).
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(x.v, '.'), lambda p: CAST(p AS HUGEINT))) <= 255"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND len(list_filter([{_DIGITS}], lambda d: {_LUHN})) = 1"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
)


def _spans_sql(kind: str, regex: str, good: str) -> str:
    """Matches of one kind as structs (s, e, v): a start is what the gaps and matches before it have together."""
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{regex}')) + 1), lambda i: struct_pack(
 s := list_sum(list_transform(regexp_split_to_array(t, '{regex}')[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{regex}')[1:i - 1], lambda g: length(g))), 0), v := regexp_extract_all(t, '{regex}')[i])), lambda x: {good}) AS {kind}"""


PII_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, "
    + ", ".join(_spans_sql(*x) for x in _PII)
    + " FROM d) SELECT doc_id, "
    + ", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k, *_ in _PII)
    + ", sha256(array_to_string(list_concat("
    + ", ".join(f"list_transform({k}, lambda x: '{k}:' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + length(x.v) AS BIGINT))" for k, *_ in _PII)
    + "), ',')) AS base_sha256 FROM m"
)


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def packing_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces begin at 0 once, do not overlap and hold all of its ids; no sequence is over-full."""
    out = op5_packing(spark, sf_dir)
    per = out.groupBy("doc_id").agg(F.count_if(F.col("start") == 0).alias("firsts"), (F.sum("length") - F.max("doc_tokens")).alias("missing"), (F.max(F.col("start") + F.col("length")) - F.max("doc_tokens")).alias("beyond"))
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).agg(F.count_if((F.col("n") > 2048) | (F.col("n") != F.col("end"))).alias("bad_sequences")).withColumn("one", F.lit(1))
    return per.withColumn("one", F.lit(1)).join(full, "one").drop("one")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, how many shards each text lies in, whether a shard's slots are gapless and its bytes near the mean: no farther over it than the largest group of equal texts."""
    out = op10_kd_shards(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    both = out.join(docs, "doc_id")
    per = both.groupBy("h").agg(F.countDistinct("shard").alias("shards_of_text"))
    top = both.groupBy("h").agg(F.sum("size").alias("g")).agg(F.max("g").alias("g"))
    shards = out.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("c"), F.countDistinct("slot").alias("d"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    mean = out.agg((F.sum("size") / 40).alias("mean"))
    law = shards.join(F.broadcast(top), F.lit(True)).join(F.broadcast(mean), F.lit(True))  # one row each
    law = law.select("shard", ((F.col("low") == 0) & (F.col("c") == F.col("d")) & (F.col("high") == F.col("c") - 1)).alias("gapless"), (F.col("s") <= F.col("mean") + F.col("g")).alias("near_mean"))
    return both.join(per, "h").join(F.broadcast(law), "shard").select("doc_id", "size", "shards_of_text", F.col("shard").between(0, 39).alias("in_range"), "gapless", "near_mean")  # 40 rows


CHECKS = {"quality_base": quality_base, "pii_base": pii_base, "bpe_round_trip": bpe_round_trip, "packing_covers": packing_covers, "shard_law": shard_law}
CHECKS_SQL = {
    "quality_base": QUALITY_SQL,
    "pii_base": PII_SQL,
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "packing_covers": "SELECT doc_id, CAST(1 AS BIGINT) AS firsts, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS beyond, CAST(0 AS BIGINT) AS bad_sequences FROM documents",
    "shard_law": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, CAST(1 AS BIGINT) AS shards_of_text, TRUE AS in_range, TRUE AS gapless, TRUE AS near_mean FROM documents",
}
