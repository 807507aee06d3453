"""Personal data by bootstrapped contextual extraction, native.

Base: regular expressions for email, ip, card and phone, with code-point spans.
Method: candidates are identifier-like tokens (eight or more of letters, digits, _ and -,
with a digit) and assigned values: all of a quoted value after ``=`` or ``:`` and a word, an unquoted one after
``=``, and after ``:`` if it has a digit (without, it may be prose).  Seeds are candidates that a
base pattern matches, those that look random (RANDOM: long, letters and digits by turns), and values
assigned to one of the seed words, which are optional.  A candidate has two
lexical patterns: its context on the left with its shape (kind of characters and
length), and, where it is assigned, the context with what encloses it, whatever its shape.  Spark scores
the graph of patterns and values in rounds: a pattern scores the smoothed
mean of its values, a value that is no seed the best of its patterns of
enough support.  Patterns over THRESHOLD give the kind ``id``: all their
candidates that no base span touches, seen or unseen, everywhere.  Values assigned to a seed
word have it too, however rare their pattern is: support is for spreading only.
Up to four blanks may stand between what assigns and the value; of what stands before a value, its last CONTEXT characters
make the pattern.

Null or empty text has no spans; repeated rows have equal spans; a row without
an id has spans like any other; an empty table gives an empty result; columns of any name pass through ``redacted``.
Patterns possessive throughout, so long runs cost linear time and no stack.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import dropped, saved, text_or_empty

# The base patterns as the contract gives them, each made linear:
# a match starts where a run does, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: An identifier: whole run of its characters, with a digit.
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+"
SEED_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "passport", "ssn", "iban")
#: Long, with digits and other characters by turns.
RANDOM = r"\A(?=[A-Za-z0-9_-]{20,}+\z)(?:[^0-9]*+[0-9]++(?=[^0-9])){4}"
#: A word and what assigns to it; assigned values, then identifiers.
_WORD = r"[A-Za-z_][\"']?\s{0,4}"
ASSIGNED = rf"{_WORD}[=:]"
VALUE = rf"(?<=[\s=:\"'])(?:(?<={_WORD}[=:]\s{{0,4}}[\"'])[^\"'\r\n]++(?=[\"'])|(?<={_WORD}=\s{{0,4}})[^\s\"',;()\[\]{{}}<>=]++(?![(\[{{=])|(?<={_WORD}:\s{{0,4}})(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]++)|{TOKEN}"
#: A context that assigns, for the pattern without shape.
ASSIGNS = r"[=:][\s\"']*\z"
ROUNDS, THRESHOLD, SUPPORT, SMOOTH = 3, 0.6, 5, 1.0
CONTEXT = 40
BLOCK = 256


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _matches(text: Column, regex: str) -> Column:
    """array<struct<s, e, v, left>>: span (code points), value, and the end of what lies between it and the match before.

    Starts are running sums of the lengths of gaps and matches, over blocks of
    BLOCK matches and then within each, so many matches stay cheap.
    """
    size = lambda x: F.length(x["g"]) + F.length(x["v"])
    none = F.array().cast("array<int>")

    def place(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<struct<s:int,e:int,v:string,left:string>>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["g"])).alias("s"), (a["at"] + size(x)).alias("e"), x["v"].alias("v"), F.right(x["g"], F.lit(CONTEXT)).alias("left")))).alias("out"))
        return F.aggregate(block, zero, step, lambda a: a["out"])

    def of(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))
        return _let(blocks, lambda bs: _let(F.aggregate(bs, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, b: F.struct((a["at"] + F.aggregate(b, F.lit(0), lambda n, x: n + size(x))).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]), lambda starts: F.flatten(F.transform(bs, lambda b, i: place(b, F.get(starts, i))))))

    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)
    zipped = _let(found, lambda v: F.when(F.size(v) > 0, F.zip_with(v, F.slice(gaps, 1, F.size(v)), lambda a, g: F.struct(g.alias("g"), a.alias("v")))))
    return _let(zipped, lambda p: F.when(p.isNotNull(), of(p)).otherwise(F.array().cast("array<struct<s:int,e:int,v:string,left:string>>")))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:  # i from 1, at the right end
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _good(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]+", "")
    if kind == "ip":
        return F.rlike(v, F.lit(r"\A0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\z"))
    if kind == "card":
        return _let(digits, lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind:int, s, e>> by kind as listed, then start. Cheap tests spare texts without a match the costly ones."""
    gate = {"email": F.contains(text, F.lit("@")), "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), "card": F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    parts = []
    for k, (kind, regex) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)):
        kept = _kept(text, regex, kind)
        parts.append(F.when(gate[kind], F.transform(kept, _struct_of(k))).otherwise(none))
    return F.concat(*parts)


def _kept(text: Column, regex: str, kind: str) -> Column:
    return F.filter(_matches(text, regex), lambda m: _good(kind, m["v"]))


def _struct_of(kind: int):
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"))


def _candidates(text: Column) -> Column:
    """array<struct<s, e, v, left>> of identifier-like tokens and assigned values."""
    none = F.array().cast("array<struct<s:int,e:int,v:string,left:string>>")
    return F.when(F.rlike(text, F.lit(ASSIGNED)), _matches(text, VALUE)).when(F.rlike(text, F.lit(TOKEN)), _matches(text, TOKEN)).otherwise(none)


def _shape(v: Column) -> Column:
    n = F.length(v).cast("string")
    return F.when(F.rlike(v, F.lit(r"\A[0-9]+\z")), F.concat(F.lit("d"), n)).when(F.rlike(v, F.lit(r"\A[0-9a-f]+\z")), F.concat(F.lit("x"), n)).when(F.rlike(v, F.lit(r"\A[A-Z0-9]+\z")), F.concat(F.lit("U"), n)).otherwise(F.lit("mixed"))


def _context(left: Column) -> Column:
    """The last word on the left with what follows it, lower-cased, white space as one space."""
    return F.lower(F.regexp_replace(F.regexp_extract(left, r"(\S*\w\S*[^\w]*)\z", 1), r"\s+", " "))


def spans_of(docs: DataFrame, id_col: str = "doc_id", words: tuple[str, ...] = SEED_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows has id, key and base spans of each document; found has, by key, the spans that the method adds.

    The key is (id, hash of the text): equal rows share it, and ``found`` has it once.
    """
    text = text_or_empty()
    seen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), base_spans(text).alias("base"), _candidates(text).alias("cand"))
    rows = saved(seen, "pii")
    touch = lambda c: F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    flat = rows.where(F.size("cand") > 0).select("id", "th", F.explode(F.transform("cand", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["v"].alias("v"), c["left"].alias("left"), touch(c).alias("known")))).alias("c")).select("id", "th", "c.*")
    context = _context(F.col("left"))
    named = F.rlike(context, F.lit(rf"(?:\A|[^a-z])(?:{'|'.join(words)})\W*[=:]\W*\z")) if words else F.lit(False)
    narrow, wide = F.concat(context, F.lit("\x01"), _shape(F.col("v"))), F.when(F.rlike(context, F.lit(ASSIGNS)), context)
    seed = F.col("known") | named | F.rlike("v", F.lit(RANDOM))
    inst = flat.select("id", "th", "s", "e", "known", F.xxhash64("v").alias("value"), narrow.alias("narrow"), wide.alias("wide"), named.alias("named"), seed.alias("seed"))
    inst = saved(inst, "instances")
    both = inst.select(F.explode(F.array_compact(F.array("narrow", "wide"))).alias("pattern"), "value", "seed")
    edges = saved(both.groupBy("pattern", "value").agg(F.max("seed").cast("int").alias("seed")), "graph")
    seeds = saved(edges.groupBy("value").agg(F.max("seed").cast("double").alias("seed")), "seeds")
    scores = seeds.withColumn("score", F.col("seed"))
    for _ in range(ROUNDS):
        patterns = edges.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + SMOOTH)).alias("p"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
        reach = edges.join(patterns, "pattern").groupBy("value").agg(F.max("p").alias("p"))
        new = saved(seeds.join(reach, "value", "left").select("value", F.greatest("seed", F.coalesce("p", F.lit(0.0))).alias("score")), "scores")
        dropped(scores)
        scores = new
    best = saved(edges.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + SMOOTH)).alias("p"), F.count(F.lit(1)).alias("n")).where((F.col("p") >= THRESHOLD) & (F.col("n") >= SUPPORT)).select("pattern"), "patterns")
    dropped(scores, edges, seeds)
    unknown = inst.where("not known")
    spread = unknown.select("id", "th", "s", "e", F.explode(F.array_compact(F.array("narrow", "wide"))).alias("pattern")).join(best, "pattern", "left_semi")
    added = unknown.where("named").select("id", "th", "s", "e").unionAll(spread.select("id", "th", "s", "e"))
    found = added.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("more"))  # a document's own spans
    return rows, found


def all_spans(docs: DataFrame, id_col: str = "doc_id", words: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """id, th, base (spans) and spans (base, then those of kind 4, ``id``)."""
    rows, found = spans_of(docs, id_col, words)
    more = F.coalesce(F.transform("more", lambda x: F.struct(F.lit(4).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))), F.array().cast("array<struct<kind:int,s:int,e:int>>"))
    found = found.select(F.col("id").alias("_i"), F.col("th").alias("_t"), "more")
    return rows.drop("cand").join(found, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t")), "left").select("id", "th", "base", F.concat("base", more).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _ends_before(spans: Column) -> Column:
    """For each span, the largest end before it (0 at first), and at last that of all: over blocks of BLOCK spans, then within each."""
    none = F.array().cast("array<int>")

    def runs(values: Column, start: Column) -> Column:  # running maximum, from start on, without the last
        first = F.struct(start.alias("top"), none.alias("out"))
        return F.aggregate(values, first, lambda a, x: F.struct(F.greatest(a["top"], x).alias("top"), F.concat(a["out"], F.array(a["top"])).alias("out")), lambda a: a["out"])

    def of(ends: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(ends) / BLOCK).cast("int")), lambda b: F.slice(ends, b * BLOCK + 1, BLOCK))
        tops = lambda bs: runs(F.transform(bs, lambda b: F.coalesce(F.array_max(b), F.lit(0))), F.lit(0))
        return _let(blocks, lambda bs: _let(tops(bs), lambda t: F.flatten(F.transform(bs, lambda b, i: runs(b, F.get(t, i))))))

    return _let(F.transform(spans, lambda x: x["e"]), lambda ends: F.concat(of(ends), F.array(F.coalesce(F.array_max(ends), F.lit(0)))))


def redacted(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows with each span replaced by its kind in brackets (overlapping spans as one, by the first); other columns stay, n_chars follows."""
    spans = all_spans(docs, id_col).where(F.size("spans") > 0).groupBy("id", "th").agg(F.first("spans").alias("spans"))  # equal rows have equal spans
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).alias("mine"), F.xxhash64(text_or_empty()).alias("own"))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "id")])
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    spans = spans.select("id", "th", by_start.alias("spans")).withColumn("ends", _ends_before(F.col("spans")))
    both = keyed.join(spans, F.col("mine").eqNullSafe(F.col("id")) & (F.col("own") == F.col("th")), "left")
    text = F.col("row.text")
    part = lambda x, i: F.when(x["s"] < F.get("ends", i), F.lit("")).otherwise(F.concat(F.substring(text, F.get("ends", i) + 1, x["s"] - F.get("ends", i)), F.get(marks, x["kind"])))
    done = F.concat(F.array_join(F.transform("spans", part), ""), F.substring(text, F.element_at("ends", -1) + 1, F.length(text)))
    both = both.withColumn("done", F.when(F.col("spans").isNull(), text).otherwise(done))
    new = {"text": F.col("done")} | ({"n_chars": F.coalesce(F.length("done").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return both.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    out = all_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _is(k: int):
    return lambda x: x["kind"] == k
