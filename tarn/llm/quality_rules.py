"""Quality rules by a learned decision list, native.

``text_stats`` gives the statistics of a text as built-in expressions on its
own row: nothing is exploded or shuffled.  ``learn`` fits an ordered list of
threshold conjunctions by sequential covering on at most MAX_LABELLED labelled
rows (those with the smallest hash of their id): a rule grows by the condition
of the largest gain on two thirds of them, and is pruned on the other third.
``verdict`` turns the list into one ordered Spark CASE expression.

Null or empty text has no words (so it fails the base rule); ties between
conditions go to the first in order; repeated rows get equal verdicts; an
empty table gives an empty result; without any usable label the list is empty
and only the base rule rejects.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.shared import dropped, saved, text_or_empty

WINDOW = 8
MAX_LABELLED = 6000
SPACE = r"[\x20\x09-\x0D]+"
#: What no statistic counts: anything but symbols, capitals, digits and exclamation marks.
PLAIN = r"[^#*$%&|<>!0-9\p{Lu}]+"
FEATURES = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "upper_ratio", "exclaim_ratio", "digit_ratio", "word_len", "bar_ratio")


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once for the row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash is found twice or more."""

    def of(s: Column) -> Column:  # sorted (hash, place)
        here = lambda e, k: F.when((F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]), e["i"])
        places = F.array_sort(F.array_compact(F.transform(s, here)))
        first = F.struct(F.lit(-WINDOW).alias("prev"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("prev"), (a["n"] + F.least(F.lit(WINDOW), x - a["prev"])).alias("n"))
        return F.aggregate(places, first, step, lambda a: a["n"])

    return _let(F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of)


def _windows(words: Column) -> Column:
    """A hash of each window of eight words, from hashes of one, two and four by doubling."""

    def pairs(h: Column, apart: int) -> Column:
        return F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - apart, F.lit(0))), F.slice(h, apart + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(pairs(h, 1), lambda h: _let(pairs(h, 2), lambda h: pairs(h, 4))))


def _repeat_words(words: Column) -> Column:
    some = _let(_windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(some)


def _without(text: Column, regex: str) -> Column:
    return F.length(F.regexp_replace(text, regex, ""))


def text_stats(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the features of the list."""
    text = text_or_empty()
    raw = docs.select(id_col, F.regexp_replace(text, PLAIN, "").alias("marks"), F.array_remove(F.split(text, SPACE), "").alias("w"), F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("l"))
    stats = raw.select(
        id_col,
        F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _without(F.col("marks"), r"[^#*$%&|<>]+").cast("long").alias("n_symbols"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"), F.greatest(F.size("l"), F.lit(1)).alias("lines"),
        _without(F.col("marks"), r"[^\p{Lu}]+").alias("upper"), _without(F.col("marks"), "[^!]+").alias("exclaim"), _without(F.col("marks"), "[^0-9]+").alias("digits"), _without(F.col("marks"), "[^|]+").alias("bars"),
    )
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / words).alias("symbol_ratio"), (F.col("n_repeat_words") / words).alias("repeat_ratio"), (F.col("n_dup_lines") / F.col("lines")).alias("dup_line_ratio"),
        (F.col("upper") / chars).alias("upper_ratio"), (F.col("exclaim") / words).alias("exclaim_ratio"), (F.col("digits") / chars).alias("digit_ratio"), (F.col("word_chars") / words).alias("word_len"), (F.col("bars") / words).alias("bar_ratio"),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", bound: int = MAX_LABELLED) -> list[tuple]:
    """At most ``bound`` rows (features..., quality), collected."""
    some = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(id_col, "quality").orderBy(F.xxhash64(id_col), "quality").limit(bound)
    texts = saved(docs.select(id_col, "text").join(F.broadcast(some), id_col), "labelled")  # at most ``bound`` pairs of numbers; written first, so only these texts are counted
    stats = text_stats(texts.select(F.struct(id_col, "quality").alias(id_col), "text"), id_col)
    out = [tuple(r) for r in stats.where("not base_failed").select(*FEATURES, F.col(id_col)["quality"].alias("quality")).orderBy(F.xxhash64(id_col)).limit(bound).collect()]
    dropped(texts)
    return out


def _fits(row: tuple, rule) -> bool:
    return all(row[f] >= t if up else row[f] <= t for f, up, t in rule)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else -1.0


def _grow(rows: list[tuple], longest: int, cuts: int) -> list:
    """The conjunction for quality 0, a condition at a time."""
    rule: list = []
    while len(rule) < longest:
        p0, n0 = sum(not r[-1] for r in rows), sum(bool(r[-1]) for r in rows)
        if not n0 or not p0:
            break
        best = (0.0, None)
        for f in range(len(FEATURES)):
            # thresholds halfway between rejected rows' values and their neighbours
            values = sorted({r[f] for r in rows})
            bad = sorted(r[f] for r in rows if not r[-1])
            wanted = {bad[k * (len(bad) - 1) // cuts] for k in range(cuts + 1)}
            at = {v: i for i, v in enumerate(values)}
            ordered = sorted((r[f], bool(r[-1])) for r in rows)
            pre_p, pre_n, upto = 0, 0, {}
            for v, good in ordered:
                pre_p, pre_n = pre_p + (not good), pre_n + good
                upto[v] = (pre_p, pre_n)
            for v in sorted(wanted):
                i = at[v]
                below = upto[values[i - 1]] if i else (0, 0)
                up = (p0 - below[0], n0 - below[1])
                for gain, cond in ((_gain(p0, n0, *up), (f, True, (v + values[i - 1]) / 2 if i else v)), (_gain(p0, n0, *upto[v]), (f, False, (v + values[i + 1]) / 2 if i + 1 < len(values) else v))):
                    if gain > best[0] + 1e-12:
                        best = (gain, cond)
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if _fits(r, [best[1]])]
    return rule


def learn(rows: list[tuple], longest: int = 3, cuts: int = 24, precision: float = 0.97, least: int = 5) -> list:
    """Ordered rules that reject; a row that no rule fits is kept."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    rules: list = []
    while sum(not r[-1] for r in grow) >= least:
        rule = _grow(grow, longest, cuts)
        if not rule:
            break

        def worth(x: list) -> float:
            p, n = (sum(bool(r[-1]) == k for r in prune if _fits(r, x)) for k in (False, True))
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = [bool(r[-1]) for r in grow + prune if _fits(r, rule)]
        if len(hit) < least or hit.count(False) < precision * len(hit):
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not _fits(r, rule)], [r for r in prune if not _fits(r, rule)]
    return rules


def verdict(rules: list) -> Column:
    """The number of the first rule that fits, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        cond = F.lit(True)
        for f, up, t in rule:
            cond = cond & (F.col(FEATURES[f]) >= t if up else F.col(FEATURES[f]) <= t)
        out = F.when(cond, k).otherwise(out)
    return out


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Statistics, base_failed, rule (that rejects, else null) and kept of each row."""
    rules = learn(labelled_sample(docs, labels, id_col))
    return text_stats(docs, id_col).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows kept, with their columns. The row itself passes through as the id, so nothing is joined."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    rules = learn(labelled_sample(docs, labels, id_col))
    out = text_stats(row, "row").withColumn("rule", verdict(rules)).where(~F.col("base_failed") & F.col("rule").isNull())
    return out.select("row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
