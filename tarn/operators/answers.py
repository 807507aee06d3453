"""Router, templated answers and their sources. Every answer is one lazy row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import contains_any, first_existing, safe_text, value_or
from tarn.operators.listing import head
from tarn.operators.search import chunks, search
from tarn.schemas import EMPTY_TEXTS, GUIDE_SOURCE, HEADERS, ORG, RESEARCH_QUERY, ROUTES, SOURCE
from tarn.sources.catalog import ORD

SHOWN = {"admission": 5, "faculty": 6, "course": 6, "event": 4}
META = {"admission": "Admission", "faculty": "Faculty", "course": "Course", "event": "Event"}


def route_col(question: Column, routes=ROUTES) -> Column:
    """The first route with a keyword in the lower-cased question, else default."""
    q, out = F.lower(F.coalesce(question, F.lit(""))), None
    for name, words in routes:
        out = F.when(contains_any(q, words), name) if out is None else out.when(contains_any(q, words), name)
    return out.otherwise("default")


def route(question: str, routes=ROUTES) -> str:
    q = question.lower()
    return next((name for name, words in routes if any(w in q for w in words)), "default")


def row_sources(df: DataFrame, fallback: str, meta: str) -> Column:
    """struct(title, meta, url) of a row: title by schema then by value, department before the meta unless empty."""
    title = safe_text(first_existing(df, ("title", "course_name", "name"), fallback))
    dept = safe_text(first_existing(df, ("dept_name", "dept")))
    url = safe_text(first_existing(df, ("source_url", "homepage")))
    return F.struct(
        value_or(title, F.lit(fallback)).alias("title"),
        F.when(dept != "", F.concat(dept, F.lit(f" · {meta}"))).otherwise(F.lit(meta)).alias("meta"),
        url.alias("url"),
    )


def hit_source(fallback: str) -> Column:
    return F.struct(value_or(F.col("title"), F.lit(fallback)).alias("title"), F.concat(F.col("dept_name"), F.lit(" · RAG Chunk")).alias("meta"), F.col("source_url").alias("url"))


def assemble(lines: DataFrame, header: str, empty: str, empty_sources: Column | None = None) -> DataFrame:
    """One row (answer, sources) from at most a handful of (ord, line, src); at most three sources."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "line", "src")))
    got = lines.agg(rows.alias("r"))
    none = F.size("r") == 0
    text = F.concat(F.lit(header + "\n\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"))
    src = F.slice(F.transform("r", lambda x: x["src"]), 1, 3)
    no_src = (F.array() if empty_sources is None else empty_sources).cast(f"array<{SOURCE.simpleString()}>")
    return got.select(F.when(none, empty).otherwise(text).alias("answer"), F.when(none, no_src).otherwise(src).alias("sources"))


def _line(df: DataFrame, kind: str) -> Column:
    def t(*chain, default=""):
        return safe_text(first_existing(df, chain, default))

    dash = F.lit("- ")
    if kind == "admission":
        return F.concat(dash, t("dept_name"), F.lit(": "), t("title", "section_title", default="Admission"), F.lit(" — "), F.substring(t("content", "text"), 1, 160))
    if kind == "faculty":
        return F.concat(dash, t("name"), F.lit(" / "), t("dept_name"), F.lit(": "), value_or(t("research_area"), t("role")))
    if kind == "course":
        return F.concat(dash, t("dept_name"), F.lit(": "), t("course_code"), F.lit(" "), t("course_name"), F.lit(" ("), t("course_level"), F.lit(")"))
    return F.concat(dash, t("dept_name"), F.lit(": "), t("title"), F.lit(" ("), t("event_date", "date"), F.lit(")"))


def table_answer(df: DataFrame, kind: str, org: str = ORG, ord_col: str = ORD) -> DataFrame:
    """Admission, faculty, course or event answer from the first rows of their table."""
    rows = head(df, SHOWN[kind], ord_col)
    lines = rows.select(F.col(ord_col).alias("ord"), _line(df, kind).alias("line"), row_sources(df, META[kind], META[kind]).alias("src"))
    return assemble(lines, HEADERS[kind].format(org=org), EMPTY_TEXTS[kind].format(org=org))


def search_answer(chunk_table: DataFrame, query: str, kind: str, org: str = ORG, ord_col: str = ORD) -> DataFrame:
    """Answer from the three best chunks, best first."""
    found = search(chunks(chunk_table, ord_col), query, 3)
    order = F.struct(-F.col("score"), F.col("ord"))
    line = F.concat(F.lit("- "), F.col("dept_name"), F.lit(": "), F.substring("text", 1, 220))
    src = hit_source("Research Information" if kind == "research" else "Retrieved Document")
    guide = F.array(F.struct(*[F.lit(x.format(org=org)).alias(n) for n, x in zip(("title", "meta", "url"), GUIDE_SOURCE, strict=True)]))
    return assemble(found.select(order.alias("ord"), line.alias("line"), src.alias("src")), HEADERS[kind], EMPTY_TEXTS[kind].format(org=org), guide if kind == "default" else None)


def research_answer(chunk_table: DataFrame, org: str = ORG, query: str = RESEARCH_QUERY, ord_col: str = ORD) -> DataFrame:
    return search_answer(chunk_table, query, "research", org, ord_col)


def answer(question: str, tables, org: str = ORG) -> DataFrame:
    """Route the question and answer it; ``tables`` gives a frame by name."""
    kind = route(question)
    if kind == "research":
        return research_answer(tables("rag_chunks"), org)
    if kind == "default":
        return search_answer(tables("rag_chunks"), question, "default", org)
    return table_answer(tables({"admission": "admissions", "faculty": "people", "course": "courses", "event": "events"}[kind]), kind, org)
