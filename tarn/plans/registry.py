"""The engine's queries over the driver tables, each with DuckDB SQL of the same rows."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import answers, asof, automaton, chat, content_chunks, gram_index, intervals, lattice, listing, quality, render, sketches, vectors
from tarn.operators.search import all_hits, chunks, search, search_many
from tarn.schemas import DEPARTMENTS, EMPTY_TEXTS, FALLBACK_SUMMARIES, FILES, GREETING, GUIDE_SOURCE, HEADERS, NO_SUMMARY, ORG, PRESETS, RESET_GREETING, ROUTES
from tarn.sources.catalog import ORD, Catalog, parquet, read_binary_base64, scratch_dir
from tarn.functions.text import tokens, tokens_col
from tarn.streaming import chat_state, sessions

QUERY = "thshed onering, ering? la thshed"
LANGS = (("en", "English"), ("de", "German"), ("fr", "French"), ("xx", "None"))
#: Questions written for this project, two or three for each route.
QUESTIONS = (
    (1, "대학원 지원에 필요한 서류는?"), (2, "How do I apply?"), (3, "어떤 연구 분야가 있나요?"), (4, "syllabus"), (5, "Which labs are available?"),
    (6, "교수님을 고르는 기준"), (7, "faculty list"), (8, "교과목 목록"), (9, "course catalogue"), (10, "설명회 일정"), (11, "Any notice?"), (12, "챗봇은 어떻게 작동하나요?"), (13, "NLP 연구를 하는 교수님"),
)
CORPUS_ROUTES = (("first", ("tion", "und")), ("second", ("que", "ción")), ("third", ("the", "der")))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as a chunk table: source is the title, lang the department."""
    return parquet(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("dept_name"), "text")


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "documents").select("doc_id", F.col("lang").alias("dept"), "text", F.col("source").alias("source_url"))


def _labels(spark: SparkSession) -> DataFrame:
    return listing.labels(spark, LANGS)


def _people(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), F.col("c_nationkey").alias("dept_name"))


def _courses(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "part").select("p_partkey", F.col("p_brand").alias("course_code"), F.col("p_name").alias("course_name"), F.col("p_type").alias("course_type"), F.col("p_size").alias("credit"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "events").select("event_id", F.lit("events").alias("dept_name"), F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"))


def _admissions(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "documents").select("doc_id", F.col("lang").alias("dept_name"), F.col("source").alias("title"), F.col("text").alias("content"))


def _flat(answer: DataFrame) -> DataFrame:
    """Sources as joined text, so that any engine can compare them."""
    cols = [F.array_join(F.col(f"sources.{n}"), "|").alias(f"{n}s") for n in ("title", "meta", "url")]
    return answer.select("answer", F.size("sources").cast("long").alias("n_sources"), *cols)


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "q_id long, question string")


def _history(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def _new_turns(spark: SparkSession, d: str) -> DataFrame:
    first = parquet(spark, d, "conversations").where("turn = 0").select("conv_id")
    return first.select("conv_id", F.explode(F.array(F.struct(F.lit("user").alias("role"), F.lit("question").alias("content"), F.lit(1).cast("long").alias("k")), F.struct(F.lit("assistant").alias("role"), F.lit("reply").alias("content"), F.lit(2).cast("long").alias("k")))).alias("x")).select("conv_id", "x.*")


def _routes_long(df: DataFrame, col: str, routes) -> DataFrame:
    return df.select(answers.route_col(F.col(col), routes).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def _csv_events(spark: SparkSession, d: str) -> DataFrame:
    """conversations written as CSV with quotes and line ends in fields, and read by the catalog."""
    base = scratch_dir(spark)
    out = parquet(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit('say "x",\n '), F.col("text")).alias("title"), F.when(F.col("role") == "user", "N/A").otherwise(F.col("role")).alias("event_type"))
    out.write.csv(f"{base}/{FILES['events']}", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return Catalog(spark, base).table("events").drop("_ord").withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})


def _binary(spark: SparkSession, d: str) -> DataFrame:
    """A file for each nation, read as base64."""
    base = scratch_dir(spark)
    parquet(spark, d, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(base)
    files = read_binary_base64(spark, f"{base}/*/*.txt")
    return files.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), "content_base64")


def _catalog(spark: SparkSession, d: str) -> Catalog:
    """Tables of the guide over driver tables; those without a file are empty."""
    return Catalog(spark, d, FILES | {"people": "customer.parquet", "courses": "part.parquet", "events": "events.parquet"})


def _dispatched(spark: SparkSession, d: str) -> DataFrame:
    """The preset questions, each answered from the table that its route names."""
    filled = {"admissions": (_admissions, "doc_id"), "people": (_people, "c_custkey"), "courses": (_courses, "p_partkey"), "events": (_events, "event_id"), "rag_chunks": (_docs, "doc_id")}
    tables = lambda name: filled[name][0](spark, d).withColumnRenamed(filled[name][1], ORD)
    found = [_flat(answers.answer(q.format(org=ORG), tables)).withColumn("preset", F.lit(i).cast("long")) for i, q in enumerate(PRESETS, 1)]
    return reduce(DataFrame.unionAll, found)


def _report(spark: SparkSession, d: str) -> DataFrame:
    docs = parquet(spark, d, "documents")
    return quality.report(
        {
            "rows": (docs.agg(F.count(F.lit(1)).alias("n")), "rows"), "duplicates": (quality.duplicate_count(docs, "text"), "exact duplicates"), "missing_source": (quality.missing(docs, ["source"]), "null or empty"),
            "lang": (quality.distribution_text(docs, "lang"), "distribution"), "rows_added": (quality.rows_added(docs, parquet(spark, d, "labels"), "doc_id"), "not labelled yet"),
        },
        "2026-01-02T03:04:05+00:00",
    )


def _with_rows(overview: DataFrame, table: DataFrame) -> DataFrame:
    """An overview with the number of rows of a table."""
    return overview.join(F.broadcast(table.agg(F.count(F.lit(1)).alias("n_rows"))), F.lit(True))  # one row


def _both_overviews(spark: SparkSession, d: str) -> DataFrame:
    """Overviews of a table with departments and of one without that column."""
    code = F.element_at(F.create_map(*[F.lit(x) for lang, (dept, _) in zip(("en", "de", "fr"), DEPARTMENTS, strict=False) for x in (lang, dept)]), F.col("lang"))
    assets = parquet(spark, d, "documents").select("doc_id", code.alias("dept"), "text", F.col("source").alias("source_url"))
    pages = parquet(spark, d, "pages").select("page_id", F.col("html").alias("text"), F.col("url").alias("source_url"))
    both = [_with_rows(listing.departments(spark, t, k), t).withColumn("from", F.lit(n)) for n, t, k in (("documents", assets, "doc_id"), ("pages", pages, "page_id"))]
    return both[0].unionByName(both[1])


def _with_turns(questions: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Questions with their route and the number of users' turns that take it."""
    asked = _routes_long(_history(spark, d).where("role = 'user'"), "content", ROUTES).withColumnRenamed("n", "n_turns")
    return questions.withColumn("route", answers.route_col(F.col("question"))).join(asked, "route", "left").withColumn("n_turns", F.coalesce("n_turns", F.lit(0)))


def _indexed(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """documents as chunks and the path of their index."""
    found, path = chunks(_docs(spark, d), "doc_id"), scratch_dir(spark)
    gram_index.build(found, path)
    return path, found


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Users' turns as a set of questions."""
    return _history(spark, d).where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), F.col("content").alias("question"))


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents each token of the users' turns is."""
    words = _asked(spark, d).select(F.explode(tokens_col(F.col("question"))).alias("w"))
    return automaton.counted(parquet(spark, d, "documents").select(F.lower(F.coalesce("text", F.lit(""))).alias("text")), words)


def _clicks(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last click until then."""
    events = parquet(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = asof.as_of(events.where("event_type = 'purchase'"), events.where("event_type = 'click'"), ["user_id"], "ts", "ts", tie="event_id")
    return out.select("event_id", "user_id", "right_event_id", "right_ts")


def _shipped(spark: SparkSession, d: str) -> DataFrame:
    """Each line with the last order before its shipping, of the customer with the supplier's number, within 20 days."""
    lines = parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"), "l_shipdate")
    orders = parquet(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey")
    out = asof.as_of(lines, orders, ["k"], "l_shipdate", "o_orderdate", tie="o_orderkey", strict=True, tolerance=20 * 86400)
    return out.groupBy("k").agg(F.count("*").alias("n"), F.count("right_o_orderkey").alias("n_found"), F.sum("right_o_orderkey").alias("sum_orders"))


def _open_orders(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a customer's orders that are open at one time, an order being open for 45 days."""
    orders = parquet(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.timestamp_add("DAY", F.lit(45), "o_orderdate").alias("until"))
    out = intervals.overlapping(orders, orders, ("o_orderdate", "until"), ("o_orderdate", "until"), ["o_custkey"], half_open=True)
    return out.where("left_o_orderkey < right_o_orderkey").select("left_o_custkey", "left_o_orderkey", "right_o_orderkey")


def _during(spark: SparkSession, d: str) -> DataFrame:
    """For each error, how many other events it lasts into; an event lasts ``value`` times a minute."""
    seconds = F.when(F.col("value") >= 0, F.floor(F.col("value") * 60)).otherwise(0)
    events = parquet(spark, d, "events").select("event_id", "event_type", "ts", F.timestamp_add("SECOND", seconds.cast("int"), "ts").alias("until"))
    out = intervals.summed(events.where("event_type = 'error'").drop("event_type"), events.where("event_type <> 'error'").drop("event_type"), ("ts", "until"), ("ts", "until"), "event_id")
    return out.groupBy("left_event_id").agg(F.sum("n").alias("n"), F.sum("total").alias("sum_events"))


def _sketched(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of each year's lines, stored year by year; a union of three years against exact counts."""
    lines = parquet(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate")
    path, year, columns = scratch_dir(spark), F.year("l_shipdate"), ["l_orderkey", "l_extendedprice"]
    for upto in (1996, 2100):  # the second time only later years are read into sketches
        sketches.store(lines.where(year <= upto), year, columns, path)
    told = sketches.merged(sketches.stored(spark, path).where("part IN ('1995', '1996', '1997')"))
    some = lines.where(year.isin(1995, 1996, 1997)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    exact = some.join(F.broadcast(told.select("column", F.col("q")[0].alias("median"))), "column").groupBy("column").agg(F.countDistinct("v").alias("n_exact"), F.avg((F.col("v") <= F.col("median")).cast("int")).alias("rank"))
    near = lambda a, b, by: F.abs(a - b) <= by
    return told.join(exact, "column").select("column", "n", "n_null", "n_exact", near(F.col("n_distinct"), F.col("n_exact"), F.col("n_exact") * sketches.distinct_bound()).alias("distinct_within"), near(F.col("rank"), F.lit(0.5), F.lit(2 * sketches.rank_bound())).alias("median_within"))


def _cubed(spark: SparkSession, d: str) -> DataFrame:
    lines = parquet(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), "l_quantity", "l_extendedprice")
    return lattice.cube(lines, ["l_returnflag", "l_linestatus", "year"], {"n": ("count", "l_quantity"), "sum_qty": ("sum", "l_quantity"), "min_price": ("min", "l_extendedprice"), "max_price": ("max", "l_extendedprice")})


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    """Each document put together again from its chunks."""
    whole = content_chunks.joined(content_chunks.chunks(parquet(spark, d, "documents")))
    return whole.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))


def _stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users' events, read as a stream; those that are final at its end."""
    base = scratch_dir(spark)
    feed = parquet(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value"))
    feed.write.parquet(f"{base}/feed")
    out = sessions.sessions(spark.readStream.schema(feed.schema).parquet(f"{base}/feed"), "user_id", "ts", "value", "30 minutes", "10 minutes")
    sessions.run(out, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{base}/out").select("user_id", "start", "end", "n", F.round("total", 2).alias("total"))


def _stream_chat(spark: SparkSession, d: str) -> DataFrame:
    """Conversations fed to the chat state in two runs, the second from the checkpoint of the first."""
    base = scratch_dir(spark)
    at = F.timestamp_seconds(1_704_067_200 + F.col("turn") * 60)
    feed = parquet(spark, d, "conversations").select("conv_id", at.alias("at"), "role", F.col("text").alias("content"), "turn")
    for part in (feed.where("turn < 3"), feed.where("turn >= 3")):
        part.drop("turn").write.mode("append").json(f"{base}/feed")
        turns = chat_state.turns(spark.readStream.schema(chat_state.MESSAGES).json(f"{base}/feed"), "1 day")
        sessions.run(turns, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(chat_state.TURNS).parquet(f"{base}/out")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    embeddings = parquet(spark, d, "embeddings")
    return vectors.nearest(embeddings, embeddings.where("vec_id % 50 = 0"), 10, 64).select("q", F.col("rk").cast("long").alias("rk"), "id")


QUERIES = {
    "sketch_years": _sketched,
    "cube_lineitem": _cubed,
    "content_chunks": _chunked,
    "stream_sessions": _stream_sessions,
    "stream_chat": _stream_chat,
    "vector_nearest": _nearest,
    "search_indexed": lambda s, d: gram_index.indexed_hits(s, _indexed(s, d)[0], QUERY),
    "search_indexed_topk": lambda s, d: gram_index.indexed_search(s, *_indexed(s, d), QUERY).select("ord", "score", "title", "dept_name", "text", "source_url"),
    "search_many_corpus": lambda s, d: search_many(_asked(s, d), chunks(_docs(s, d), "doc_id")).select("q_id", F.col("rk").cast("long").alias("rk"), "score", "ord"),
    "keyword_documents": _keywords,
    "route_many": lambda s, d: automaton.routed(_asked(s, d), ROUTES).groupBy("route").agg(F.count("*").alias("n")),
    "asof_last_click": _clicks,
    "asof_order_before_ship": _shipped,
    "interval_open_orders": _open_orders,
    "interval_during_errors": _during,
    "csv_scan": _csv_events,
    "tolerant_scan": lambda s, d: listing.table_counts({n: _catalog(s, d).table(n) for n in FILES}),
    "catalog_counts": lambda s, d: listing.table_counts({n: _catalog(s, d).table(n) for n in ("people", "courses", "events", "admissions")}),
    "binary_base64": _binary,
    "departments_fixed": lambda s, d: _with_rows(listing.departments(s, parquet(s, d, "region"), "r_regionkey"), parquet(s, d, "region")),
    "departments_empty": lambda s, d: _with_rows(listing.departments(s, _assets(s, d).where("dept = 'no such'"), "doc_id"), _assets(s, d)),
    "departments_both": lambda s, d: _both_overviews(s, d),
    "departments_without_rows": lambda s, d: listing.departments(s, _assets(s, d), "doc_id"),
    "chat_seed": lambda s, d: chat.seeded(_history(s, d)).select("conv_id", "turn", "role", "content"),
    "chat_reset": lambda s, d: chat.seeded(_history(s, d).where("role = 'user' AND turn >= 4"), reset=True).select("conv_id", "turn", "role", "content"),
    "chat_add_question": lambda s, d: chat.append(_history(s, d).where("conv_id = 1").withColumn("sources", F.lit(None).cast("array<struct<title:string,meta:string,url:string>>")), 1, "zzzzqq", answers.search_answer(_docs(s, d), "zzzzqq", "default", ord_col="doc_id")).select("conv_id", "turn", "role", "content", F.coalesce(F.size("sources"), F.lit(-1)).cast("long").alias("n_sources")),
    "presets": lambda s, d: _with_turns(chat.presets(s), s, d),
    "answer_presets": _dispatched,
    "info_cards": lambda s, d: parquet(s, d, "nation").select("n_nationkey", render.info_card(F.concat(F.lit("<"), F.col("n_name")), F.lit("a & 'b'")).alias("card")),
    "quality_report": _report,
    "distribution_parsed": lambda s, d: quality.distribution_text(parquet(s, d, "documents"), "lang").select(F.explode(quality.parse_distribution(F.col("distribution"))).alias("value", "n")),
    "search_topk": lambda s, d: search(chunks(_docs(s, d), "doc_id"), QUERY, 3).select("ord", "score", "title", "dept_name", "text", "source_url"),
    "search_all_hits": lambda s, d: all_hits(chunks(_docs(s, d), "doc_id"), QUERY).select("ord", "score", "title"),
    "search_many": lambda s, d: search_many(s.createDataFrame([(1, "thshed onering"), (2, "la? ering la"), (3, "zzzzzz")], "q_id long, question string"), chunks(_docs(s, d), "doc_id")).select("q_id", F.col("rk").cast("long").alias("rk"), "score", "ord"),
    "list_people": lambda s, d: listing.representative_people(_people(s, d), 9, "c_custkey"),
    "list_courses": lambda s, d: listing.representative_courses(_courses(s, d), 10, "p_partkey"),
    "list_available_columns": lambda s, d: listing.representative(parquet(s, d, "supplier"), ("s_name", "missing_column", "s_suppkey"), 6, "s_suppkey"),
    "table_counts": lambda s, d: listing.table_counts({n: parquet(s, d, n) for n in ("documents", "customer", "part", "events", "conversations", "pages")}),
    "group_overview": lambda s, d: listing.group_overview(_labels(s), _assets(s, d), "none", "doc_id").select("label_ord", "dept", "dept_name", "summary", "source_url"),
    "group_top3_text": lambda s, d: listing.first_texts(_assets(s, d), ord_col="doc_id"),
    "group_first_url": lambda s, d: listing.first_urls(_assets(s, d), "doc_id"),
    "route_fixture": lambda s, d: _with_turns(_questions(s), s, d).drop("question"),
    "route_conversations": lambda s, d: _routes_long(parquet(s, d, "conversations").where("role = 'user'"), "text", ROUTES),
    "route_corpus": lambda s, d: _routes_long(parquet(s, d, "documents"), "text", CORPUS_ROUTES),
    "answer_admission": lambda s, d: _flat(answers.table_answer(_admissions(s, d), "admission", ord_col="doc_id")),
    "answer_research": lambda s, d: _flat(answers.research_answer(_docs(s, d), ord_col="doc_id")),
    "answer_faculty": lambda s, d: _flat(answers.table_answer(_people(s, d), "faculty", ord_col="c_custkey")),
    "answer_course": lambda s, d: _flat(answers.table_answer(_courses(s, d), "course", ord_col="p_partkey")),
    "answer_event": lambda s, d: _flat(answers.table_answer(_events(s, d), "event", ord_col="event_id")),
    "answer_default": lambda s, d: _flat(answers.search_answer(_docs(s, d), QUERY, "default", ord_col="doc_id")),
    "answer_no_hits": lambda s, d: _flat(answers.search_answer(_docs(s, d), "zzzzqq", "default", ord_col="doc_id")),
    "sources_from_rows": lambda s, d: listing.head(_people(s, d), 3, "c_custkey").select("c_custkey", answers.row_sources(_people(s, d), "Faculty", "Faculty").alias("x")).select("c_custkey", "x.*"),
    "sources_from_hits": lambda s, d: search(chunks(_docs(s, d), "doc_id"), QUERY, 3).select("ord", answers.hit_source("Retrieved Document").alias("x")).select("ord", "x.*"),
    "chat_replay": lambda s, d: chat.replay(_history(s, d)),
    "chat_append": lambda s, d: chat.append_turns(_history(s, d), _new_turns(s, d)),
    "source_cards": lambda s, d: parquet(s, d, "pages").select("page_id", render.source_card(F.lit("a<b"), F.lit("m & n"), F.col("url")).alias("card"), render.card_column(F.col("page_id")).cast("long").alias("card_column")),
    "dup_text_count": lambda s, d: quality.duplicate_count(parquet(s, d, "documents"), "text"),
    "missing_counts": lambda s, d: quality.missing(parquet(s, d, "pages"), ("url", "html")),
    "type_distribution": lambda s, d: quality.distribution_text(parquet(s, d, "documents"), "lang"),
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DOCS = r"(SELECT doc_id AS ord, source AS title, lang AS dept_name, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, '' AS source_url FROM documents)"


def _score(words) -> str:
    return "(" + " + ".join([f"CAST(contains(lower(title || ' ' || text), {_q(w)}) AS INT)" for w in words] or ["0"]) + ")"


def _found(query: str, limit: int | None = 3) -> str:
    return f"(SELECT * FROM (SELECT *, CAST({_score(tokens(query))} AS INT) AS score FROM {_DOCS}) WHERE score > 0" + (f" ORDER BY score DESC, ord LIMIT {limit})" if limit else ")")


def _case(col: str, routes) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({col}), {_q(w)})' for w in ws)} THEN {_q(n)}" for n, ws in routes) + " ELSE 'default' END"


def _answer(rows: str, header: str, order: str = "ord") -> str:
    """rows: (ord, line, title, meta, url)."""
    three = lambda c: f"array_to_string(list_slice(list({c} ORDER BY {order}), 1, 3), '|')"
    return f"SELECT {_q(header)} || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY {order}) AS answer, CAST(least(count(*), 3) AS BIGINT) AS n_sources, {three('title')} AS titles, {three('meta')} AS metas, {three('url')} AS urls FROM ({rows})"


def _hits_answer(query: str, kind: str, fallback: str) -> str:
    return _answer(f"SELECT -score AS s, ord, '- ' || dept_name || ': ' || substring(text, 1, 220) AS line, CASE WHEN title = '' THEN {_q(fallback)} ELSE title END AS title, dept_name || ' · RAG Chunk' AS meta, source_url AS url FROM {_found(query)}", HEADERS[kind], "s, ord")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TEXTS = "(SELECT lang AS dept, substring(string_agg(text, ' ' ORDER BY doc_id), 1, 500) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn <= 3 GROUP BY lang)"
_URLS = "(SELECT lang AS dept, trim(arg_min(source, doc_id)) AS source_url FROM documents WHERE source IS NOT NULL GROUP BY lang)"
_MANY = " UNION ALL ".join(f"(SELECT CAST({i} AS BIGINT) AS q_id, row_number() OVER (ORDER BY score DESC, ord) AS rk, score, ord FROM {_found(q)})" for i, q in ((1, "thshed onering"), (2, "la? ering la"), (3, "zzzzzz")))
_GUIDE = [x.format(org=ORG) for x in GUIDE_SOURCE]

_FIXED = f"(VALUES {_values([(i, c, n, FALLBACK_SUMMARIES[c]) for i, (c, n) in enumerate(DEPARTMENTS)])}) v(label_ord, dept, dept_name, summary)"
_PRESETS = f"(VALUES {_values([(i, q.format(org=ORG)) for i, q in enumerate(PRESETS, 1)])}) v(preset, question)"
_DISTRIBUTION = "(SELECT string_agg(v || ': ' || n, ', ' ORDER BY n DESC, v) AS distribution FROM (SELECT lang AS v, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1))"


def _greeted(text: str, where: str) -> str:
    return f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS turn, 'assistant' AS role, {_q(text)} AS content FROM conversations {where}"


def _turns(rows: str, cols: str) -> str:
    """rows: (question, ...) with the number of users' turns on the same route."""
    return f"SELECT {cols}, q.route, coalesce(t.n, 0) AS n_turns FROM (SELECT *, {_case('question', ROUTES)} AS route FROM {rows}) q LEFT JOIN (SELECT {_case('text', ROUTES)} AS route, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1) t ON t.route = q.route"


#: Driver tables that stand for tables of the guide.
_FILLED = {"people": "customer", "courses": "part", "events": "events"}
_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x1c-\x1f?,]+'), lambda w: length(w) >= 2)"
_WORDS = f"(SELECT q_id, w, count(*) AS n FROM (SELECT conv_id * 1000 + turn AS q_id, unnest({_TOKENS}) AS w FROM conversations WHERE role = 'user') GROUP BY q_id, w)"
_DEFAULT_PRESET = PRESETS[-1].format(org=ORG)


ORACLE = {
    "csv_scan": "SELECT conv_id, turn, 'say \"x\",' || chr(10) || ' ' || text AS title, CASE WHEN role = 'user' THEN NULL ELSE role END AS event_type FROM conversations",
    "tolerant_scan": " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) AS value FROM {_FILLED[n]}" if n in _FILLED else f"SELECT '{n}' AS metric, CAST(0 AS BIGINT) AS value" for n in FILES),
    "catalog_counts": "SELECT 'people' AS metric, count(*) AS value FROM customer UNION ALL SELECT 'courses', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'admissions', 0",
    "binary_base64": "SELECT n_nationkey, to_base64(encode(n_name || chr(10))) AS content_base64 FROM nation",
    "departments_fixed": f"SELECT CAST(label_ord AS INT) AS label_ord, dept, dept_name, summary, '' AS source_url, (SELECT count(*) FROM region) AS n_rows FROM {_FIXED}",
    "departments_empty": f"SELECT CAST(label_ord AS INT) AS label_ord, dept, dept_name, summary, '' AS source_url, (SELECT count(*) FROM documents) AS n_rows FROM {_FIXED}",
    "departments_both": f"""SELECT CAST(label_ord AS INT) AS label_ord, f.dept, dept_name, coalesce(t.summary, {_q(NO_SUMMARY)}) AS summary, coalesce(u.source_url, '') AS source_url, (SELECT count(*) FROM documents) AS n_rows, 'documents' AS "from"
 FROM {_FIXED.replace(") v(", ") f(")} LEFT JOIN (VALUES ('en', 0), ('de', 1), ('fr', 2)) m(lang, i) ON m.i = f.label_ord LEFT JOIN {_TEXTS} t ON t.dept = m.lang LEFT JOIN {_URLS} u ON u.dept = m.lang
 UNION ALL SELECT CAST(label_ord AS INT), dept, dept_name, summary, '', (SELECT count(*) FROM pages), 'pages' FROM {_FIXED}""",
    "departments_without_rows": f"SELECT CAST(label_ord AS INT) AS label_ord, dept, dept_name, {_q(NO_SUMMARY)} AS summary, '' AS source_url FROM {_FIXED}",
    "chat_seed": _greeted(GREETING.format(org=ORG), ""),
    "chat_reset": _greeted(RESET_GREETING, "WHERE role = 'user' AND turn >= 4"),
    "chat_add_question": f"WITH h AS (SELECT * FROM conversations WHERE conv_id = 1), t AS (SELECT coalesce(max(turn), -1) AS t FROM h) SELECT conv_id, turn, role, text AS content, CAST(-1 AS BIGINT) AS n_sources FROM h UNION ALL SELECT 1, t + 1, 'user', 'zzzzqq', 0 FROM t UNION ALL SELECT 1, t + 2, 'assistant', {_q(EMPTY_TEXTS['default'])}, 1 FROM t",
    "presets": _turns(_PRESETS, "CAST(preset AS BIGINT) AS preset, question"),
    "info_cards": """SELECT n_nationkey, '<div class="card"><h4>&lt;' || n_name || '</h4><p>a &amp; &#x27;b&#x27;</p></div>' AS card FROM nation""",
    "quality_report": f"""SELECT 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value, 'rows' AS note FROM documents UNION ALL SELECT 'duplicates', CAST(count(text) - count(DISTINCT text) AS VARCHAR), 'exact duplicates' FROM documents
 UNION ALL SELECT 'missing_source', CAST(count(*) FILTER (WHERE source IS NULL OR source = '') AS VARCHAR), 'null or empty' FROM documents UNION ALL SELECT 'lang', distribution, 'distribution' FROM {_DISTRIBUTION}
 UNION ALL SELECT 'rows_added', CAST(count(*) AS VARCHAR), 'not labelled yet' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'checked_at', '2026-01-02T03:04:05+00:00', 'stamp'""",
    "distribution_parsed": "SELECT lang AS value, CAST(count(*) AS VARCHAR) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "search_topk": f"SELECT ord, score, title, dept_name, text, source_url FROM {_found(QUERY)}",
    "search_all_hits": f"SELECT ord, score, title FROM {_found(QUERY, None)}",
    "search_many": _MANY,
    "list_people": "SELECT CAST(c_nationkey AS VARCHAR) AS dept_name, c_name AS name, c_mktsegment AS role FROM customer ORDER BY c_custkey LIMIT 9",
    "list_courses": "SELECT p_brand AS course_code, p_name AS course_name, p_type AS course_type, CAST(p_size AS VARCHAR) AS credit FROM part ORDER BY p_partkey LIMIT 10",
    "list_available_columns": "SELECT s_name, CAST(s_suppkey AS VARCHAR) AS s_suppkey FROM supplier ORDER BY supplier.s_suppkey LIMIT 6",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS metric, count(*) AS value FROM {n}" for n in ("documents", "customer", "part", "events", "conversations", "pages")),
    "group_overview": f"SELECT CAST(label_ord AS INT) AS label_ord, l.dept, l.dept_name, coalesce(summary, 'none') AS summary, coalesce(source_url, '') AS source_url FROM (VALUES {_values([(i, *x) for i, x in enumerate(LANGS)])}) l(label_ord, dept, dept_name) LEFT JOIN {_TEXTS} t ON l.dept = t.dept LEFT JOIN {_URLS} u ON l.dept = u.dept",
    "group_top3_text": f"SELECT * FROM {_TEXTS}",
    "group_first_url": f"SELECT * FROM {_URLS}",
    "route_fixture": _turns(f"(VALUES {_values(QUESTIONS)}) v(q_id, question)", "CAST(q_id AS BIGINT) AS q_id"),
    "route_conversations": f"SELECT {_case('text', ROUTES)} AS route, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
    "route_corpus": f"SELECT {_case('text', CORPUS_ROUTES)} AS route, count(*) AS n FROM documents GROUP BY 1",
    "answer_admission": _answer("SELECT ord, '- ' || dept_name || ': ' || title || ' — ' || substring(text, 1, 160) AS line, title, dept_name || ' · Admission' AS meta, '' AS url FROM (SELECT * FROM " + _DOCS + " ORDER BY ord LIMIT 5)", HEADERS["admission"].format(org=ORG)),
    "answer_research": f"SELECT {_q(EMPTY_TEXTS['research'].format(org=ORG))} AS answer, CAST(0 AS BIGINT) AS n_sources, '' AS titles, '' AS metas, '' AS urls WHERE NOT EXISTS (SELECT 1 FROM {_found('연구 분야 research lab faculty')}) UNION ALL SELECT * FROM ({_hits_answer('연구 분야 research lab faculty', 'research', 'Research Information')}) WHERE n_sources > 0",
    "answer_faculty": _answer("SELECT c_custkey AS ord, '- ' || c_name || ' / ' || c_nationkey || ': ' || c_mktsegment AS line, c_name AS title, c_nationkey || ' · Faculty' AS meta, '' AS url FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 6)", HEADERS["faculty"]),
    "answer_course": _answer("SELECT p_partkey AS ord, '- : ' || p_brand || ' ' || p_name || ' ()' AS line, p_name AS title, 'Course' AS meta, '' AS url FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 6)", HEADERS["course"]),
    "answer_event": _answer("SELECT event_id AS ord, '- events: ' || event_type || ' (' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ')' AS line, event_type AS title, 'events · Event' AS meta, '' AS url FROM (SELECT * FROM events ORDER BY event_id LIMIT 4)", HEADERS["event"]),
    "answer_default": _hits_answer(QUERY, "default", "Retrieved Document"),
    "answer_no_hits": f"SELECT {_q(EMPTY_TEXTS['default'])} AS answer, CAST(1 AS BIGINT) AS n_sources, {_q(_GUIDE[0])} AS titles, {_q(_GUIDE[1])} AS metas, '' AS urls",
    "sources_from_rows": "SELECT c_custkey, c_name AS title, c_nationkey || ' · Faculty' AS meta, '' AS url FROM customer ORDER BY c_custkey LIMIT 3",
    "sources_from_hits": f"SELECT ord, title, dept_name || ' · RAG Chunk' AS meta, source_url AS url FROM {_found(QUERY)}",
    "chat_replay": "SELECT conv_id, turn, role, text AS content FROM conversations ORDER BY conv_id, turn",
    "chat_append": "WITH t AS (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY conv_id), f AS (SELECT conv_id FROM conversations WHERE turn = 0) SELECT conv_id, turn, role, text AS content FROM conversations UNION ALL SELECT f.conv_id, t.t + 1, 'user', 'question' FROM f JOIN t USING (conv_id) UNION ALL SELECT f.conv_id, t.t + 2, 'assistant', 'reply' FROM f JOIN t USING (conv_id)",
    "source_cards": """SELECT page_id, '<div class="source"><b>a&lt;b</b><span>m &amp; n</span><a href="' || u || '">' || u || '</a></div>' AS card, page_id % 3 AS card_column FROM (SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS u FROM pages)""",
    "dup_text_count": "SELECT CAST(count(text) - count(DISTINCT text) AS BIGINT) AS duplicates FROM documents",
    "missing_counts": "SELECT count(*) FILTER (WHERE url IS NULL OR url = '') AS missing_url, count(*) FILTER (WHERE html IS NULL OR html = '') AS missing_html FROM pages",
    "type_distribution": "SELECT string_agg(v || ': ' || n, ', ' ORDER BY n DESC, v) AS distribution FROM (SELECT lang AS v, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1)",
}


_EMPTY_DEFAULT = f"SELECT {_q(EMPTY_TEXTS['default'])} AS answer, CAST(1 AS BIGINT) AS n_sources, {_q(_GUIDE[0])} AS titles, {_q(_GUIDE[1])} AS metas, '' AS urls WHERE NOT EXISTS (SELECT 1 FROM {_found(_DEFAULT_PRESET)})"
_PRESET_ANSWERS = [*[ORACLE[f"answer_{k}"] for k in ("admission", "research", "faculty", "course", "event")], f"{_EMPTY_DEFAULT} UNION ALL SELECT * FROM ({_hits_answer(_DEFAULT_PRESET, 'default', 'Retrieved Document')}) WHERE n_sources > 0"]
ORACLE |= {
    "answer_presets": " UNION ALL ".join(f"(SELECT CAST({i} AS BIGINT) AS preset, * FROM ({x}))" for i, x in enumerate(_PRESET_ANSWERS, 1)),
    "search_indexed": f"SELECT ord, score FROM {_found(QUERY, None)}",
    "search_indexed_topk": ORACLE["search_topk"],
    "search_many_corpus": f"SELECT q_id, rk, score, ord FROM (SELECT q_id, ord, CAST(sum(n) AS INT) AS score, row_number() OVER (PARTITION BY q_id ORDER BY sum(n) DESC, ord) AS rk FROM (SELECT DISTINCT w FROM {_WORDS}) t JOIN (SELECT ord, lower(title || ' ' || text) AS t FROM {_DOCS}) d ON contains(d.t, t.w) JOIN {_WORDS} q ON q.w = t.w GROUP BY q_id, ord) WHERE rk <= 3",
    "keyword_documents": f"SELECT w, count(*) AS n FROM (SELECT DISTINCT w FROM {_WORDS}) t JOIN (SELECT lower(text) AS t FROM documents) d ON contains(d.t, t.w) GROUP BY w",
    "route_many": ORACLE["route_conversations"],
    "asof_last_click": """SELECT p.event_id, p.user_id, c.event_id AS right_event_id, c.ts AS right_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
 ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) c ON p.user_id = c.user_id AND p.ts >= c.ts""",
    "asof_order_before_ship": """SELECT k, count(*) AS n, count(o) AS n_found, CAST(sum(o) AS BIGINT) AS sum_orders FROM (SELECT l.l_suppkey AS k, CASE WHEN l.l_shipdate - c.t <= INTERVAL 20 DAY THEN c.o END AS o FROM lineitem l
 ASOF LEFT JOIN (SELECT o_custkey, o_orderdate AS t, max(o_orderkey) AS o FROM orders GROUP BY ALL) c ON l.l_suppkey = c.o_custkey AND l.l_shipdate > c.t) GROUP BY k""",
    "interval_open_orders": """SELECT a.o_custkey AS left_o_custkey, a.o_orderkey AS left_o_orderkey, b.o_orderkey AS right_o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
 AND a.o_orderdate < b.o_orderdate + INTERVAL 45 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 45 DAY""",
    "interval_during_errors": """WITH e AS (SELECT event_id, event_type, ts, ts + to_seconds(CASE WHEN value >= 0 THEN CAST(floor(value * 60) AS INT) ELSE 0 END) AS until FROM events)
SELECT a.event_id AS left_event_id, count(*) AS n, CAST(sum(b.event_id) AS BIGINT) AS sum_events FROM e a JOIN e b ON a.event_type = 'error' AND b.event_type <> 'error' AND a.ts <= b.until AND b.ts <= a.until GROUP BY 1""",
    "sketch_years": """SELECT 'l_orderkey' AS "column", count(*) AS n, CAST(0 AS BIGINT) AS n_null, count(DISTINCT l_orderkey) AS n_exact, TRUE AS distinct_within, TRUE AS median_within FROM lineitem WHERE year(l_shipdate) IN (1995, 1996, 1997)
 UNION ALL SELECT 'l_extendedprice', count(*), 0, count(DISTINCT l_extendedprice), TRUE, TRUE FROM lineitem WHERE year(l_shipdate) IN (1995, 1996, 1997)""",
    "cube_lineitem": """SELECT l_returnflag, l_linestatus, CAST(year AS INT) AS year, CAST(grouping(l_returnflag, l_linestatus, year) AS BIGINT) AS grouping_id, count(l_quantity) AS n, sum(l_quantity) AS sum_qty, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price
 FROM (SELECT *, year(l_shipdate) AS year FROM lineitem) GROUP BY CUBE (l_returnflag, l_linestatus, year)""",
    "content_chunks": "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM documents WHERE text <> ''",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)""",
    "stream_chat": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text AS content FROM conversations",
    "vector_nearest": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
SELECT a.vec_id AS q, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rk, b.vec_id AS id FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY rk <= 10""",
}
