"""Declared schemas, labels, keyword lists and message templates."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# Tables and their columns.
#: All CSV columns stay strings: dates and numbers are shown as they were written.
TABLES: dict[str, T.StructType] = {
    "admissions": _strings("dept_name", "title", "section_title", "content", "text", "source_url"),
    "courses": _strings("dept_name", "course_level", "course_code", "course_name", "course_type", "credit", "source_url"),
    "people": _strings("dept_name", "name", "role", "research_area", "homepage", "source_url"),
    "events": _strings("record_id", "dept_name", "dept", "event_type", "page_title", "title", "content", "event_date", "source_url", "crawled_at", "missing_fields"),
    "assets": _strings("dept", "text", "source_url"),
    "rag_chunks": _strings("chunk_text", "text", "title", "document_title", "dept_name", "dept", "source_url"),
    "rag_documents": _strings("document_title", "source_url"),
    "course_track_map": _strings("course_code", "track"),
    "quality_report": _strings("metric", "value", "note"),
}

# Fixed values.
#: File of each table, relative to the base folder.
FILES = {
    "admissions": "admissions_clean.csv",
    "courses": "courses_clean.csv",
    "people": "people_clean.csv",
    "events": "events_clean.csv",
    "assets": "assets_clean.csv",
    "rag_chunks": "rag_chunks.csv",
    "rag_documents": "rag_documents.csv",
    "course_track_map": "course_track_map.csv",
    "quality_report": "quality_report.csv",
}

# Fixed values.
#: Tables of the overview, in its order.
COUNTED = ("admissions", "courses", "people", "events", "rag_chunks", "rag_documents")

# The texts that CSV loading reads as null.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Department codes and labels, in display order.
DEPARTMENTS = (
    ("aic", "AI컴퓨팅학과"),
    ("ai_systems", "AI시스템학과"),
    ("ai_future", "AI미래학과"),
    ("ax", "AX학과"),
)

# Summaries shown when there are no assets at all.
FALLBACK_SUMMARIES = {
    "aic": "AI 알고리즘, 컴퓨팅 기반 기술, 데이터 처리 역량을 중심으로 한 학과 소개 영역입니다.",
    "ai_systems": "AI 시스템, 지능형 소프트웨어, 플랫폼과 응용 시스템을 중심으로 한 학과 소개 영역입니다.",
    "ai_future": "미래 사회 문제와 AI 융합 연구를 연결하는 학과 소개 영역입니다.",
    "ax": "AI 전환과 산업·사회 적용을 중심으로 한 융합 학과 소개 영역입니다.",
}
# Fixed value: summary of a department that has no text.
NO_SUMMARY = "소개 데이터가 준비 중입니다."

# Router keywords; the first route with a hit wins.
ROUTES = (
    ("admission", ("입학", "지원", "서류", "모집", "영어", "admission", "apply")),
    ("research", ("연구", "분야", "랩", "연구실", "research", "lab")),
    ("faculty", ("교수", "교수진", "지도교수", "faculty", "professor")),
    ("course", ("교과", "수업", "과목", "course", "curriculum")),
    ("event", ("행사", "설명회", "이벤트", "공지", "event", "notice")),
)

# Fixed value: the query behind every research answer.
RESEARCH_QUERY = "연구 분야 research lab faculty"

# Answer headers and texts without data. {org} is the institution, a parameter.
HEADERS = {
    "admission": "{org} 입학 정보에서 확인할 수 있는 주요 항목입니다.",
    "research": "관련 문서에서 검색된 연구 분야 정보입니다.",
    "faculty": "교수진 탐색은 연구 키워드와 학과 적합성을 중심으로 볼 수 있습니다.",
    "course": "데모 데이터에서 확인되는 교과목 예시는 다음과 같습니다.",
    "event": "설명회나 공지성 정보는 다음과 같이 확인할 수 있습니다.",
    "default": "질문과 관련된 문서 조각을 검색했습니다.",
}
EMPTY_TEXTS = {
    "admission": "입학 데이터가 아직 준비되지 않았습니다. data/raw/admissions_clean.csv 파일을 추가하면 이 영역이 자동으로 채워집니다.",
    "research": "{org}는 Machine Learning, Deep Learning, NLP, Computer Vision, Robotics, Human-Centered AI, Trustworthy AI 등 다양한 AI 연구 분야를 탐색할 수 있도록 구성됩니다.",
    "faculty": "교수진 데이터가 아직 준비되지 않았습니다. data/raw/people_clean.csv 파일을 추가하면 이 영역이 자동으로 채워집니다.",
    "course": "교과목 데이터가 아직 준비되지 않았습니다. data/raw/courses_clean.csv 파일을 추가하면 이 영역이 자동으로 채워집니다.",
    "event": "행사 및 공지 데이터가 아직 준비되지 않았습니다. data/raw/events_clean.csv 파일을 추가하면 이 영역이 자동으로 채워집니다.",
    "default": "입학, 연구 분야, 교수진, 교과목, 행사 정보를 중심으로 질문해보세요. 예: ‘입학 서류가 궁금해요’, ‘연구 분야 알려줘’, ‘교수진 정보 알려줘’. ",
}
GUIDE_SOURCE = ("{org} Demo Knowledge Base", "Demo · Local CSV Data", "")
# The greetings and the preset questions. {org} is the institution.
GREETING = "안녕하세요. {org} RAG Guide입니다. 입학, 연구 분야, 교수진, 교과목, 행사 정보에 대해 질문해보세요."
RESET_GREETING = "대화가 초기화되었습니다. 다시 질문해보세요."
PRESETS = (
    "{org} 지원 시 어떤 서류가 필요한가요?",
    "{org}에는 어떤 연구 분야가 있나요?",
    "관심 교수님을 고를 때 어떤 기준으로 보면 좋나요?",
    "{org} 교과목에는 어떤 것들이 있나요?",
    "{org} 관련 설명회나 행사가 있나요?",
    "이 RAG 챗봇 서비스는 어떤 방식으로 작동하나요?",
)

#: Institution named in the texts unless the caller gives another.
ORG = "AI College"

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "meta", "url")])
MESSAGE = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("sources", T.ArrayType(SOURCE)),
    ]
)
