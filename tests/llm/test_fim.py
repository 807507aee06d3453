"""Fill-in-middle against a brute force over regular expressions, whole and in tiny chunks."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import fim


def brute(i, text):
    t = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not t or any(x in t for x in fim.MARKERS) or h[2] % 100 >= 90:
        return (i, len(w), "plain", None, None, t)
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h[3] % 100 < 20 else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return (i, len(w), form, len(p), len(m), out)


def rows():
    r = random.Random(3)
    odd = ["", "a", None, "<P>", "<P", "x<S>y", "<<M>", "é<M>", "ab cd", "\n\n", "a" * 50, "é" * 40, "日本 abc " * 9, "<P" * 20, "<P" * 20 + ">"]
    texts = odd + ["".join(r.choice("abPSM<>é日 \n1\U0001f600") for _ in range(r.randint(0, 60))) for _ in range(300)]
    return [(i if i % 17 else None, t, i, "x") for i, t in enumerate(texts)] + [(5, "dup text here", 1, "y")] * 2 + [(6, "word " * 30_000, 1, "z")]


@pytest.mark.parametrize("chunk", [fim.CHUNK, 16, 1])
def test_against_brute_force(spark, chunk):
    given = rows() if chunk == fim.CHUNK else rows()[:-1]
    df = spark.createDataFrame(given, "doc_id long, text string, n int, `a.b` string")
    out = fim.transformed(df, chunk=chunk)
    assert out.columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]  # the new n replaces the old
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((brute(i, t) for i, t, _, _ in given), key=key)
    assert all(r.back == (r.text or "") for r in got)


def test_empty_table(spark):
    assert fim.transformed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_functions_compose():
    """Any cut of a tape into chunks gives the same states and counts."""
    r = np.random.default_rng(1)
    data = np.frombuffer(b"".join(bytes([x]) for x in r.choice(list("aP<>S M1é".encode()), 999)), dtype=np.uint8)
    whole = fim.Tape(data)
    for cuts in ([333], [1, 2, 3, 500], [998]):
        for entry in range(4):
            state, tokens, marks = entry, 0, 0
            for part in np.split(data, cuts):
                tape = fim.Tape(part)
                n, m = tape.counts(state)
                tokens, marks, state = tokens + int(n.sum()), marks + int(m.sum()), int(fim.APPLY[tape.function, state])
            n, m = whole.counts(entry)
            assert (state, tokens, marks) == (int(fim.APPLY[whole.function, entry]), int(n.sum()), int(m.sum()))
