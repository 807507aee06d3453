"""Streams over files: sessions with late rows, chat state over a restart, and nearest vectors."""

import json
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tarn.operators import vectors
from tarn.streaming import chat_state, sessions

T0 = datetime(2024, 1, 1)


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r, default=lambda d: d.isoformat()) for r in rows))
    at = 1_700_000_000 + 60 * int(name.split(".")[0])  # the source goes by the files' times
    os.utime(folder / name, (at, at))


def plain_sessions(rows, gap):
    out = []
    for k in {r["k"] for r in rows}:
        run = []
        for r in sorted((r for r in rows if r["k"] == k and r["ts"]), key=lambda r: r["ts"]):
            if run and r["ts"] - run[-1]["ts"] > gap:
                out.append(run)
                run = []
            run.append(r)
        out += [run] if run else []
    return sorted(((run[0]["k"], run[0]["ts"], run[-1]["ts"] + gap, len(run), sum(x["v"] for x in run)) for run in out), key=str)


def test_sessions(spark, tmp_path):
    r = random.Random(1)
    rows = [{"k": r.choice([1, 2, None]), "ts": T0 + timedelta(minutes=r.randint(0, 400)), "v": r.randint(0, 9)} for _ in range(80)]
    rows.sort(key=lambda x: x["ts"])
    schema, gap = "k int, ts timestamp, v int", timedelta(minutes=7)
    for i in range(4):
        write(tmp_path / "in", f"{i}.json", rows[20 * i : 20 * i + 20])
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    make = lambda df: sessions.sessions(df, "k", "ts", "v", "7 minutes", "10 minutes")
    batch = spark.read.schema(schema).json(str(tmp_path / "in"))
    whole = sorted((tuple(x) for x in make(batch).collect()), key=str)
    assert whole == plain_sessions(rows, gap)
    told = sessions.run(make(read()), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert (told.rows, told.late) == (80, 0)
    mark = datetime.fromisoformat(told.watermark.removesuffix("Z"))
    assert mark == rows[-1]["ts"] - timedelta(minutes=10)
    got = sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == [x for x in whole if x[2] <= mark] and len(got) > 5
    # late rows change nothing and are counted; a row on time closes what is left
    write(tmp_path / "in", "4.json", [{"k": 1, "ts": T0, "v": 100}, {"k": 2, "ts": T0 + timedelta(minutes=1), "v": 100}, {"k": 9, "ts": T0 + timedelta(days=1), "v": 1}, {"k": 9, "ts": None, "v": 1}])
    told = sessions.run(make(read()), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert told.late == 2
    assert sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == whole


def test_chat_state(spark, tmp_path):
    r = random.Random(2)
    talks = {c: [{"conv_id": c, "at": T0 + timedelta(minutes=c + 2 * i), "role": "user" if i % 2 == 0 else "assistant", "content": f"{c}-{i}"} for i in range(r.randint(1, 9))] for c in range(12)}
    rows = sorted((m for t in talks.values() for m in t), key=lambda m: m["at"])
    run = lambda: sessions.run(chat_state.turns(chat_state.read_messages(spark, str(tmp_path / "in")), "30 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    third = len(rows) // 3
    for i, part in enumerate((rows[:third], rows[third : 2 * third])):
        write(tmp_path / "in", f"{i}.json", r.sample(part, len(part)))
    run()
    write(tmp_path / "in", "2.json", rows[2 * third :])  # after a restart
    run()
    got = {(x.conv_id, x.turn): x.content for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(c, i): m["content"] for c, t in talks.items() for i, m in enumerate(t)}
    write(tmp_path / "in", "9.json", [{"conv_id": 1, "at": T0 - timedelta(days=1), "role": "user", "content": "late"}, {"conv_id": 1, "at": None, "role": "user", "content": "no time"}])
    assert run().late == 2
    late = T0 + timedelta(days=2)
    write(tmp_path / "in", "10.json", [{"conv_id": 1, "at": late, "role": "user", "content": "again"}, {"conv_id": 1, "at": late, "role": "assistant", "content": "yes"}])
    run()
    again = [(x.turn, x.content) for x in spark.read.parquet(str(tmp_path / "out")).where("content in ('again', 'yes')").orderBy("turn").collect()]
    assert again == [(0, "again"), (1, "yes")]  # the conversation had ended


@pytest.mark.parametrize("lists,part", [(64, 20_000), (7, 13)])
def test_nearest(spark, lists, part):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(6)] + [(500, None), (501, [1.0] * 7), (502, [None] + [0.0] * 7), (503, [float("inf")] * 8), (9, [100.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.q, r.rk): r.id for r in vectors.nearest(df, df.where("vec_id % 50 = 0 or vec_id = 502"), 5, 8, lists=lists, part=part).collect()}
    want = {}
    good = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all()]
    for q, x in good:
        if q % 50 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:5]
            want |= {(q, k + 1): i for k, (_, i) in enumerate(near)}
    assert got == want
    few = df.where("vec_id < 3")
    assert vectors.nearest(few, few, 5, 8).count() == 6
    assert vectors.nearest(df.limit(0), df, 5, 8).count() == 0 and vectors.nearest(df, df.limit(0), 5, 8).count() == 0


def test_lists_are_skipped():
    """A far list is out of bounds for a query near its own centroid."""
    rng = np.random.default_rng(1)
    centres = np.eye(4)[:, :4] * 50
    x = np.concatenate([c + rng.normal(size=(50, 4)) for c in centres])
    d = vectors.distances(x[:5], centres)
    radius = np.array([np.sqrt(((x[50 * j : 50 * j + 50] - centres[j]) ** 2).sum(axis=1)).max() for j in range(4)])
    kth = np.sort(vectors.distances(x[:5], x), axis=1)[:, 5]
    assert ((d - radius <= kth[:, None]).sum(axis=1) == 1).all()
