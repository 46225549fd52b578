"""The stream and the table give the same latencies."""

import json

import pandas as pd

from vettiver.streaming import transcripts


def rows():
    out = []
    for session in (1, 2, 3):
        for i, kind in enumerate(["final", "audio", "partial", "final", "audio", "final", "noise"][: 4 + session]):
            frame = "{broken" if kind == "noise" else json.dumps({"kind": kind, "text": "x"})
            out.append((session, f"2026-01-01 00:00:{10 * session + i:02d}", session * 100 + i, frame))
    return out


def test_typing_drops_unknown_and_broken(spark):
    df = spark.createDataFrame(rows(), "session bigint, ts string, seq bigint, frame string").selectExpr("session", "CAST(ts AS timestamp) AS ts", "seq", "frame")
    got = transcripts.typed(df).groupBy("event").count().collect()
    assert {r["event"]: r["count"] for r in got} == {"final": 8, "partial": 3}


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame(rows(), "session bigint, ts string, seq bigint, frame string").selectExpr("session", "CAST(ts AS timestamp) AS ts", "seq", "frame")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = transcripts.stream_final_latency(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["session"], r["seq"], r["latency_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["session"], r["seq"], r["latency_ms"]) for r in transcripts.final_latency(df).collect()}
    assert got == want and len(want) == 8
    assert (1, 100, None) in want and (1, 103, 2000.0) in want


def frame_table(spark, kinds):
    out = [(1, f"2026-01-01 00:00:{i:02d}", i, json.dumps({"kind": k, "text": t})) for i, (k, t) in enumerate(kinds)]
    return spark.createDataFrame(out, "session bigint, ts string, seq bigint, frame string").selectExpr("session", "CAST(ts AS timestamp) AS ts", "seq", "frame")


class Held:
    """A session's state, as the stream keeps it."""

    hasTimedOut, exists, get = False, False, None

    def remove(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, ms):
        self.ms = ms


def test_end_and_time_out_clear_the_state():
    at = lambda *kinds: [pd.DataFrame({"ts": pd.to_datetime([f"2026-01-01 00:00:{i:02d}" for i in range(len(kinds))]), "seq": range(len(kinds)), "kind": list(kinds)})]
    state = Held()
    out = pd.concat(transcripts._advance((1,), iter(at("audio", "final")), state))
    assert out["latency_ms"].tolist() == [1000.0] and state.exists
    list(transcripts._advance((1,), iter(at("end")), state))
    assert not state.exists
    list(transcripts._advance((1,), iter(at("audio")), state))
    state.hasTimedOut = True
    assert list(transcripts._advance((1,), iter([]), state)) == [] and not state.exists


def test_finals_ask_and_sessions_open(spark):
    df = frame_table(spark, [("audio", ""), ("partial", "who"), ("final", " who left? "), ("final", " ")])
    assert [tuple(r) for r in transcripts.spoken_queries(df).collect()] == [("1-2", "who left?")]
    got = transcripts.opened(spark.createDataFrame([(1, None), (2, "hi"), (3, "xx")], "session bigint, language string")).collect()
    assert [(r["language"], r["error"]) for r in sorted(got)] == [("ta", None), ("hi", None), ("xx", "unsupported_language: xx")]


def test_chunks_are_loaded_once_as_they_come(spark, tmp_path):
    schema = "chunk_id string, text string"
    for rows in ([("a", "x"), ("a", "x"), ("b", "y")], [("b", "y"), ("c", "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        transcripts.load_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
