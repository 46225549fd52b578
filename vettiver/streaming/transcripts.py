"""Transcript events: typing of frames, and the time from a session's first audio to each final transcript.

A frame has (session, ts, frame): JSON {"kind", "text"}. The same expressions serve tables and streams; the latency is
a join with each session's first audio on tables, and on streams a state of one time stamp for each session that ends with the session or
after an hour without frames, so that state does not grow for ever.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE_MS = 3_600_000
# What the event table's types stand for in a speech session.
KINDS = {"view": "audio", "click": "partial", "purchase": "final", "signup": "begin", "error": "error"}


def frames(events: DataFrame) -> DataFrame:
    """The event table as frames of sessions: (session, ts, seq, frame); each event once."""
    kind = None
    for name, stands in KINDS.items():
        kind = (F if kind is None else kind).when(F.col("event_type") == name, stands)
    frame = F.to_json(F.struct(kind.otherwise("other").alias("kind"), F.col("props").alias("text")))
    rows = events if events.isStreaming else events.dropDuplicates(["event_id"])
    return rows.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), frame.alias("frame"))


def typed(rows: DataFrame) -> DataFrame:
    """(session, ts, seq, event, text, is_final): partial and final transcripts, begin, end and error; the rest, and broken JSON, goes."""
    read = rows.withColumn("f", F.from_json("frame", "kind string, text string"))
    kept = read.where(F.col("f.kind").isin("partial", "final", "begin", "end", "error"))
    spoken = F.col("f.kind").isin("partial", "final")
    return kept.select("session", "ts", "seq", F.col("f.kind").alias("event"), F.when(spoken, F.col("f.text")).alias("text"), (F.col("f.kind") == "final").alias("is_final"))


def final_latency(rows: DataFrame) -> DataFrame:
    """(session, seq, latency_ms) of every final; null where no audio came before it in the session."""
    read = rows.withColumn("kind", F.from_json("frame", "kind string, text string")["kind"])
    # the first audio so far is the session's first audio, or there was none yet: no window over a long session is needed
    first = read.where("kind = 'audio'").groupBy("session").agg(F.min(F.struct("ts", "seq")).alias("first"))
    finals = read.where("kind = 'final'").join(first, "session", "left")
    before = F.struct("first.ts", "first.seq") < F.struct("ts", "seq")
    latency = F.when(before, F.timestamp_diff("MICROSECOND", F.col("first.ts"), F.col("ts")) / 1000)
    return finals.select("session", "seq", F.round(latency, 3).alias("latency_ms"))


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    (first,) = state.get if state.exists else (None,)
    rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
    out, ended = [], False
    for ts, seq, kind in zip(rows["ts"], rows["seq"], rows["kind"], strict=True):
        if kind == "audio" and first is None:
            first = int(ts.value // 1000)
        elif kind == "final":
            out.append((key[0], seq, None if first is None else round((ts.value // 1000 - first) / 1000, 3)))
        ended = ended or kind == "end"
    if ended:
        state.remove()
    elif first is not None:
        state.update((first,))
        state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=["session", "seq", "latency_ms"])


def stream_final_latency(rows: DataFrame) -> DataFrame:
    """``final_latency`` over a stream of frames; frames of one micro-batch are put in order, later ones are not moved back."""
    read = rows.withColumn("kind", F.from_json("frame", "kind string, text string")["kind"]).where(F.col("kind").isin("audio", "final", "end"))
    return read.select("session", "ts", "seq", "kind").groupBy("session").applyInPandasWithState(
        _advance, "session bigint, seq bigint, latency_ms double", "first bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


LANGUAGES = ("ta", "hi")


def opened(sessions: DataFrame) -> DataFrame:
    """(session, language, error): a session's language, 'ta' where none is named; one that is not served is an error row."""
    language = F.coalesce("language", F.lit("ta"))
    return sessions.select("session", language.alias("language"), F.when(~language.isin(*LANGUAGES), F.concat(F.lit("unsupported_language: "), language)).alias("error"))


def spoken_queries(rows: DataFrame) -> DataFrame:
    """(request_id, query): every final transcript that is not blank asks a query."""
    finals = typed(rows).where(F.col("is_final") & (F.trim("text") != ""))
    return finals.select(F.concat_ws("-", "session", "seq").alias("request_id"), F.trim("text").alias("query"))


def encoded_audio(rows: DataFrame) -> DataFrame:
    """(session, seq, audio): the audio frames' bytes as the speech service takes them."""
    read = rows.withColumn("kind", F.from_json("frame", "kind string, text string")["kind"]).where("kind = 'audio'")
    return read.select("session", "seq", F.base64(F.encode("frame", "UTF-8")).alias("audio"))


def answer_stream(rows: DataFrame, ask: Callable[[DataFrame, int], None], checkpoint: str):
    """Start the stream of spoken queries: ``ask`` gets each micro-batch (request_id, query) and its number once."""
    return spoken_queries(rows).writeStream.foreachBatch(ask).option("checkpointLocation", checkpoint).start()


def load_stream(chunks: DataFrame, path: str, checkpoint: str):
    """Load chunk files as they come: each micro-batch adds the chunks that the table at ``path`` does not have yet."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(["chunk_id"])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti")
        rows.write.mode("append").parquet(path)

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
