"""Chunk-safe operators on streams of (stream_id, seq, chunk, final)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.chunks import ChunkRestorer, ChunkTransformer
from ..functions.tokens import Session
from ..plans.spec import cached, compile_pipeline

OUT = "stream_id string, seq long, text string, final boolean"


def _ordered(rows: pd.DataFrame, held: dict, upto: int):
    """Rows in the order of seq, from upto on and without a gap; the others are held."""
    for seq, chunk, final in zip(rows["seq"], rows["chunk"], rows["final"]):
        if int(seq) >= upto:
            held[str(int(seq))] = [chunk or "", bool(final)]
    while str(upto) in held:
        yield upto, *held.pop(str(upto))
        upto += 1


def _stateful(make, timeout: int | None):
    """A function of the groups of one stream: make(saved) gives push, flush and what to save."""

    def run(key, parts, state: GroupState):
        saved = json.loads(state.get[0]) if state.exists else {"next": 0, "held": {}, "own": None}
        push, flush, own = make(saved["own"])
        if state.hasTimedOut:  # nothing came for too long: what is there is written, across gaps
            text = "".join(push(saved["held"][k][0]) for k in sorted(saved["held"], key=int)) + flush()
            last = max([saved["next"] - 1, *map(int, saved["held"])])
            state.remove()
            yield pd.DataFrame([(key[0], last + 1, text, True)], columns=["stream_id", "seq", "text", "final"])
            return
        rows = pd.concat(list(parts), ignore_index=True)
        out, done = [], False
        for seq, chunk, final in list(_ordered(rows, saved["held"], saved["next"])):
            saved["next"] = seq + 1
            text = push(chunk) + (flush() if final else "")
            done = done or final
            if text or final:
                out.append((key[0], seq, text, final))
        if done:
            state.remove()
        else:
            saved["own"] = own()
            state.update((json.dumps(saved),))
            if timeout:
                state.setTimeoutDuration(timeout)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text", "final"])

    return run


def _apply(df: DataFrame, make, timeout: int | None = None) -> DataFrame:
    own = df.select(F.col("stream_id").cast("string"), F.col("seq").cast("long"), "chunk", "final")
    if df.isStreaming:
        kind = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
        return own.groupBy("stream_id").applyInPandasWithState(_stateful(make, timeout), OUT, "saved string", "append", kind)

    def batch(parts):
        """A stream's rows come in order, in as many batches as they need; only the state of the current one is kept."""
        key, now, last, ended = None, None, -1, True
        for pdf in parts:
            out = []
            for id, seq, chunk, final in zip(pdf["stream_id"], pdf["seq"], pdf["chunk"], pdf["final"]):
                if now is None or id != key:
                    if not ended:
                        out.append((key, last + 1, now[1](), True))
                    key, now, last, ended = id, make(None), -1, False
                if ended or seq <= last:
                    continue
                last, final = seq, bool(final)
                text = now[0](chunk or "") + (now[1]() if final else "")
                ended = final
                if text or final:
                    out.append((id, seq, text, final))
            yield pd.DataFrame(out, columns=["stream_id", "seq", "text", "final"])
        if not ended:
            yield pd.DataFrame([(key, last + 1, now[1](), True)], columns=["stream_id", "seq", "text", "final"])

    return own.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(batch, OUT)


def transform_chunks(df: DataFrame, spec: dict | None = None, window: int | None = None, timeout: int | None = None) -> DataFrame:
    """stream_id, seq, text, final: the pieces of each stream's transformed text.

    Chunks may come late or several times (the first one counts; seq begins at 0). What a stream holds back is written
    with its final chunk; without one, a batch writes it at the end, as a row of its own after the last, and a stream once
    nothing has come for timeout milliseconds. Without a timeout, a stream keeps it. With one, the query always has another
    batch to run: use it with triggers that go on, not with availableNow, which would never end.
    """
    compile_pipeline(spec)
    s = json.dumps(spec or {}, sort_keys=True)

    def make(saved):
        t = ChunkTransformer(cached(s), window, saved)
        return t.push, t.flush, t.state

    return _apply(df, make, timeout)


def tokenize_chunks(df: DataFrame, spec: dict | None = None, shape: str = "bracket", timeout: int | None = None) -> DataFrame:
    """The same with session tokens, numbered in each stream by first appearance."""
    compile_pipeline(spec)

    def make(saved):
        session = Session(shape, snapshot=saved["session"] if saved else None)
        p = compile_pipeline({**(spec or {}), "default_strategy": {"strategy": "tokenize"}}, session)
        t = ChunkTransformer(p, None, saved["chunks"] if saved else None)
        return t.push, t.flush, lambda: {"session": session.snapshot(), "chunks": t.state()}

    return _apply(df, make, timeout)


def restore_chunks(df: DataFrame, mapping: dict[str, str], timeout: int | None = None) -> DataFrame:
    """Tokens of a bounded mapping back to values, also where a token is split between chunks."""

    def make(saved):
        r = ChunkRestorer(mapping, saved or "")
        return r.push, r.flush, lambda: r.carry

    return _apply(df, make, timeout)


def transform_stateless(df: DataFrame, text_col: str, spec: dict | None = None) -> DataFrame:
    """Each row on its own; values that are split between rows are missed."""
    from ..operators.text import transform

    return df.withColumn(text_col, transform(F.col(text_col), spec)["text"])


def detections_by_window(df: DataFrame, text_col: str, ts_col: str, width: str = "1 hour", late: str = "10 minutes", categories=None) -> DataFrame:
    """window_start, category, n: counts by event time, for batches and streams."""
    from ..operators.text import detect

    own = df.withWatermark(ts_col, late) if df.isStreaming else df
    hits = own.select(ts_col, F.explode(detect(F.col(text_col), categories)).alias("m"))
    return hits.groupBy(F.window(ts_col, width), F.col("m.category").alias("category")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "category", "n")
