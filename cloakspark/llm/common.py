"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names, else (unset, as in tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(*names: str) -> list[str]:
    """Column names that no input has."""
    tail = uuid.uuid4().hex[:8]
    return [f"__{n}_{tail}" for n in names]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names; extra columns of any name stay behind."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): each input bit changes each output bit with probability one half."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x += U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E6C63D0876A9A4D | 5  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mix(np.arange(1, 257, dtype=U64)) | U64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base & (2**64 - 1), dtype=U64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes outside ASCII white space) of docs, and the word count of each."""
    buf = np.frombuffer(b"\n".join([b"", *docs, b""]), dtype=np.uint8)
    space = _SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter((len(d) + 1 for d in docs), dtype=np.int64, count=len(docs))
    bounds = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(starts, bounds, side="right"), prepend=0)
    if not len(starts):
        return np.zeros(0, dtype=U64), counts
    up, down = _powers(len(buf))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, dtype=U64)
        np.take(_LETTER, buf, out=sums[1:])
        sums[1:] *= up[: len(buf)]
        np.cumsum(sums, out=sums)
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)
    return mix(h), counts


def batches(sizes, limit: int):
    """Ranges of consecutive items whose sizes add up to at most limit, or a single item."""
    begin, total, end = 0, 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
        end = i + 1
    if end > begin:
        yield begin, end


def text_batches(parts, limit: int):
    """(ids, texts) of bounded runs of rows of Arrow batches (doc, text): only one run is Python objects at a time."""
    for part in parts:
        doc, text = part.column("doc"), part.column("text")
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for a, b in batches(sizes, limit):
            yield doc.slice(a, b - a), text.slice(a, b - a).to_pylist()
        part = doc = text = None
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: idle workers share an executor's memory with the stages after theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shingle_hashes(docs: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each document's k-word shingles; fewer words: the whole sequence as one; no word: empty."""
    words, counts = word_hashes(docs)
    out = []
    with np.errstate(over="ignore"):
        weights = [U64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(k)]
        at = 0
        n = len(words)
        if n >= k:
            all_ = np.zeros(n - k + 1, dtype=U64)
            for i, w in enumerate(weights):
                all_ += words[i : n - k + 1 + i] * w
            all_ = mix(all_)
        for c in counts:
            if c >= k:
                out.append(np.unique(all_[at : at + c - k + 1]))
            elif c:
                short = np.array([sum(int(words[at + i]) * int(weights[i]) for i in range(c)) + int(c) & (2**64 - 1)], dtype=U64)
                out.append(mix(short))
            else:
                out.append(np.zeros(0, dtype=U64))
            at += c
    return out


#: Rows of ids (8 bytes each) that may be broadcast; more are joined by shuffling.
BROADCAST_IDS = 1 << 20


def bounded(ids: DataFrame) -> DataFrame:
    """ids, written and counted: to be broadcast if there are few, else as it is."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """docs without the rows whose id is in the first column of ids; null ids stay."""
    (name,) = fresh("gone")
    ids = bounded(ids.toDF(name).where(F.col(name).isNotNull()).distinct())
    return docs.join(ids, F.col(f"`{id_col}`") == F.col(name), "left_anti")
