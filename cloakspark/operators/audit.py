"""A hash-chained audit table and signed receipts.

Each record's hash covers its canonical JSON, which holds the hash before it. A chain is sealed in its order; checking
recomputes all hashes in parallel and brings neighbours together by their numbers.
"""

from __future__ import annotations

import hmac
import json
import re
from collections.abc import Callable
from functools import lru_cache
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..errors import AuditIntegrityError, ValidationError
from ..functions.json_tools import Literal, canonical, digest, parse, write
from ..plans.spec import cached

GENESIS = "0" * 64
GUARDED = "[GUARDED]"
DOMAIN, RECEIPT, CHECKSUM = "audit-record", "receipt", "input-checksum"
_BODY = ("chain_id", "seq", "ts", "operation", "actor", "source", "policy", "fields", "checksums", "attributes", "guarded", "prev")
#: What a log mustn't hold unless it is told otherwise: whatever the precise detectors find.
_BUILTIN = json.dumps({"categories": "credit-card email iban ipv4 ipv6 national-id ssn".split()})
_HEX = re.compile("[0-9a-f]{64}")
_NAMES = tuple(c.split()[0] for c in S.AUDIT.split(", "))
#: Distinct texts of which a task remembers what the guard made of them.
REMEMBERED = 1 << 14
#: Bits of the numbers that records of one block share where chains are verified.
BLOCK_BITS = 12


def builtin_guard(text: str) -> bool:
    return cached(_BUILTIN).test(text)


def record_hash(record: dict, key: bytes | None = None) -> str:
    return digest(canonical({k: record[k] for k in _BODY}), key, DOMAIN)


def _writer(names: tuple[str, ...]) -> Callable[..., str]:
    """canonical of a flat record whose values, given in the order of names, are mostly texts."""
    order = sorted(range(len(names)), key=lambda i: names[i])  # the names are ASCII
    form = "{" + ",".join(f'"{names[i]}":%s' for i in order) + "}"

    def write(*row):
        return form % tuple([encode_basestring(v) if type(v) is str else "null" if v is None else str(v) if type(v) is int else canonical(v) for v in map(row.__getitem__, order)])

    return write


_body, _line = _writer(_BODY), _writer(_NAMES)


def _column(f, kind: str, to: pa.DataType):
    """f of each row's values as a function of columns, without pandas between."""
    return F.arrow_udf(lambda *columns: pa.array(map(f, *[c.to_pylist() for c in columns]), to), kind)


def guard(text: str | None, sensitive: Callable[[str], bool]) -> tuple[str | None, int]:
    """The text, or the guard's label if it holds what an audit log mustn't."""
    return (GUARDED, 1) if text and sensitive(text) else (text, 0)


def guard_path(path: str, sensitive: Callable[[str], bool]) -> tuple[str, int]:
    """A JSON pointer with * for the members whose names a log mustn't hold, and how many there are."""
    parts = [("*", 1) if part and sensitive(part.replace("~1", "/").replace("~0", "~")) else (part, 0) for part in path.split("/")]
    return "/".join(p for p, _ in parts), sum(n for _, n in parts)


def guard_json(text: str | None, sensitive: Callable[[str], bool]) -> tuple[str | None, int]:
    """JSON with the label for keys, texts and numbers that a log mustn't hold; members named path are pointers. What isn't
    JSON is a text."""
    if not text:
        return text, 0
    try:
        value = parse(text)
    except (ValueError, RecursionError):
        return guard(text, sensitive)
    count = 0

    def walk(x, name=None):
        nonlocal count
        if isinstance(x, dict):
            out = {}
            for k, v in x.items():
                safe, hit = guard(k, sensitive)
                count += hit
                n, base = 2, safe
                while safe in out or (hit and safe in x):
                    safe, n = f"{base}#{n}", n + 1
                out[safe] = walk(v, k)
            return out
        if isinstance(x, list):
            return [walk(v, name) for v in x]
        if isinstance(x, str):  # numbers as well: as they are written
            new, hit = guard_path(x, sensitive) if name == "path" and not isinstance(x, Literal) else guard(str(x), sensitive)
            count += hit
            return new if hit else x
        return x

    new = walk(value)
    return (write(new), count) if count else (text, 0)


def guard_digests(text: str | None, members: tuple[str, ...], sensitive: Callable[[str], bool]) -> tuple[str | None, int]:
    """JSON whose named members must be SHA-256 in hex: the label for those that aren't, the rest as guard_json."""
    new, n = guard_json(text, sensitive)
    try:
        value = parse(new) if new else None
    except ValueError:
        return new, n
    bad = [m for m in members if isinstance(value, dict) and m in value and not (isinstance(value[m], str) and _HEX.fullmatch(value[m]))]
    return (write(value | dict.fromkeys(bad, GUARDED)), n + len(bad)) if bad else (new, n)


def heads_of(audit: DataFrame) -> DataFrame:
    """chain_id, seq, hash of each chain's last record."""
    return audit.groupBy("chain_id").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def seal(events: DataFrame, key: bytes | None = None, sensitive: Callable[[str], bool] | None = None, heads: DataFrame | None = None) -> DataFrame:
    """The audit table of events (chain_id, ts, operation, actor, source; fields, attributes and, if there are such columns,
    policy and checksums as JSON; seq gives the order).

    Nothing that sensitive (by default, the precise detectors) says yes to is written: texts, keys, numbers and parts of
    paths become [GUARDED] or *, and guarded counts them; this is done where the events are. A chain is hashed by one task, a run of
    rows at a time: it goes in order and holds only the last hash. Make chains by job or partition to hash in parallel. heads
    continue chains that were written before.
    """
    tell = sensitive or builtin_guard
    kinds = {"operation": None, "actor": None, "source": None, "fields": guard_json, "attributes": guard_json, "policy": ("digest",), "checksums": ("input", "output")}

    def guarded(parts):
        test = lru_cache(REMEMBERED)(tell)

        def remembered(kind):
            if kind is None:
                return lambda t: guard(t, test)
            return lru_cache(REMEMBERED)((lambda t: guard_json(t, test)) if kind is guard_json else (lambda t: guard_digests(t, kind, test)))

        by = {c: remembered(kind) for c, kind in kinds.items()}
        for part in parts:
            counts = [0] * part.num_rows
            for c, f in by.items():
                new = []
                for i, t in enumerate(part.column(c).to_pylist()):
                    t, hit = (t, 0) if t is None else f(t)
                    counts[i] += hit
                    new.append(t)
                part = part.set_column(part.schema.get_field_index(c), c, pa.array(new, pa.string()))
            yield part.append_column("guarded", pa.array(counts, pa.int32()))

    def run(parts):
        last: dict[str, tuple[int, str]] = {}
        for part in parts:
            own = {c: part.column(c).to_pylist() for c in (*_BODY, "head_seq", "head_hash") if c not in ("seq", "prev")}
            seqs, prevs, hashes = [], [], []
            rest = zip(*[own[c] for c in _BODY if c not in ("seq", "prev")])
            for (chain, *r), head_seq, head_hash in zip(rest, own["head_seq"], own["head_hash"]):
                n, prev = last.get(chain) or ((-1, GENESIS) if head_seq is None else (head_seq, head_hash))
                n += 1
                h = digest(_body(chain, n, *r, prev), key, DOMAIN)
                last = {chain: (n, h)}
                seqs.append(n)
                prevs.append(prev)
                hashes.append(h)
            new = {"seq": pa.array(seqs, pa.int64()), "prev": pa.array(prevs, pa.string()), "hash": pa.array(hashes, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(c, part.column(c) if c in own else None) for c in _NAMES], list(_NAMES))

    more = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("policy", "checksums")]
    own = events.select("chain_id", "seq", "ts", "operation", "actor", "source", "fields", "attributes", *more)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", guarded int"
    own = own.mapInArrow(guarded, kind)
    if heads is None:
        own = own.select("*", F.lit(None).cast("long").alias("head_seq"), F.lit(None).cast("string").alias("head_hash"))
    else:
        own = own.join(heads.select("chain_id", F.col("seq").cast("long").alias("head_seq"), F.col("hash").alias("head_hash")), "chain_id", "left")
    return own.repartition("chain_id").sortWithinPartitions("chain_id", "seq").mapInArrow(run, S.AUDIT)


def verify(audit: DataFrame, key: bytes | None = None, heads: DataFrame | None = None) -> DataFrame:
    """chain_id, records, ok, index, reason (bad-seq, bad-prev, malformed, bad-hash, head-mismatch): the first failure of each chain.

    Records meet the one before them in blocks of numbers, so that a long chain is checked by many tasks. Of records that
    share a number, the second one is the failure, and if one of them fails by itself, the first.

    heads (chain_id, seq, hash) are heads kept elsewhere: a chain that was cut short doesn't reach its own.
    """

    def one(*row):
        try:
            return digest(_body(*row), key, DOMAIN)
        except (TypeError, ValueError, ValidationError):
            return None

    own = audit.select("chain_id", F.col("seq").cast("long").alias("seq"), F.struct("prev", _column(one, "string", pa.string())(*_BODY).alias("h"), "hash").alias("r"))
    # Records go to blocks of numbers, the last of a block to the next one too, as the one before. One shuffle and one sort serve all that follows.
    block = lambda n: F.shiftright(n, BLOCK_BITS)
    ends = F.coalesce(block(F.col("seq") + 1) > block(F.col("seq")), F.lit(False))
    here = F.struct(block(F.col("seq")).alias("block"), F.col("r").alias("r"))
    next_ = F.struct((block(F.col("seq")) + 1).alias("block"), F.lit(None).cast(own.schema["r"].dataType).alias("r"))
    rows = own.select("chain_id", "seq", F.col("r.hash").alias("hash"), F.explode(F.when(ends, F.array(here, next_)).otherwise(F.array(here))).alias("x")).select("chain_id", "x.block", "seq", "hash", "x.r")
    rows = rows.repartition("chain_id", "block").sortWithinPartitions("chain_id", "block", "seq")
    places = rows.groupBy("chain_id", "block", "seq").agg(F.count("r").alias("n"), F.min("r").alias("a"), F.max("r").alias("b"), F.max("hash").alias("h"))
    w = Window.partitionBy("chain_id", "block").orderBy("seq")
    follows = lambda x, y: F.coalesce(x == y + 1, F.lit(False))
    goes_on = follows(F.lead("seq").over(w), F.col("seq"))
    judged = (F.col("n") == 0) | F.coalesce(block(F.col("seq") + 1) == F.col("block"), F.lit(False))  # whether the number after it is of this block
    places = places.select("*", F.lag("h").over(w).alias("q"), follows(F.col("seq"), F.lag("seq").over(w)).alias("after"), F.when(judged & ~goes_on & (F.col("seq") >= 0), F.col("seq") + 1).alias("gap"))
    places = places.withColumn("p", F.when(F.col("after"), F.col("q")))
    first = F.col("seq") == 0

    def wrong(r):
        why = F.when(F.col("seq").isNull() | (F.col("seq") < 0) | (~first & ~F.col("after")), "bad-seq").when(~r["prev"].eqNullSafe(F.when(first, F.lit(GENESIS)).otherwise(F.col("p"))), "bad-prev")
        return why.when(r["h"].isNull(), "malformed").when(~r["h"].eqNullSafe(r["hash"]), "bad-hash")

    alone = F.coalesce(wrong(F.col("a")), wrong(F.col("b")))
    why = F.when(F.col("n") > 0, F.when(alone.isNotNull(), F.struct(F.col("seq").alias("s"), F.lit(0).alias("twice"), alone.alias("why"))).when(F.col("n") > 1, F.struct(F.col("seq").alias("s"), F.lit(1).alias("twice"), F.lit("bad-seq").alias("why"))))
    out = places.withColumn("why", why).groupBy("chain_id").agg(
        F.sum("n").alias("records"),
        F.min("why").alias("w"),
        F.min("gap").alias("gap"),  # the first number that no record has
        F.max(first & (F.col("n") > 0)).alias("begun"),
        F.max_by("b.hash", F.when(F.col("n") > 0, F.col("seq"))).alias("__head"),
    )
    lost = F.when(F.col("begun") & (F.col("w.s") > 0), F.col("gap")).otherwise(0)
    index = F.when((F.col("w.why") == "bad-seq") & (F.col("w.twice") == 0), lost).otherwise(F.col("w.s") + F.col("w.twice")).cast("int")
    out = out.select("chain_id", "records", "__head", F.when(F.col("w").isNotNull(), F.struct(index.alias("__i"), F.col("w.why").alias("__why"))).alias("bad"))
    if heads is not None:
        out = heads.select("chain_id", F.col("hash").alias("__want")).join(out, "chain_id", "full")
        late = (F.col("__want").isNotNull()) & ~F.col("__want").eqNullSafe(F.col("__head"))
        out = out.withColumn("bad", F.when(F.col("bad").isNull() & late, F.struct(F.coalesce("records", F.lit(0)).cast("int").alias("__i"), F.lit("head-mismatch").alias("__why"))).otherwise(F.col("bad")))
    return out.select("chain_id", F.coalesce("records", F.lit(0)).alias("records"), F.col("bad").isNull().alias("ok"), F.col("bad.__i").alias("index"), F.col("bad.__why").alias("reason"))


def append_batches(path: str, key: bytes | None = None, sensitive: Callable[[str], bool] | None = None):
    """For foreachBatch: seals each batch of events onto the chains of the table at path. Each batch is written as a folder of
    its own number, so a batch that is tried again replaces itself.

    The chains' heads after each batch are kept in a table beside it, of which the last two are left: what a batch
    costs doesn't grow with the history. Without that table the heads are read from the history once.
    """
    beside = path.rstrip("/") + "_heads"

    def old_heads(spark, batch: int) -> tuple[DataFrame | None, list[int]]:
        try:
            numbers = sorted(r["batch"] for r in spark.read.option("basePath", beside).parquet(beside).select("batch").distinct().collect() if r["batch"] < batch)
        except AnalysisException:
            numbers = []
        if numbers:
            return spark.read.parquet(f"{beside}/batch={numbers[-1]}"), numbers
        try:
            return heads_of(spark.read.option("basePath", path).parquet(path).where(F.col("batch") < batch)), []
        except AnalysisException:  # nothing is written yet
            return None, []

    def write(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        heads, numbers = old_heads(spark, batch)
        seal(events, key, sensitive, heads).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        new = spark.read.parquet(f"{path}/batch={batch}").select("chain_id", "seq", "hash")
        both = new if heads is None else new.unionByName(heads.select("chain_id", "seq", "hash"))
        heads_of(both).write.mode("overwrite").parquet(f"{beside}/batch={batch}")
        for n in numbers[:-1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{beside}/batch={n}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return write


def require_intact(audit: DataFrame, key: bytes | None = None, heads: DataFrame | None = None) -> None:
    bad = verify(audit, key, heads).where("NOT ok").first()
    if bad:
        raise AuditIntegrityError(f"chain {bad['chain_id']}: {bad['reason']} at {bad['index']}")


def to_lines(audit: DataFrame) -> DataFrame:
    """value: each record as a line of canonical JSON, for write.text."""
    return audit.select(_column(_line, "string", pa.string())(*_NAMES).alias("value"))


def from_lines(lines: DataFrame) -> DataFrame:
    """The table of such lines: blank ones are left out; a line that isn't canonical, or not of a record, gives a row of nulls."""
    ints = {"seq": 63, "guarded": 31}
    none = (None,) * len(_NAMES)

    def one(line):
        try:
            x = json.loads(line)
            if not isinstance(x, dict) or len(x) != len(_NAMES):
                return none
            r = tuple([x[n] for n in _NAMES])
            fits = all(v is None or (type(v) is int and -1 << ints[n] <= v < 1 << ints[n] if n in ints else type(v) is str) for n, v in x.items())
            return r if fits and _line(*r) == line else none
        except (ValueError, KeyError, RecursionError):
            return none

    to = pa.struct([(n, pa.int64() if n == "seq" else pa.int32() if n == "guarded" else pa.string()) for n in _NAMES])

    def run(column):
        rows = list(map(one, column.to_pylist()))
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_NAMES), to)], fields=list(to))

    kind = "struct<" + S.AUDIT.replace(" ", ":").replace(",:", ",") + ">"
    return lines.select(F.regexp_replace("value", "\r$", "").alias("value")).where("trim(value) <> ''").select(F.arrow_udf(run, kind)("value").alias("r")).select("r.*")


def input_checksum(key: bytes, text: str) -> str:
    if not key:
        raise ValidationError("key", "checksums of inputs are keyed only")
    return digest(text, key, CHECKSUM)


def issue_receipt(key: bytes, key_id: str, *, id: str, timestamp: str, output: str, stats: dict[str, int], presets=(), input: str | None = None) -> dict:
    """A signed statement over the digests of a run's output and, keyed, of its input."""
    if not re.fullmatch("[0-9a-f]{64}", output):
        raise ValidationError("output", "must be a SHA-256 in hex")
    body = {"v": 1, "id": id, "timestamp": timestamp, "presets": list(presets), "stats": dict(sorted(stats.items())), "total": sum(stats.values()), "output": output, "input": input, "alg": "HMAC-SHA-256", "key_id": key_id}
    return body | {"signature": digest(canonical(body), key, RECEIPT)}


def verify_receipt(receipt: dict, key: bytes, *, output: str | None = None, input: str | None = None) -> str | None:
    """None, or what is wrong first: malformed, signature, output, input."""
    body = {k: v for k, v in receipt.items() if k != "signature"}
    try:
        if receipt.get("v") != 1 or not isinstance(receipt.get("stats"), dict) or receipt.get("total") != sum(receipt["stats"].values()):
            return "malformed"
        want = digest(canonical(body), key, RECEIPT)
    except (TypeError, ValueError, ValidationError):
        return "malformed"
    if not hmac.compare_digest(want, str(receipt.get("signature"))):
        return "signature"
    if output is not None and output != receipt["output"]:
        return "output"
    return "input" if input is not None and input != receipt["input"] else None
