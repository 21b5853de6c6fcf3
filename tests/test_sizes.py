"""Queries on small tables made for what shows only in large ones."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakspark import schemas as S
from cloakspark.functions.json_tools import canonical
from cloakspark.operators import audit, text
from cloakspark.plans.queries import QUERIES

#: A card number that a group of an address before or after it runs on with.
_ADDRESS_FIRST, _CARD_FIRST = "from 38.211.12.42 4366089147969128 on", "card 4495589438270767 42.73.240.87 a@x.org"


@pytest.fixture(scope="module")
def overlapping(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("overlapping"))
    rows = [(1, _ADDRESS_FIRST, "en"), (2, _CARD_FIRST, "en"), (3, "nothing", "de"), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


def test_receipt_stats_counts_overlapping_categories(spark, overlapping):
    got = {tuple(r) for r in QUERIES["receipt_stats"](spark, overlapping).collect()}
    assert got == {("credit-card", 2, 5), ("ipv4", 2, 5), ("email", 1, 5)}


def test_scan_findings_keep_overlapping_categories(spark, overlapping):
    got = {tuple(r) for r in QUERIES["scan_findings"](spark, overlapping).collect()}
    assert got == {(1, "credit-card", 1), (1, "ipv4", 1), (2, "credit-card", 1), (2, "ipv4", 1), (2, "email", 1)}


def test_sensitive_by_lang_category_counts_overlapping_categories(spark, overlapping):
    got = {tuple(r) for r in QUERIES["sensitive_by_lang_category"](spark, overlapping).collect()}
    assert got == {("en", "credit-card", 2), ("en", "ipv4", 2), ("en", "email", 1)}


KIND = "chain_id string, seq long, ts string, operation string, actor string, source string, fields string, attributes string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _log(spark, n=20):
    return audit.seal(spark.createDataFrame([(c, i, "t", 'o"é\n', "u", "s", "[]", '{"a":1}') for c in "ab" for i in range(n)], KIND), b"k")


def test_audit_guarded_guards_where_the_events_are(spark):
    """Only hashing goes in the order of a chain."""
    above, shuffle, below = _plan(_log(spark)).partition("Exchange hashpartitioning(chain_id")
    assert shuffle and "guarded(" in below and "run(" in above and "guarded(chain_id" not in above


def test_audit_verify_shuffles_records_once(spark):
    log = spark.createDataFrame(_log(spark).collect(), S.AUDIT)
    plan = _plan(audit.verify(log, b"k"))
    assert plan.count("Exchange hashpartitioning(chain_id") == 2 and "block" in plan and plan.count("Window [") == 1


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_audit_verify_tampered_at_the_edges_of_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(audit, "BLOCK_BITS", bits, raising=True)
    rows = [r.asDict() for r in _log(spark).collect()]
    assert all(r["hash"] == audit.record_hash(r, b"k") for r in rows)

    def check(change):
        kept = [x for r in rows for x in (change(r) if r["chain_id"] == "a" else [r])]
        got = audit.verify(spark.createDataFrame([tuple(r.values()) for r in kept], S.AUDIT), b"k").collect()
        assert ("b", 20, True, None, None) in map(tuple, got)
        return next(tuple(r)[1:] for r in got if r["chain_id"] == "a")

    for at in (3, 4, 8):
        assert check(lambda r: [] if r["seq"] == at else [r]) == (19, False, at, "bad-seq")
        assert check(lambda r: [r, r] if r["seq"] == at else [r]) == (21, False, at + 1, "bad-seq")
        assert check(lambda r: [r | {"prev": "0" * 64}] if r["seq"] == at else [r]) == (20, False, at, "bad-prev")
        assert check(lambda r: [r | {"actor": "x"}] if r["seq"] == at else [r]) == (20, False, at, "bad-hash")


def test_audit_lines_roundtrip_of_odd_lines(spark):
    log = _log(spark, 2)
    assert audit.from_lines(audit.to_lines(log)).exceptAll(log).count() == 0
    line = audit.to_lines(log).first()["value"]
    assert line == canonical(log.first().asDict())
    odd = [line.replace('"seq":', '"seq": '), line.replace('"ts":"t"', '"ts":5'), line.replace('"guarded":0', '"guarded":4294967296'), "[" * 100000]
    assert audit.from_lines(spark.createDataFrame([(x,) for x in odd], "value string")).where("hash IS NULL").count() == 4


def test_texts_go_through_workers_in_slices(spark):
    """However many rows Spark sends at once (redact_documents, detect_*, chunks_*)."""
    f = text._sliced(lambda t: [(t, len(t))] if t else None, "array<struct<a:string,n:int>>")
    got = list(getattr(f, "func", f).__call__(iter([pa.array(["x"] * 300), pa.array(["yy", None], pa.string()), pa.array([], pa.string())])))
    assert [len(g) for g in got] == [128, 128, 44, 2, 0] and got[3].to_pylist() == [[{"a": "yy", "n": 2}], None]
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"a{i}@x.org and b@y.org" if i % 3 else "none") for i in range(400)], "i long, t string")
    out = rows.select("i", "t", text.anonymize(F.col("t"), {"categories": ["email"]}).alias("a"), text.transform(F.col("t"), {"categories": ["email"]}).alias("b")).collect()
    assert len(out) == 400
    for r in out:
        want = None if r["t"] is None else "[REDACTED] and [REDACTED]" if "@" in r["t"] else r["t"]
        assert (r["a"] and r["a"]["text"]) == (r["b"] and r["b"]["text"]) == want
        assert r["t"] is None or [m["value"] for m in r["a"]["matches"]] == [r["t"][s["start"] : s["end"]] for s in r["b"]["spans"]]
