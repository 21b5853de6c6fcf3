"""What must not get out or lost: texts with null scopes, repeated keys, logs, tails of streams, long numbers, tool calls."""

import datetime
import decimal
import gzip
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cloakspark import errors
from cloakspark.functions.json_tools import Sanitizer
from cloakspark.operators import audit, guard, json_text, records, vault
from cloakspark.plans.spec import compile_pipeline
from cloakspark.streaming import chunks


# Tokens of scopes


def test_scopes_with_nulls_and_repeated_orders(spark):
    rows = [
        (None, 0, "mail b@x.org"), (2, None, "mail c@x.org"), (None, None, "mail b@x.org and d@x.org"), (2, None, "to c@x.org"),
        (1, 5, "to a@x.org"), (1, 5, "to eeeeee@x.org"), (1, 5, "to a@x.org"), (1, 5, "nothing"), (1, 5, None), (3, 1, ""),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv long, turn long, text string, token int").repartition(3)
    done, mapping = vault.tokenize_scopes(df, "text", "conv", order=["turn"], categories=["email"])
    assert done.columns == df.columns
    got = {r["token"]: r["text"] for r in done.collect()}
    assert len(got) == len(rows) and not any("@" in (t or "") for t in got.values())
    assert got[0] == "mail [EMAIL_0002]" or got[0] == "mail [EMAIL_0001]"
    assert got[1] == "mail [EMAIL_0001]" and got[3] == "to [EMAIL_0001]" and got[4] == got[6] != got[5] and (got[7], got[8], got[9]) == ("nothing", None, "")
    back = vault.restore_scopes(done, "text", mapping, "conv", order=["turn"])
    assert {r["token"]: r["text"] for r in back.collect()} == {i: r[2] for i, r in enumerate(rows)}
    assert {r["token"]: r["restored"] for r in back.collect()} == {i: (r[2] or "").count("@") for i, r in enumerate(rows)}


def test_more_tokens_for_scopes_that_have_some(spark):
    kind = "conv long, category string, value string, start int"
    first = vault.number_tokens(spark.createDataFrame([(None, "email", "a@x.org", 0), (1, "email", "a@x.org", 0)], kind), "conv", order=["start"])
    more = vault.number_tokens(spark.createDataFrame([(None, "email", "a@x.org", 0), (None, "email", "b@x.org", 3)], kind), "conv", order=["start"], existing=first)
    assert sorted((str(r["conv"]), r["value"], r["token"]) for r in more.collect()) == [("1", "a@x.org", "[EMAIL_0001]"), ("None", "a@x.org", "[EMAIL_0001]"), ("None", "b@x.org", "[EMAIL_0002]")]


def test_ambiguous_tokens_stay(spark):
    mapping = spark.createDataFrame([(1, "[EMAIL_0001]", "a"), (1, "[EMAIL_0001]", "b"), (1, "[EMAIL_0002]", "c")], "conv long, token string, value string")
    r = vault.restore_scopes(spark.createDataFrame([(1, 0, "[EMAIL_0001] [EMAIL_0002] [EMAIL_0009]")], "conv long, turn long, text string"), "text", mapping, "conv", order=["turn"]).first()
    assert (r["text"], r["restored"], r["unresolved"]) == ("[EMAIL_0001] c [EMAIL_0009]", 1, ["[EMAIL_0001]", "[EMAIL_0009]"])


# Messages as JSON

MESSAGE = {
    "role": "assistant", "name": "x@x.org", "content": [{"type": "text", "text": "write to a@x.org"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64,YUB4Lm9yZw=="}}, {"type": "thinking", "signature": "s@x.org", "text": "b@x.org"}],
    "tool_calls": [{"id": "c@x.org", "type": "function", "function": {"name": "send", "arguments": json.dumps({"to": "a@x.org", "a@x.org": 1, "card": 4111111111111111, "n": 7})}}],
    "function_call": {"name": "f", "arguments": "not json d@x.org"}, "note": {"deep": ["e@x.org", 1.50]},
}


def test_chat_messages_round_trip(spark):
    rows = [(1, 0, json.dumps(MESSAGE)), (1, 1, json.dumps({"role": "user", "content": 'said "a@x.org"'})), (None, 0, json.dumps({"role": "user", "content": "z@x.org"})), (1, 2, "not JSON a@x.org"), (1, 3, '{"content":"a@x.org","content":"x"}'), (1, 4, None), (1, 5, '{"role":"user","content":"nothing here"}')]
    df = spark.createDataFrame(rows, "conv long, turn long, m string")
    done, mapping = guard.sanitize_chat(df, "conv", "turn", "m")
    got = {(r["conv"], r["turn"]): r["m"] for r in done.collect()}
    assert got[1, 2] is None and got[1, 3] is None and got[1, 4] is None and got[1, 5] == rows[-1][2]
    m = json.loads(got[1, 0])
    kept = {"x@x.org", "s@x.org", "c@x.org"}
    assert {w for w in kept if w in got[1, 0]} == kept and not any(w in got[1, 0] for w in ("a@x.org", "b@x.org", "d@x.org", "e@x.org", "4111111111111111"))
    assert m["content"][1] == MESSAGE["content"][1] and m["tool_calls"][0]["function"]["name"] == "send" and "1.5" in got[1, 0] and "@" not in got[None, 0]
    token = m["content"][0]["text"].split()[-1]
    assert json.loads(got[1, 1])["content"] == f'said "{token}"' and token in json.loads(m["tool_calls"][0]["function"]["arguments"])
    back = {(r["conv"], r["turn"]): r["m"] for r in guard.restore_chat(done, "conv", "turn", "m", mapping).collect()}
    for c, t, text in rows:
        if got[c, t] is not None:
            want, have = json.loads(text), json.loads(back[c, t])
            for x in (want, have):
                for call in x.get("tool_calls", []):
                    call["function"]["arguments"] = {k: str(v) for k, v in json.loads(call["function"]["arguments"]).items()}
            assert have == want


def test_values_with_quotes_restore_to_json(spark):
    mapping = spark.createDataFrame([("[NAME_0001]", 'Jo "J" O\\'), ("[NAME_0002]", "x\ny")], "token string, value string")
    df = spark.createDataFrame([('{"a":"[NAME_0001]","[NAME_0002]":[1.0,"[NAME_0003]"]}',), ("plain [NAME_0001]",), ('{"a": 1}',)], "j string")
    got = [r["j"] for r in guard.restore_json(df.coalesce(1), "j", mapping).collect()]
    assert {json.dumps(json.loads(g)) if g.startswith("{") else g for g in got} == {json.dumps({"a": 'Jo "J" O\\', "x\ny": [1.0, "[NAME_0003]"]}), 'plain Jo "J" O\\', '{"a": 1}'}


# JSON, objects, bodies


def test_repeated_keys_are_refused(spark):
    df = spark.createDataFrame([('{"a":"u@x.org","a":"clean"}',), ('{"b":{"a":1,"a":"u@x.org"}}',)], "t string")
    for r in df.select(json_text.sanitize(F.col("t")).alias("s"), json_text.sanitize(F.col("t"), fallback_to_text=True).alias("x")).collect():
        assert (r["s"]["json"], r["s"]["error"]) == (None, "not JSON") and "u@x.org" not in r["x"]["json"]


def test_key_patterns_paths_and_digits():
    p = compile_pipeline({"categories": ["email", "credit-card"]})
    s = Sanitizer(p, key_patterns={"^(pin|cvv)": "pin"}, skip_paths=["/keep/*/x"], number_digits=0)
    assert s.run('{"PIN2":"1","keep":[{"x":"u@x.org","y":"u@x.org"}],"n":4111111111111111}')[0] == '{"PIN2":"[REDACTED]","keep":[{"x":"u@x.org","y":"[REDACTED]"}],"n":4111111111111111}'
    assert "4111" not in Sanitizer(p).run('{"n":4111111111111111}')[0]
    with pytest.raises(errors.ValidationError):
        Sanitizer(p, key_patterns={"(": "x"})


def test_objects_keep_all_but_texts(spark):
    when, day = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), datetime.date(1990, 5, 12)
    kind = "n long, o struct<n:long,t:string,d:decimal(30,10),b:binary,at:timestamp,day:date,f:double,l:array<struct<x:string,k:long>>,m:map<string,string>,ok:boolean,none:string>"
    row = (4111111111111111, (4111111111111111, "mail a@x.org", decimal.Decimal("12345678901234567890.0123456789"), b"a@x.org", when, day, 1e300, [("b@x.org", 4111111111111111), (None, 1)], {"c@x.org": "d@x.org"}, True, None))
    got = records.anonymize_object(spark.createDataFrame([row, (1, None)], kind), {"categories": ["email", "credit-card"]}).collect()
    o = got[0]["o"]
    assert (got[0]["n"], o["n"], o["t"], o["d"], bytes(o["b"]), o["at"], o["day"], o["f"], o["ok"], o["none"]) == (4111111111111111, 4111111111111111, "mail [REDACTED]", row[1][2], b"a@x.org", when, day, 1e300, True, None)
    assert [tuple(x) for x in o["l"]] == [("[REDACTED]", 4111111111111111), (None, 1)] and o["m"] == {"c@x.org": "[REDACTED]"} and got[1]["o"] is None


def test_events_over_the_limit_say_so(spark):
    df = spark.createDataFrame([("data: u@x.org\n\ndata: " + "x" * 50 + "\n\n",)], "b string")
    assert df.select(json_text.sanitize_events(F.col("b"), limit=40)).first()[0] == "data: [REDACTED]\n\nevent: error\ndata: withheld: an event of more than 40 characters\n\n"
    assert "x" * 50 in df.select(json_text.sanitize_events(F.col("b"))).first()[0]
    bad = spark.createDataFrame([("application/json", "{u@x.org"), ("image/png", "raw"), ("text/html", None)], "c string, b string").coalesce(1)
    assert [r[0] and tuple(r[0]) for r in bad.select(json_text.sanitize_body(F.col("c"), F.col("b"))).collect()] == [(None, "not JSON"), ("raw", None), None]


def test_bodies_as_bytes(spark):
    raw = zlib.compressobj(wbits=-15)
    rows = [
        ("text/plain; charset=latin-1", None, "é".encode("latin-1"), "é", None), ("text/plain", "gzip", gzip.compress("ü".encode()), "ü", None), ("text/plain", "deflate", zlib.compress(b"a"), "a", None),
        ("text/plain", "deflate", raw.compress(b"b") + raw.flush(), "b", None), ("text/plain", "identity, gzip", gzip.compress(b"c"), "c", None), ("text/plain", None, b"\xff", None, "not in its charset"), ("x; charset=moon", None, b"a", None, "unknown charset"),
        ("text/plain", "br", b"a", None, "unknown encoding"), ("text/plain", "gzip", gzip.compress(b"x" * 9999), None, "too long"), ("text/plain", "gzip", b"junk", None, "not gzip"), ("text/plain", "gzip", gzip.compress(b"whole")[:-9], None, "not gzip"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "c string, e string, b binary").coalesce(1)
    assert [tuple(r[0]) for r in df.select(json_text.decode_body(F.col("c"), F.col("e"), F.col("b"), limit=1000)).collect()] == [r[3:] for r in rows]


# Audit


def test_logs_are_guarded(spark):
    fields = json.dumps([{"path": "/users/u@x.org/phone", "category": "phone", "detector": "phone", "rule": "redact", "count": 1}, {"path": "/a~1b", "category": "4111 1111 1111 1111", "count": 0}])
    attributes = json.dumps({"note": "call bob@x.org", "carol@x.org": "x", "card": 4111111111111111, "ms": 12, "ok": True, "deep": {"list": ["203.0.113.57"]}})
    rows = [("c", 0, "t", "anonymize", "u@x.org", "from 203.0.113.57", fields, attributes, '{"id":"gdpr","version":"for 123-45-6789","digest":"u"}', json.dumps({"input": "a" * 64, "output": "B" * 64}))]
    rows += [("c", 1, "t", "op", "me", "s", "not JSON u@x.org", '{"a":"u@x.org","a":1}', None, None), ("c", 2, "t", "op", "me", "s", "[]", '{"a": 1.50}', None, None)]
    e = spark.createDataFrame(rows, "chain_id string, seq long, ts string, operation string, actor string, source string, fields string, attributes string, policy string, checksums string")
    got = audit.seal(e, b"k").orderBy("seq").collect()
    said = str(got)
    assert not any(x in said for x in ("u@x", "bob", "carol", "203.0.113", "123-45", "4111", "B" * 64))
    assert [r["guarded"] for r in got] == [2 + 2 + 4 + 2 + 1, 2, 0] and got[2]["attributes"] == '{"a": 1.50}'
    assert json.loads(got[0]["fields"])[0]["path"] == "/users/*/phone" and json.loads(got[0]["checksums"]) == {"input": "a" * 64, "output": audit.GUARDED}
    assert json.loads(got[0]["attributes"]) == {"note": "[GUARDED]", "[GUARDED]": "x", "card": "[GUARDED]", "ms": 12, "ok": True, "deep": {"list": ["[GUARDED]"]}}
    sealed = spark.createDataFrame(got, audit.S.AUDIT)
    assert audit.verify(sealed, b"k").first()["ok"]


def test_chains_with_all_kinds_of_faults(spark):
    rows = [("c", i, "t", "op", "u", "s", "[]", "{}") for i in range(9)] + [("d", 0, "t", "op", "u", "s", "[]", "{}")]
    a = audit.seal(spark.createDataFrame(rows, "chain_id string, seq long, ts string, operation string, actor string, source string, fields string, attributes string"))
    a = spark.createDataFrame(a.collect(), a.schema)
    check = lambda x: next((r["records"], r["ok"], r["index"], r["reason"]) for r in audit.verify(x).collect() if r["chain_id"] == "c")
    only = a.where("chain_id = 'c'")
    assert check(a) == (9, True, None, None)
    assert check(a.where("seq > 0 OR chain_id = 'd'")) == (8, False, 0, "bad-seq")
    assert check(a.where("seq NOT IN (3, 4, 7)")) == (6, False, 3, "bad-seq")
    assert check(a.union(only.where("seq = 4"))) == (10, False, 5, "bad-seq")
    assert check(a.withColumn("prev", F.when(F.col("seq") == 5, "0" * 64).otherwise(F.col("prev")))) == (9, False, 5, "bad-prev")
    assert check(a.withColumn("hash", F.when(F.col("seq") == 5, None).otherwise(F.col("hash")))) == (9, False, 5, "bad-hash")
    assert check(a.withColumn("seq", F.when(F.col("seq") == 8, -1).otherwise(F.col("seq")))) == (9, False, 0, "bad-seq")
    assert {r["chain_id"]: r["ok"] for r in audit.verify(a.where("seq < 5")).collect()} == {"c": True, "d": True}


def test_sink_reads_heads_and_not_the_history(spark, tmp_path):
    path = str(tmp_path / "log")
    write = audit.append_batches(path, b"k")
    kind = "chain_id string, seq long, ts string, operation string, actor string, source string, fields string, attributes string"
    for batch in range(5):
        write(spark.createDataFrame([(c, batch, "t", "op", "u", "s", "[]", "{}") for c in (("a", "b") if batch != 2 else ("a",))], kind), batch)
        if batch == 3:
            write(spark.createDataFrame([(c, batch, "t", "op", "u", "s", "[]", "{}") for c in ("a", "b")], kind), batch)  # again
    log = spark.read.option("basePath", path).parquet(path)
    assert {(r["chain_id"], r["records"], r["ok"]) for r in audit.verify(log, b"k").collect()} == {("a", 5, True), ("b", 4, True)}
    assert sorted(p.name for p in (tmp_path / "log_heads").glob("batch=*")) == ["batch=3", "batch=4"]
    for n in range(4):  # the history isn't needed
        for p in (tmp_path / "log" / f"batch={n}").glob("*"):
            p.unlink()
    write(spark.createDataFrame([("b", 9, "t", "op", "u", "s", "[]", "{}")], kind), 5)
    assert spark.read.parquet(f"{path}/batch=5").first()["seq"] == 4


# Streams


def test_no_tail_is_lost(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["mail u@x.org", "words of no interest", "203.0.113.57"]) for _ in range(60))
    rows, whole = [], {}
    for i in range(7):
        own = text[: 200 + 97 * i]
        parts = [own[a : a + 41] for a in range(0, len(own), 41)]
        whole[f"s{i}"] = own
        rows += [(f"s{i}", n, p, i % 2 == 0 and n == len(parts) - 1) for n, p in enumerate(parts)]
        rows += [(f"s{i}", 2, "a second time", False)] if i > 3 else []
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[2] == "a second time")
    spec = {"categories": ["email", "ipv4"]}
    df = spark.createDataFrame(rows, "stream_id string, seq long, chunk string, final boolean").dropDuplicates(["stream_id", "seq", "chunk"])
    first = df.where("chunk <> 'a second time'")
    p = compile_pipeline(spec)
    for parts in (1, 3):
        got = {}
        for r in sorted(chunks.transform_chunks(first.repartition(parts), spec).collect(), key=lambda r: r["seq"]):
            got[r["stream_id"]] = got.get(r["stream_id"], "") + r["text"]
        assert got == {k: p.transform(v)[0] for k, v in whole.items()}
    lengths = {r["stream_id"]: r["n"] for r in chunks.transform_chunks(df, {"categories": ["vin"]}).groupBy("stream_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert set(lengths) == set(whole)


def test_streams_time_out(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    spark.createDataFrame([("s", 0, "mail u@x.org and", False), ("s", 2, " after a gap u@x.org", False)], "stream_id string, seq long, chunk string, final boolean").coalesce(1).write.json(str(src))
    df = spark.readStream.schema("stream_id string, seq long, chunk string, final boolean").json(str(src))
    q = chunks.transform_chunks(df, {"categories": ["email"]}, timeout=500).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            q.awaitTermination(0.5)
            try:
                rows = spark.read.schema(chunks.OUT).parquet(out).collect()
            except Exception:  # noqa: BLE001 - nothing is written yet
                rows = []
            if rows:
                break
    finally:
        q.stop()
    assert "".join(r["text"] for r in rows) == "mail [REDACTED] and after a gap [REDACTED]" and rows[-1]["final"]
