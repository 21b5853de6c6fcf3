import importlib.util
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cloakspark import errors
from cloakspark.functions import json_tools, strategies
from cloakspark.functions import tokens as tk
from cloakspark.operators import audit, json_text, records, text, vault
from cloakspark.plans import policy, presets
from cloakspark.plans.spec import Legacy, compile_pipeline, with_context
from cloakspark.sources import files
from cloakspark.streaming import chunks


def test_strategies_as_columns_and_in_python_agree(spark):
    values = ["", "Ab9-ß x", "12345", "-7", " 42 ", "1e2", "no", "0x1F", "0b11", "0o17", "1d", "NaN", "Infinity", "\t5\n", ".5", "5.", "+7", "😀é Ǆ", "Customer#1"]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string").coalesce(1)
    v = F.col("v")
    pairs = [
        (strategies.mask_column(v, "#", 1, 2), lambda x: strategies.mask(x, "#", 1, 2)),
        (strategies.mask_column(v, keep_leading=1, preserve_format=True), lambda x: strategies.mask(x, keep_leading=1, preserve_format=True)),
        (strategies.pseudonymize_column(v, seed="s"), lambda x: strategies.pseudonymize(x, seed="s")),
        (strategies.hash_column(v, "p", 20), lambda x: strategies.hashed(x, "p", 20)),
        (strategies.generalize_column(v), strategies.generalize),
        (strategies.redact_column(v), strategies.redact),
    ]
    for column, f in pairs:
        assert [r["c"] for r in df.select(column.alias("c")).collect()] == [*map(f, values), None]


def test_known_values():
    assert strategies.generalize("-1") == "-10--1" and strategies.generalize("0x1f") == "30-39" and strategies.generalize("") == "0-9" and strategies.generalize("x") == "x"
    assert strategies.mask("abc", keep_leading=2, keep_trailing=1) == "***"
    assert strategies.synthesize("a", "name") == strategies.synthesize("a", "name") != strategies.synthesize("b", "name")
    assert strategies.replacer({"strategy": "generalize"})("123456", "ssn") == "[REDACTED]" and strategies.replacer({"strategy": "generalize"})("42", "ssn") == "40-49"
    assert strategies.replacer({"strategy": "mask", "keep_leading": 9, "preserve_format": True})("ab", "x") == "[REDACTED]"


@pytest.mark.parametrize("spec", [{"nonsense": 1}, {"detection": "x"}, {"rules": {"a": 1}}, {"patterns": [{"category": "a", "source": "("}]}, {"patterns": [{"category": "", "source": "a"}]}, {"default_strategy": {"strategy": "mask", "mask_char": "ab"}}, {"default_strategy": {"strategy": "encrypt"}}, {"preset": "moon"}, {"categories": ["moon"]}])
def test_wrong_specifications_are_refused_at_once(spec):
    with pytest.raises(errors.CloakError):
        compile_pipeline(spec)


def test_context_and_allow_rules():
    d = compile_pipeline({"categories": ["vin"], "patterns": [{"category": "n", "source": r"\d{4}", "confidence": 0.5, "context": {"keywords": ["pin code"], "window": 2}}]})
    assert [round(s[3], 2) for s in d.scan("pin code 1234 and then some more words 5678")] == [0.65, 0.5]
    with pytest.raises(errors.ValidationError):
        with_context(d.detectors[0], [])
    p = compile_pipeline({"categories": ["email"], "allow": ["A@b.co", {"pattern": "@ok"}]})
    assert p.transform("a@b.co x@ok.org c@d.org")[0] == "a@b.co x@ok.org [REDACTED]"
    assert p.transform(p.transform("c@d.org")[0])[0] == "[REDACTED]"


def test_first_generation_options():
    assert Legacy({"preset": ["hipaa"], "categories": ["vin"]}).categories == presets.PRESETS["hipaa"][0]
    run = lambda t, **o: Legacy({"categories": ["email"], **o}).anonymize(t)[0]
    assert run("a@b.co, A@B.co, c@d.co", consistent_tokens=True) == "EMAIL_2, EMAIL_2, EMAIL_1"
    assert run("a@b.co id-7", custom_patterns=[{"pattern": r"id-\d", "label": "<ID>"}]) == "[REDACTED] <ID>"
    assert Legacy({"rules": {"email": {"strategy": "hash", "pepper": "p"}}}).anonymize("a@b.co")[0].startswith("hsh_")
    with pytest.raises(errors.ValidationError):
        Legacy({"global_replacement": " "})


def test_errors_withhold_the_text(spark):
    def broken(t):
        raise RuntimeError

    df = spark.createDataFrame([("a@b.co",), (None,)], "t string").coalesce(1)
    rows = [r["x"] for r in df.select(text.anonymize(F.col("t"), {"categories": ["email"]}, detectors={"email": broken}).alias("x")).collect()]
    assert rows[0]["text"] is None and rows[0]["error"] == "RuntimeError" and rows[1] is None


def test_custom_detectors_and_validators(spark):
    own = {"email": lambda t: [("email", t[:2], 0, 2, 0.5)] if t else []}
    df = spark.createDataFrame([("abcd",)], "t string")
    assert df.select(text.detect(F.col("t"), ["email"], detectors=own)).first()[0][0]["value"] == "ab"
    assert df.select(text.anonymize(F.col("t"), {"categories": ["email"]}, detectors=own, validators={"email": [lambda v: False]})["text"]).first()[0] == "abcd"


def test_transform_distinct_and_sql(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (2, "a@b.co"), (3, None)], "i int, t string")
    assert [r["transformed"] and r["transformed"]["text"] for r in text.transform_distinct(df, "t").orderBy("i").collect()] == ["[REDACTED]", "[REDACTED]", None]
    text.register(spark)
    assert spark.sql("SELECT start, category FROM cloak_spans('x a@b.co')").first() == (2, "email")


# JSON and records


def test_json_sanitizer():
    run = lambda s, **o: json_tools.Sanitizer(compile_pipeline({"categories": ["email", "credit-card"]}), **o).run(s)
    same = '{ "a": 1.50, "b": [1e400, -0, "x"] }'
    assert run(same)[0] is same
    assert run('{"n":4111111111111111,"z":10000000000000000000001}')[0] == '{"n":"[REDACTED]","z":10000000000000000000001}'
    assert run('{"S":{"a":[1,true,"x"]}}', key_rules={"s": "c"})[0] == '{"S":{"a":["[REDACTED]","[REDACTED]","[REDACTED]"]}}'
    assert run('{"k":"a@b.co"}', skip_keys=["K"])[0::4] == ('{"k":"a@b.co"}', ["/k"])
    assert run('{"j":"{\\"m\\":\\"a@b.co\\"}"}', json_string_keys=["j"])[0] == '{"j":"{\\"m\\":\\"[REDACTED]\\"}"}'
    assert run('{"a@b.co":1,"c@d.co":2}', keys="replace")[0] == '{"[REDACTED]":1,"[REDACTED]#2":2}'
    assert run('{"a@b.co":1}', keys="flag")[3] == ["/a@b.co"]
    with pytest.raises(errors.ValidationError):
        run("[" * 600 + "]" * 600)
    assert json_tools.pointer(["a/b", "c~d", 0]) == "/a~1b/c~0d/0"
    assert json_tools.canonical({"b": -0.0, "a": [1e21, 0.1]}) == '{"a":[1e+21,0.1],"b":0}'


def test_json_columns(spark):
    df = spark.createDataFrame([('{"a":"x@y.zz"}',), ("not json x@y.zz",), (None,)], "t string").coalesce(1)
    a = [r["s"] for r in df.select(json_text.sanitize(F.col("t")).alias("s")).collect()]
    assert (a[0]["json"], a[1]["json"], a[1]["error"], a[2]) == ('{"a":"[REDACTED]"}', None, "not JSON", None)
    b = [r["s"] for r in df.select(json_text.sanitize(F.col("t"), fallback_to_text=True).alias("s")).collect()]
    assert b[1]["json"] == "not json [REDACTED]"
    long = spark.createDataFrame([("text/plain", "x" * 50)], "c string, b string").select(json_text.sanitize_body(F.col("c"), F.col("b"), limit=10).alias("x"))
    assert tuple(long.first()["x"]) == (None, "too long")


def test_records(spark):
    df = spark.sql("SELECT named_struct('u', named_struct('m', 'x@y.zz', 'n', 5), 'l', array('x@y.zz')) AS r, 'x@y.zz' AS t, 1 AS i")
    out = records.anonymize_record(df, {"r.u.m": {"strategy": "redact"}, "i": {"strategy": "generalize"}, "r.l": {"strategy": "redact"}, "r.none.x": {"strategy": "redact"}}).first()
    assert out["r"]["u"]["m"] == "[REDACTED]" and out["i"] == "0-9" and out["r"]["l"] == ["x@y.zz"]
    whole = records.anonymize_object(df).first()
    assert whole["r"]["l"] == ["[REDACTED]"] and whole["r"]["u"]["n"] == 5 and whole["t"] == "[REDACTED]"
    upper = records.map_texts(df, F.upper).first()
    assert upper["r"]["l"] == ["X@Y.ZZ"] and upper["r"]["u"]["m"] == "X@Y.ZZ"


# Tokens


def test_row_local_tokens():
    t, mapping, _ = tk.tokenize("a@b.co c@d.co A@b.co", ["email"])
    assert t == "[EMAIL_0001] [EMAIL_0002] [EMAIL_0001]" and mapping["[EMAIL_0001]"] == "A@b.co"
    for shape in tk.SHAPES:
        t, mapping, _ = tk.tokenize("a@b.co c@d.co", ["email"], shape)
        assert tk.restore(t, mapping) == ("a@b.co c@d.co", 2, [])
    assert tk.restore("[EMAIL_0009]", {}) == ("[EMAIL_0009]", 0, ["[EMAIL_0009]"])
    assert tk.restore(r"\[email\_0001\] <EMAIL_1>", {"[EMAIL_0001]": "v", "<EMAIL_1>": "w"}, lenient=True)[0] == "v w"
    assert tk.prefix_of("my own!") == "MY_OWN" and tk.prefix_of("9") == "X_9" and tk.prefix_of("é").startswith("X")


def test_sessions():
    s = tk.Session(tag="T1")
    p = compile_pipeline({"categories": ["email"], "default_strategy": {"strategy": "tokenize"}}, s)
    out = p.transform("a@b.co c@d.co a@b.co")[0]
    assert out == "[EMAIL_T1_0001] [EMAIL_T1_0002] [EMAIL_T1_0001]" and s.restore(out)[0] == "a@b.co c@d.co a@b.co"
    assert s.forget("[EMAIL_T1_0002]")
    again = tk.Session(snapshot=json.loads(json.dumps(s.snapshot())))
    assert again("e@f.co", "email") == "[EMAIL_T1_0003]" and again("a@b.co", "email") == "[EMAIL_T1_0001]"


def test_scopes_round_trip(spark):
    rows = [(1, 0, "a@b.co and c@d.co"), (1, 1, "c@d.co [EMAIL_0042]"), (2, 0, "c@d.co"), (2, 1, None), (3, 0, "none")]
    df = spark.createDataFrame(rows, "s long, n long, t string")
    done, mapping = vault.tokenize_scopes(df, "t", "s", order=["n"], categories=["email"])
    assert {(r["s"], r["value"], r["token"]) for r in mapping.collect()} == {(1, "a@b.co", "[EMAIL_0001]"), (1, "c@d.co", "[EMAIL_0002]"), (2, "c@d.co", "[EMAIL_0001]")}
    back = {(r["s"], r["n"]): r for r in vault.restore_scopes(done, "t", mapping, "s", order=["n"]).collect()}
    assert [back[k]["t"] for k in ((1, 0), (1, 1), (2, 0), (2, 1), (3, 0))] == [r[2] for r in rows] and back[1, 1]["unresolved"] == ["[EMAIL_0042]"]
    more = spark.createDataFrame([(1, "email", "z@z.co", 9), (1, "email", "a@b.co", 8)], "s long, category string, value string, n int")
    new = vault.number_tokens(more, "s", order=["n"], existing=mapping)
    assert {r["token"] for r in new.where("value = 'z@z.co'").collect()} == {"[EMAIL_0003]"} and new.count() == 4


def test_numbering_of_own_categories(spark):
    df = spark.createDataFrame([(1, "my own!", "a", 0), (1, "9", "b", 1), (1, "é", "c", 2)], "s long, category string, value string, n int")
    assert {r["token"] for r in vault.number_tokens(df, "s", order=["n"]).collect()} == {"[MY_OWN_0001]", "[X_9_0001]", "[X_0001]"}


def test_vault(spark):
    ring = tk.KeyRing("t", material=b"k" * 32)
    df = spark.createDataFrame([("Ann", "s1"), ("Bob", "s1"), ("Bob", "s2"), (None, "s3")], "v string, s string")
    v = vault.vault_rows(df, "v", "name", ring, subject_col="s", now=5, ttl=10)
    assert {r["value"] for r in vault.get(v, ring, now=6).collect()} == {"Ann", "Bob"} and vault.get(v, ring, now=99).count() == 0
    assert vault.put_if_absent(v, v).count() == 2
    left = vault.forget_subject(v, ring, "s1").collect()
    assert len(left) == 1 and len(left[0]["subjects"]) == 1
    one = v.first()["token"]
    assert vault.forget_token(v, one).count() == 1
    ring.rotate(b"n" * 32)
    assert {r["key_id"] for r in vault.rewrap(v, ring).collect()} == {"k2"}
    assert vault.get(vault.rewrap(v, ring), ring).count() == 2
    fixed = spark.createDataFrame(v.collect(), v.schema)
    assert vault.replace(fixed, fixed.limit(1), fixed.withColumn("created_at", F.lit(77).cast("long"))).where("created_at = 77").count() == 1
    with pytest.raises(errors.VaultError):
        vault.shred_key(v, ring, "k2")
    assert vault.shred_key(v, ring, "k1").count() == 0 and vault.get(v, ring).where("value IS NOT NULL").count() == 0


def test_key_ring():
    ring = tk.KeyRing("t", passphrase="long enough", iterations=100_000)
    m = ring.manifest()
    assert ring.check_manifest(m) and not ring.check_manifest(m | {"namespace": "u"})
    with pytest.raises(errors.KeyManagementError):
        ring.destroy("k1")
    with pytest.raises(errors.KeyManagementError):
        tk.KeyRing("t", passphrase="x", iterations=1)
    assert ring.derive("a") != ring.derive("b") and len(tk.generate_key_material()) == 32


def test_keyed_and_sealed(spark):
    ring = tk.KeyRing("t", material=b"k" * 32)
    df = spark.createDataFrame([("Ann",), ("x" * 300,), (None,)], "v string").coalesce(1)
    rows = df.select("v", vault.keyed_tokens(F.col("v"), "name", ring).alias("k"), vault.seal_tokens(F.col("v"), "name", ring).alias("s")).withColumn("o", vault.open_tokens(F.col("s"), "name", ring)).collect()
    assert tk.KEYED_TOKEN.fullmatch(rows[0]["k"]) and tk.SEALED_TOKEN.fullmatch(rows[0]["s"]) and rows[0]["o"] == "Ann"
    assert rows[1]["s"] is None and rows[2]["k"] is None


# Compliance and audit


def test_presets_and_policies():
    assert presets.combine("gdpr") == presets.PRESETS["gdpr"]
    assert presets.combine(["pci-dss", "gdpr"])[1] == {"strategy": "redact"}
    assert presets.unmet(presets.traits({"strategy": "hash"}), {"keyed": True, "not_derived": True}) != []
    for name in presets.REGULATIONS:
        assert not [i for i in policy.check(policy.regulation_policy(name)) if i["severity"] == "error"], name
        compile_pipeline(policy.to_spec(policy.parse(policy.regulation_policy(name))))
    with pytest.raises(errors.PolicyError):
        policy.parse({"version": 1, "extends": ["hipaa"], "rules": {"email": {"strategy": "encrypt"}}})
    assert [s["action"] for s in policy.plan_erasure([{"kind": "vault"}, {"kind": "text"}])] == ["forget_subject", "rescan"]
    codes = {i["code"] for i in policy.check({"version": 1, "id": 7, "rules": {"moon": {"strategy": "x"}, "email": {"strategy": "redact", "z": 1}}, "patterns": [{"category": "a", "source": "("}], "categories": {"include": ["mars", "vin"]}})}
    assert {"invalid-type", "unknown-category", "unknown-strategy", "unknown-option", "invalid-pattern", "unused-rule"} <= codes


def _events(spark, n=6):
    rows = [("c", i, "2024-01-01", "op", f"user{i}@x.org" if i == 2 else "u", "s", "[]", '{"a":1}') for i in range(n)]
    return spark.createDataFrame(rows, "chain_id string, seq long, ts string, operation string, actor string, source string, fields string, attributes string")


def test_audit_chain(spark):
    for key in (None, b"secret"):
        a = audit.seal(_events(spark), key, lambda s: "@" in s)
        a = spark.createDataFrame(a.collect(), a.schema)
        head = a.orderBy(F.desc("seq")).limit(1)
        assert audit.verify(a, key, head).first()["ok"] and [r["actor"] for r in a.orderBy("seq").collect()][2] == audit.GUARDED
        for column, bad in (("ts", F.lit("2025")), ("fields", F.lit("[1]")), ("hash", F.lit("0" * 64))):
            r = audit.verify(a.withColumn(column, F.when(F.col("seq") == 3, bad).otherwise(F.col(column))), key).first()
            assert not r["ok"] and r["index"] == 3
        assert audit.verify(a.where("seq < 4"), key, head).first()["reason"] == "head-mismatch"
        assert audit.verify(a.where("seq <> 2"), key).first()["reason"] == "bad-seq"
    with pytest.raises(errors.AuditIntegrityError):
        audit.require_intact(a.where("seq <> 2"), key)
    lines = audit.to_lines(a)
    assert audit.from_lines(lines).exceptAll(a).count() == 0
    assert audit.from_lines(spark.createDataFrame([("{}",), ("",), ("x",)], "value string")).where("hash IS NULL").count() == 2


def test_receipts():
    r = audit.issue_receipt(b"k", "k1", id="1", timestamp="t", output="a" * 64, stats={"email": 2})
    assert audit.verify_receipt(r, b"k", output="a" * 64) is None
    assert audit.verify_receipt(r | {"total": 3}, b"k") == "malformed" and audit.verify_receipt(r | {"id": "2"}, b"k") == "signature" and audit.verify_receipt(r, b"k", output="b" * 64) == "output"


# Files and streams


def test_files(spark, tmp_path):
    assert [files.format_of(p) for p in ("a.txt", "a.jsonl.gz", "b.TSV", "c")] == ["txt", "jsonl", "csv", "txt"]
    csv = '﻿id,"mail"\r\n1,"x@y.zz"\n2,z@y.zz,"a ""b"""\n\n"multi\nline",q@y.zz'
    assert "".join(files.format_csv(f, e) for f, e in files.parse_csv(csv)) == csv
    assert files.scrub_csv_text(csv, lambda v: "*", ["MAIL"]) == '﻿id,"mail"\r\n1,"*"\n2,*,"a ""b"""\n\n"multi\nline",*'
    with pytest.raises(errors.ValidationError):
        files.select_columns(["a"], ["b"])
    (tmp_path / "a.txt").write_text("x@y.zz\nnone\n")
    lines = files.read_lines(spark, str(tmp_path / "a.txt"))
    assert files.found_any(lines) and not files.found_any(lines.where("value = 'none'"))
    assert files.scrub(files.read_whole(spark, str(tmp_path / "a.txt")), "txt").first()["value"] == "[REDACTED]\nnone\n"
    files.write_lines(files.scrub(lines, "txt"), str(tmp_path / "out"), compressed=True)
    assert {r["value"] for r in files.read_lines(spark, str(tmp_path / "out")).collect()} == {"[REDACTED]", "none"}
    files.read_lines(spark, str(tmp_path / "a.txt"))


def _stream(spark, tmp_path, parts):
    kind = "stream_id string, seq long, chunk string, final boolean"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = df.sparkSession.table(name).orderBy("stream_id", "seq").collect()
    out = {}
    for r in rows:
        out[r["stream_id"]] = out.get(r["stream_id"], "") + r["text"]
    return out


def test_streams_of_chunks(spark, tmp_path):
    parts = [[("a", 1, "example.org and ", False), ("b", 0, "plain", True)], [("a", 0, "mail ann@", False)], [("a", 2, "bob@exam", False)], [("a", 3, "ple.org", True)]]
    s = _stream(spark, tmp_path, parts)
    assert _run(chunks.transform_chunks(s), "t1") == {"a": "mail [REDACTED] and [REDACTED]", "b": "plain"}
    assert _run(chunks.tokenize_chunks(s, {"categories": ["email"]}), "t2") == {"a": "mail [EMAIL_0001] and [EMAIL_0002]", "b": "plain"}
    batch = spark.read.schema(s.schema).json(str(tmp_path / "in"))
    assert {r["text"] for r in chunks.transform_chunks(batch).where("final").collect()} == {"mail [REDACTED] and [REDACTED]", "plain"}


def test_restore_stream(spark, tmp_path):
    s = _stream(spark, tmp_path, [[("a", 0, "x [EMA", False)], [("a", 1, "IL_0001] y", True)]])
    assert _run(chunks.restore_chunks(s, {"[EMAIL_0001]": "v"}), "t3") == {"a": "x v y"}


# The registered queries


def _entry():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_queries_against_sql(spark):
    import duckdb

    from cloakspark.plans.queries import QUERIES, SQL

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    con.execute("SET timezone = 'UTC'")
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name in [n for i, n in enumerate(sorted(QUERIES)) if n in SQL and i % 4 == 0]:
        df = QUERIES[name](spark, d)
        columns = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
        sql = con.sql(SQL[name])
        assert sorted(sql.columns) == columns, name
        want = sorted(repr([plain(v) for _, v in sorted(zip(sql.columns, row))]) for row in sql.fetchall())
        assert got == want, name


def test_entry(spark):
    e = _entry()
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """The other queries don't need the subpackage or the pipeline."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['cloakspark.llm'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; assert 'mask_customer' in e.queries() and not [q for q in e.queries() if q.startswith('op')]" % root
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
