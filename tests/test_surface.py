import json

import pytest
from pyspark.sql import functions as F

from cloakspark import errors
from cloakspark.__main__ import main
from cloakspark.operators import audit, guard, json_text
from cloakspark.plans import presets
from cloakspark.plans.plugins import Plugin, Registry


def test_plugins(spark):
    own = Plugin("a", {"badge": lambda t: [("badge", t[2:5], 2, 5, 0.9)] if len(t) > 5 else []}, {"stars": lambda v, c, o: o["char"] * len(v)}, {"badge": lambda v: v != "000"})
    r = Registry().register(own)
    assert r.names() == ["a"] and r.anonymizer({"rules": {"badge": {"strategy": "stars", "char": "*"}}}).anonymize("x B12 y")[0] == "x *** y"
    assert r.anonymizer({"rules": {"badge": {"strategy": "redact"}}}).anonymize("x 000 y")[0] == "x 000 y"
    df = spark.createDataFrame([("x B12 y",)], "t string")
    assert df.select(r.anonymize({"categories": ["badge"]})(F.col("t"))["text"]).first()[0] == "x [REDACTED] y"
    for bad in (own, Plugin("b", {"badge": len}), Plugin("c", {}, {"redact": len}), Plugin("d", {"x": 1}), Plugin(" ")):
        with pytest.raises(errors.ValidationError):
            r.register(bad)
    assert r.unregister("a") and not r.unregister("a")


def test_guard(spark):
    rows = [(1, 0, "system", "keep s@x.org"), (1, 1, "user", "mail a@x.org"), (1, 2, "assistant", "sent to a@x.org"), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, "c long, n long, role string, t string")
    out, mapping = guard.sanitize_messages(df, "c", "n", "t", role_col="role", skip_roles=["system"], categories=["email"])
    got = {(r["c"], r["n"]): r["t"] for r in out.collect()}
    assert got == {(1, 0): "keep s@x.org", (1, 1): "mail [EMAIL_0001]", (1, 2): "sent to [EMAIL_0001]", (2, 0): None}
    back = guard.restore_messages(out, "c", "n", "t", mapping).collect()
    assert {(r["c"], r["n"]): r["t"] for r in back} == {(c, n): t for c, n, _, t in rows}


def test_event_streams(spark):
    body = 'event: x\ndata: {"a":"x@y.zz"}\n\ndata: plain x@y.zz\r\n\r\n'
    df = spark.createDataFrame([("text/event-stream; charset=utf-8", body)], "c string, b string")
    assert df.select(json_text.sanitize_body(F.col("c"), F.col("b"))["text"]).first()[0] == 'event: x\ndata: {"a":"[REDACTED]"}\n\ndata: plain [REDACTED]\r\n\r\n'


def test_audit_sink_continues_chains(spark, tmp_path):
    kind = "chain_id string, seq long, ts string, operation string, actor string, source string, fields string, attributes string"
    write = audit.append_batches(str(tmp_path / "audit"), b"k")
    for b in (0, 1, 1, 2):
        write(spark.createDataFrame([("c", i, "t", "op", "u", "s", "[]", "{}") for i in range(b * 3, b * 3 + 3)], kind), b)
    whole = spark.read.parquet(str(tmp_path / "audit"))
    assert whole.count() == 9 and audit.verify(whole, b"k").first()["ok"]
    assert audit.heads_of(whole).first()["seq"] == 8


def test_dimensions(spark):
    assert presets.categories_frame(spark).count() == 27 and presets.gaps_frame(spark).count() >= 6 and presets.compliance_matrix(spark).count() == 108


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("x@y.zz\nnone\n")
    assert main(["scan", str(tmp_path / "a.txt"), "--json", "--fail-on-found"]) == 1
    assert json.loads(capsys.readouterr().out) == {"tally": {"email": 1}, "total": 1}
    (tmp_path / "a.csv").write_text("id,mail\n1,x@y.zz\n")
    assert main(["scrub", str(tmp_path / "a.csv"), str(tmp_path / "out"), "--columns", "mail"]) == 0
    assert "1,[REDACTED]" in spark.read.text(str(tmp_path / "out"), wholetext=True).first()[0]
    assert main(["scan", str(tmp_path / "a.txt"), "--preset", "moon"]) == 2 and main(["nonsense"]) == 2 and main(["list", "presets"]) == 0
