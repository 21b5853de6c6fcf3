import hashlib
import random
import re

from cloakspark.llm import pii

LABEL = "[A-Za-z0-9-]+"
EMAIL = re.compile(rf"[{pii.LOCAL}]+@{LABEL}(\.{LABEL})+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
KINDS = ["email", "ip", "card", "phone", "iban"]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def check(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "iban":
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    return True


def brute(text):
    text = text or ""
    found = []
    for i, (kind, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN))):
        found += [(m.start(), i, m.end(), kind) for m in p.finditer(text) if check(kind, m.group())]
    say = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(xs))
    base = [x for x in found if x[3] != "iban"]
    return (*[sum(x[3] == k for x in found) for k in KINDS], hashlib.sha256(say(base).encode()).hexdigest(), say(found))


def same(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, found int, kind int")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        r = got[i]
        assert (*[r[f"n_{k}"] for k in KINDS], r["base_sha256"], r["spans"]) == brute(t), t


def test_random_strings_and_edges(spark):
    rng = random.Random(4)
    parts = ["a", "@", ".", "%", "-", "b.co", "x@y.zz", "1", "2.3", "4.5.6.7", "+", " ", "(", ")", "4111 1111 1111 1111", "378282246310005", "+44 20 7946 0958", "é", "😀", "DE89370400440532013000", "GB82WEST12345698765432", "255.1.2.003", "256.1.1.1", "\n", "0000"]
    same(spark, [None, "", "a@b.co%x@d.e", "a@b c@d.ef.", "9.2.3.4.5.6.1.8", *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(1500))])


def test_long_texts_take_linear_time(spark):
    parts = ["a", "1", "1.2.", "+1 ", "AB12", "a@b.co ", "7 "]
    same(spark, [p * 700 for p in parts])
    df = spark.createDataFrame([(i, p * 60_000) for i, p in enumerate(parts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    assert got[5]["n_email"] == 60_000 and got[0]["spans"] == ""


def test_empty_table_and_null_id(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pii.find(spark.createDataFrame([(None, "x@y.zz")], "doc_id long, text string")).first()["doc_id"] is None


def test_context_words_raise_the_score(spark):
    df = spark.createDataFrame([(1, "contact: x@y.zz"), (2, "lorem x@y.zz")], "doc_id long, text string")
    a, b = (r["found"][0]["score"] for r in pii.find(df).orderBy("doc_id").collect())
    assert a > b


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    same(spark, [r["text"] for r in rows])
