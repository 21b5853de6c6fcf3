import hashlib
import random

from cloakspark.llm import chat

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string, part int, extra string"


def read(spark, rows):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], EVENTS)
    return {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(df))).collect()}


def turns(r):
    return [(t["role"], t["text"]) for t in r["turns"]]


def test_escapes_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "\\\\e\\h", "### ### ####  </turn></turn>\n", "", "\\", "a:\n### b", "<</turn>", "\\e", "</turn", "😀é"]
    rows = [(1, i, i, "message", role, t) for i, (t, role) in enumerate(zip(texts, ["user", "assistant", "a:\n", "### ", "</turn>", "\\c", "", "assistant", "system", "assistant"]))]
    r = read(spark, rows)[1]
    assert turns(r) == [(x[4], x[5]) for x in rows]
    assert r["loss_texts"] == [x[5] for x in rows if x[4] == "assistant"]
    assert r["formatted"].count("</turn>\n") == len(rows)


def test_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", "He"),
        (1, 1, 3, "delta", None, "o"),
        (1, 1, 2, "delta", None, "ll"),
        (1, 2, 4, "message", "user", "dropped"),
        (1, 1, 5, "regenerate", None, None),
        (1, 1, 6, "delta", None, "Hey"),
        (1, 1, 7, "delta", None, " you"),
        (1, 2, 8, "message", "user", "again"),
        (1, 2, 9, "edit", None, "edited"),
        (1, 2, 10, "delta", None, "!"),
        (2, 0, 0, None, "user", None),
        (2, 0, 0, None, "user", None),
        (None, None, None, "message", None, "x"),
    ]
    got = read(spark, rows)
    assert turns(got[1]) == [("user", "hi"), ("assistant", "Hey you"), ("user", "edited!")]
    assert turns(got[2]) == [("user", ""), ("user", "")]
    assert turns(got[None]) == [("", "x")]
    assert read(spark, []) == {}


def test_many_messages_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 3)
    rows = [(5, i, i, "message", "assistant" if i % 2 else "user", f"t{i}") for i in range(20)]
    r = read(spark, rows)[5]
    assert turns(r) == [(x[4], x[5]) for x in rows] and r["loss_texts"] == [f"t{i}" for i in range(1, 20, 2)]


def test_digests(spark):
    df = spark.createDataFrame([(-7, 0, "user", "a\\"), (-7, 1, "assistant", None), (-7, 2, "assistant", "é😀")], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.read_back(chat.render(chat.fold(chat.as_events(df))))).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (3, sha("user\na\\\nassistant\n\nassistant\né😀\n"), 2, sha("é😀"))


def interpreter(rows):
    """What a sequential reader of the docstring of fold makes of a log: (conversation, turn, message number) to (role, text)."""
    rank = {"message": 0, "regenerate": 1, "edit": 2}
    groups, out = {}, {}
    for c, t, seq, kind, role, text in rows:
        groups.setdefault((c, t), []).append((seq, rank.get(kind, 3), role or "", text or "", kind))
    for key, log in groups.items():
        messages = []
        for seq, _, role, text, kind in sorted(log):
            if kind == "message" or not messages:
                messages.append([])
            messages[-1].append((seq, kind, role, text))
        groups[key] = messages
    for c in {c for c, _ in groups}:
        at = [(t, i, m) for t in sorted(t for k, t in groups if k == c) for i, m in enumerate(groups[c, t])]
        dropped = None
        for t, i, m in at:
            text, alive, again = "", False, None
            for seq, kind, _, x in m:
                if kind == "regenerate":
                    text, alive, again = "", False, seq
                elif kind in ("message", "edit"):
                    text, alive = "", False
                if kind != "regenerate" and (dropped is None or seq > dropped):
                    text, alive = text + x, True
            if alive or dropped is None or (again is not None and again > dropped):
                out[c, t, i] = (next((r for _, _, r, _ in m if r), ""), text)
            if again is not None:
                dropped = again if dropped is None else max(dropped, again)
    return out


def test_fold_against_a_sequential_interpreter(spark):
    rng = random.Random(7)
    rows = []
    for c in range(300):
        for seq in rng.sample(range(40), rng.randint(1, 14)):
            rows.append((c, rng.randrange(4), seq, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant", None]), rng.choice("abcdef") * rng.randint(0, 2)))
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], EVENTS)
    got, n = {}, {}
    for r in sorted(chat.fold(df).collect(), key=lambda r: (r["conv_id"], r["turn"], r["part"])):
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    want = {}
    for (c, t, i), m in sorted(interpreter(rows).items()):
        want.setdefault((c, t), []).append(m)
    assert got == want and any(len(m) > 1 for m in got.values())


def test_a_streamed_log_folds_to_the_table(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "ab", "é😀 \\### </turn>", "x" * 1000, "### </turn>:\n"]
    table = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 9))]
    table += [(50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"), (50, 1, "user", "c"), (50, None, "user", "first"), (None, 2, "assistant", "lost"), (51, 0, "user", "long " * 200_000), (51, 1, "assistant", "\\e" * 200_000)]
    df = spark.createDataFrame([(*r, 0, "k") for r in table], "conv_id long, turn long, role string, text string, row int, kind string")
    say = lambda log: {r["conv_id"]: (turns(r), r["loss_texts"]) for r in chat.read_back(chat.render(chat.fold(log))).collect()}
    got = say(chat.as_streamed(df))
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in table if r[0] == c), key=key)] for c in {r[0] for r in table}}
    assert {c: t for c, (t, _) in got.items()} == want == {c: t for c, (t, _) in say(chat.as_events(df)).items()}
    assert {c: x for c, (_, x) in got.items()} == {c: [text for role, text in t if role == "assistant"] for c, t in want.items()}


def test_a_long_conversation_is_spread(spark):
    n = 100_000
    df = spark.range(n).select(chat.F.lit(1).cast("long").alias("conv_id"), chat.F.col("id").alias("turn"), chat.F.when(chat.F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat.F.concat(chat.F.lit("t"), "id").alias("text"))
    messages = chat.fold(chat.as_streamed(df))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = chat.render_pieces(messages).groupBy(chat.F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.5 * -(-n // chat.PIECE)
    r = chat.read_back(chat.render(messages)).select(chat.F.size("turns").alias("n"), chat.F.get("loss_texts", chat.F.lit(n // 2 - 1)).alias("last"), chat.F.size("loss_texts").alias("k")).first()
    assert (r["n"], r["last"], r["k"]) == (n, f"t{n - 1}", n // 2)
