import hashlib
import random

import pytest

from cloakspark.llm import bpe

pytestmark = pytest.mark.skipif(not bpe.installed(), reason="no vocabulary")
PARTS = ["a", "the", " ", "  ", "\n", "'s", "'", "1", "é", "ß", "日", "\t", "<|endoftext|>", "!", "_", "\x00", "\xa0", " t", "ing", "😀", "\x1c", "\x85", "ab" * 40]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_equals_the_library(library):
    own, rng = bpe.load(bpe.default_path()), random.Random(2)
    texts = ["", "a" * 20_000, "ab" * 10_000, " \n" * 500, *("".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(2000))]
    texts += ["".join("a" + chr(c) + chr(c) + " " + chr(c) for c in range(a, min(a + 500, 0xD800))) for a in range(0, 0xD800, 500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_cuts_are_between_bytes_of_no_token():
    own = bpe.load(bpe.default_path())
    pieces = own.fragments(" xqzqjk日本".encode())
    assert b"".join(pieces) == " xqzqjk日本".encode() and len(pieces) > 1
    for token in list(own.bytes_of.values())[:5000]:
        assert token.decode("latin-1") in own.added or own.fragments(token) == [token]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    own = bpe.ForcedBoundaryBPE(bpe.default_path())
    text = "one two three four five six one two three"
    assert own.decode(own.encode(text)) == text and len(own.cache) <= 3


def test_table(spark, library):
    rows = [(1, "Hello <|endoftext|> x", 9), (1, "Hello <|endoftext|> x", 9), (2, None, 9), (3, "", 9), (None, "é", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.encode(df).collect()
    assert len(got) == 5
    for r in got:
        text = {1: rows[0][1], 2: "", 3: "", None: "é"}[r["doc_id"]]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()}
    assert back[1] == rows[0][1] and back[2] == ""
    assert bpe.encode(df.limit(0)).count() == 0
