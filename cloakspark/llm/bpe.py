"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never end up inside one token, so the place between
the two is a certain cut. The text is split by the tokenizer's own pattern and then at all certain cuts; the
fragments are encoded independently of each other, by the merges of the vocabulary file, and the results are
concatenated. Pieces repeat, so each worker keeps a bounded cache of them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import give_back, pick, text_batches

#: Pieces that a worker keeps in each of two generations; when the newer is full, it replaces the older.
CACHE_ENTRIES = 1 << 16
#: Bytes of text that a task encodes at once.
AT_ONCE = 1 << 20

#: White space as Unicode has it; Python's own idea of it has four control characters more.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(letters: str, numbers: str) -> str:
    """The split pattern of byte-level vocabularies; alternatives that can't start alike are in another order."""
    return rf" ?[{letters}]+| ?[{numbers}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_WS}{letters}{numbers}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def _ranges(kind: str) -> str:
    """The characters of the basic plane that are of this Unicode kind, for a character class of the quicker re."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    return "".join(rf"\u{ord(m[0]):04x}-\u{ord(m[-1]):04x}" for m in regex.findall(rf"\p{{{kind}}}+", every))


def default_path() -> str:
    """Where the public byte-level vocabulary is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class ForcedBoundaryBPE:
    """encode and decode as the vocabulary file's own library does, without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer and prefix space is needed")
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        inside = np.zeros((256, 256), dtype=bool)
        for b in self.bytes_of.values():
            if len(b) > 1:
                x = np.frombuffer(b, dtype=np.uint8)
                inside[x[:-1], x[1:]] = True
        self.inside = inside
        self.joined = {a * 256 + b for a, b in zip(*(x.tolist() for x in np.nonzero(inside)))}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split_basic = re.compile(_pattern(_ranges("L"), _ranges("N")))
        self.split_any = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
        self.model = Tokenizer.from_file(path).model
        self.letters = {b: c for c, b in letters.items()}
        self.cache: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """piece, cut wherever two neighbouring bytes are inside no token."""
        joined, begin, out = self.joined, 0, []
        for i in range(1, len(piece)):
            if piece[i - 1] * 256 + piece[i] not in joined:
                out.append(piece[begin:i])
                begin = i
        return [*out, piece[begin:]]

    def _piece(self, piece: str) -> tuple[int, str, bytes]:
        out = self.older.get(piece)
        if out is None:
            ids = [t.id for f in self.fragments(piece.encode()) for t in self.model.tokenize(f.decode("latin-1").translate(self.letters))]
            out = (len(ids), ",".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids]))
        if len(piece) <= 256:
            if len(self.cache) >= CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = out
        return out

    def pieces(self, text: str) -> list[tuple[int, str, bytes]]:
        """For each piece of text: number of ids, the ids in decimals, the bytes they decode to."""
        get, piece, out = self.cache.get, self._piece, []
        split = (self.split_basic if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else self.split_any).findall
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append((1, str(self.added[part]), self.bytes_of[self.added[part]]))
            else:
                out += [get(p) or piece(p) for p in split(part)]
                get = self.cache.get
        return out

    def forget(self) -> None:
        """Gives back the memory of the cache: idle workers share an executor with other stages."""
        self.cache, self.older = {}, {}

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text or "") for i in ids.split(",")]

    def decode(self, ids) -> str:
        """Ids that the vocabulary doesn't have are left out; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of.get(int(i), b"") for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    """One encoder for each worker process."""
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>; only with_ids), ids_sha256, decoded_sha256 of every whole text.

    The digests are of the decimal ids joined by commas and of the decoded text in UTF-8. Null and empty texts have
    no tokens; repeated rows give repeated results; a null id stays null; an empty table gives an empty one; other
    columns are left behind. Rows are independent, so a lost executor costs only its own tasks.
    """
    path = path or default_path()

    def run(parts):
        bpe = load(path)
        for doc, texts in text_batches(parts, AT_ONCE):
            rows = []
            for text in texts:
                got = bpe.pieces(text) if text else []
                ids = ",".join([g[1] for g in got])
                decoded = b"".join([g[2] for g in got]).decode("utf-8", "replace")
                row = (sum([g[0] for g in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, [int(i) for i in ids.split(",")] if ids else []) if with_ids else row)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([doc, *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])
        bpe.forget()
        give_back()

    d = pick(docs, doc=id_col, text=text_col)
    kind = d.schema["doc"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(ids: DataFrame, path: str | None = None, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of arrays of ids. Null arrays give null texts, empty ones the empty text."""
    path = path or default_path()

    def run(parts):
        bpe = load(path)
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [None if x is None else bpe.decode(x) for x in pdf["ids"]]})

    d = pick(ids, doc_id=id_col, ids=ids_col)
    return d.mapInPandas(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")


def installed(path: str | None = None) -> bool:
    return os.path.exists(path or default_path())
