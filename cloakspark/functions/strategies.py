"""Replacements of values: Columns for whole columns, Python for spans inside texts.

Both give the same results. Lengths and positions count code points; djb-style and FNV hashes go over UTF-16 units, as
the formats they reproduce do.
"""

from __future__ import annotations

import hashlib
import math
import re
import secrets
from collections.abc import Callable
from functools import reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnsupportedStrategyError, ValidationError

LABEL = "[REDACTED]"
STRATEGIES = tuple("encrypt generalize hash mask pseudonymize redact synthesize tokenize".split())
Replacer = Callable[[str, str], str]  # (value, category)


def _units(s: str) -> list[int]:
    b = s.encode("utf-16-le", "surrogatepass")
    return [b[i] | b[i + 1] << 8 for i in range(0, len(b), 2)]


# Python


def _whole(value, name: str, least: int = 0) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < least:
        raise ValidationError(name, f"must be an integer of at least {least}")
    return value


def redact(value: str, label: str = LABEL) -> str:
    if not isinstance(label, str) or not label.strip():
        raise ValidationError("label", "must not be blank")
    return label


def mask(value: str, mask_char: str = "*", keep_leading: int = 0, keep_trailing: int = 0, preserve_format: bool = False) -> str:
    """Plain: all masked if nothing would be. By format: letters X or x, numbers 0, others stay; unchanged if all is kept."""
    if not isinstance(mask_char, str) or len(mask_char) != 1:
        raise ValidationError("mask_char", "must be one character")
    lead, trail, n = _whole(keep_leading, "keep_leading"), _whole(keep_trailing, "keep_trailing"), len(value)
    if lead + trail >= n:
        return value if preserve_format else mask_char * n
    inner = value[lead : n - trail]
    if preserve_format:
        shown = lambda c: ("X" if c != c.lower() else "x") if regex.match(r"\p{L}", c) else "0" if regex.match(r"\p{N}", c) else c
        inner = "".join(map(shown, inner))
    else:
        inner = mask_char * len(inner)
    return value[:lead] + inner + value[n - trail :]


def djb(text: str) -> int:
    h = 5381
    for u in _units(text):
        h = (h * 33 & 0xFFFFFFFF) ^ u
    return h


def pseudonymize(value: str, prefix: str = "id_", seed: str | None = None) -> str:
    """Random without a seed; with one, the same for the same value."""
    if seed is None:
        return prefix + secrets.token_hex(8)
    return f"{prefix}{djb(f'{seed}:{value}'):08x}{djb(f'{seed}:{value}:v2'):08x}"


def hashed(value: str, pepper: str | None = None, truncate: int = 16) -> str:
    if _whole(truncate, "truncate", 1) > 64:
        raise ValidationError("truncate", "must be at most 64")
    return hashlib.sha256((value if pepper is None else f"{pepper}:{value}").encode()).hexdigest()[:truncate]


_NUMBER = re.compile(r"[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+")


def number(text: str) -> float:
    """What a script's Number() makes of text: blank is 0, what isn't a number is NaN."""
    t = text.strip("\t\n\v\f\r \xa0﻿  ")
    if not t:
        return 0.0
    if not _NUMBER.fullmatch(t):
        return math.nan
    if t[:2].lower() in ("0x", "0o", "0b"):
        return float(int(t, 0))
    return float(t.replace("Infinity", "inf"))


def generalize(value: str, bucket_size: int = 10) -> str:
    """low-high of the bucket; texts that are no numbers stay."""
    size = _whole(bucket_size, "bucket_size", 1)
    n = number(value)
    if not math.isfinite(n):
        return value
    low = math.floor(n) // size * size
    return f"{low}-{low + size - 1}"


def fnv(text: str) -> int:
    h = 0x811C9DC5
    for u in _units(text):
        h = (h ^ u) * 0x01000193 & 0xFFFFFFFF
    return h


class _Xorshift:
    def __init__(self, seed: int):
        self.state = seed or 1

    def __call__(self) -> float:
        s = self.state
        s ^= s << 13 & 0xFFFFFFFF
        s ^= (s - (1 << 32) if s >> 31 else s) >> 17 & 0xFFFFFFFF  # the shift keeps the sign
        s ^= s << 5 & 0xFFFFFFFF
        self.state = s
        return s / (1 << 32)

    def between(self, low: int, high: int) -> int:
        return low + math.floor(self() * (high - low + 1))

    def pick(self, items):
        return items[math.floor(self() * len(items))]


_HOSTS = "example.com test.org sample.net demo.io placeholder.dev".split()
_FIRST = "Alice Bob Carol Dave Eve Frank Grace Hank Irene Jack Karen Leo Mina Neal Olivia Paul Quinn Rosa Sam Tina Uma Victor Wendy Xena Yuri Zoe".split()
_LAST = "Smith Jones Williams Taylor Brown Davies Evans Wilson Thomas Roberts Johnson White Martin Anderson Thompson Garcia Martinez Robinson Clark Rodriguez".split()
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _iban(r: _Xorshift) -> str:
    r.between(10, 99)
    sort = "".join(str(r.between(10, 99)) for _ in range(3))
    account = str(r.between(10**7, 10**8 - 1))
    s = "GB00SYNT" + sort + account
    return " ".join([s[:4], s[4:8], s[8:12], s[12:16], s[16:20], s[20:]])


def _shuffled(r: _Xorshift, value: str) -> str:
    out = []
    for c in value:
        if regex.match(r"\p{L}", c):
            out.append(r.pick(_UPPER if c != c.lower() else _LOWER))
        else:
            out.append(r.pick(_DIGITS) if regex.match(r"\p{N}", c) else c)
    return "".join(out)


_MADE: dict[str, Callable[[_Xorshift], str]] = {
    "email": lambda r: f"{r.pick(_FIRST).lower()}.{r.pick(_LAST).lower()}{r.between(1, 99)}@{r.pick(_HOSTS)}",
    "phone": lambda r: f"+1-{r.between(200, 999)}-{r.between(200, 999)}-{r.between(1000, 9999)}",
    "ssn": lambda r: f"{r.between(100, 665)}-{r.between(10, 99)}-{r.between(1000, 9999)}",
    "credit-card": lambda r: " ".join(("4" if i == 0 else "") + "".join(str(r.between(0, 9)) for _ in range(3 if i == 0 else 4)) for i in range(4)),
    "ipv4": lambda r: f"192.0.2.{r.between(1, 254)}",
    "ipv6": lambda r: "2001:0db8:" + ":".join(f"{r.between(0, 65535):04x}" for _ in range(6)),
    "url": lambda r: f"https://{r.pick(_HOSTS)}/{r.pick(['user', 'profile', 'data', 'record', 'item'])}/{r.between(1000, 9999)}",
    "iban": _iban,
    "date-of-birth": lambda r: f"{1940 + r.between(0, 64)}-{r.between(1, 12):02d}-{r.between(1, 28):02d}",
    "name": lambda r: f"{r.pick(_FIRST)} {r.pick(_LAST)}",
    "address": lambda r: f"{r.between(1, 9999)} {r.pick(['Main St', 'Oak Ave', 'Pine Rd', 'Elm Blvd', 'Maple Dr', 'Cedar Ln'])}, "
    f"{r.pick(['Springfield', 'Shelbyville', 'Riverdale', 'Greenfield', 'Maplewood'])}, {r.pick('CA TX FL NY WA IL OH PA GA NC'.split())} {r.between(10000, 99999)}",
    "api-key": lambda r: "sk_test_" + "".join(r.pick(_UPPER + _LOWER + _DIGITS) for _ in range(32)),
}


def synthesize(value: str, category: str, seed: str = "") -> str:
    r = _Xorshift(fnv(f"{seed}{category}:{value}"))
    return _MADE[category](r) if category in _MADE else _shuffled(r, value)


def _closed(f: Callable[[str, str], str]) -> Replacer:
    """Fails closed: a value that would stay is redacted."""
    return lambda value, category: LABEL if (r := f(value, category)) == value and value else r


def replacer(spec: dict, secrets_: dict | None = None, tokenizer=None) -> Replacer:
    """The replacer of a strategy {strategy, ...options}; its options are checked now. encrypt works on Columns only."""
    known = secrets_ or {}
    name = spec.get("strategy")
    o = {k: v for k, v in spec.items() if k != "strategy" and v is not None}
    try:
        if name == "redact":
            label = redact("", **o)
            return lambda value, category: label
        if name == "mask":
            mask("", **o)
            return _closed(lambda v, c: mask(v, **o))
        if name == "pseudonymize":
            o.setdefault("seed", known.get("pseudonymize_seed"))
            pseudonymize("", **o)
            return _closed(lambda v, c: pseudonymize(v, **o))
        if name == "hash":
            o.setdefault("pepper", known.get("hash_pepper"))
            hashed("", **o)
            return lambda v, c: hashed(v, **o)
        if name == "generalize":
            if _whole(o.get("bucket_size", 10), "bucket_size", 1) < 2:
                raise ValidationError("bucket_size", "must be 2 or more, for a range of one value hides nothing")
            hidden = int(math.log10(o.get("bucket_size", 10)))

            def general(v: str, c: str) -> str:
                n = number(v)
                if not v.strip() or not math.isfinite(n) or len(str(abs(int(n)))) - hidden > 3:
                    return LABEL
                return generalize(v, **o)

            return _closed(general)
        if name == "synthesize":
            o.setdefault("seed", known.get("synthesize_seed", ""))
            synthesize("", "email", **o)
            return _closed(lambda v, c: synthesize(v, c, **o))
        if name == "tokenize":
            if tokenizer is None:
                raise ValidationError("tokenization", "is required by the strategy tokenize")
            return tokenizer
    except TypeError as e:
        raise ValidationError(f"{name}", str(e)) from None
    raise UnsupportedStrategyError(f"strategy {name!r} can't be used here")


# Columns


def redact_column(value: Column, label: str = LABEL) -> Column:
    return F.when(value.isNotNull(), F.lit(redact("", label)))


def mask_column(value: Column, mask_char: str = "*", keep_leading: int = 0, keep_trailing: int = 0, preserve_format: bool = False) -> Column:
    mask("", mask_char, keep_leading, keep_trailing, preserve_format)
    n, kept = F.length(value), keep_leading + keep_trailing
    inner = F.substring(value, F.lit(keep_leading + 1), n - kept)
    if preserve_format:
        hidden = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"\p{N}", "0"), r"[\p{Lu}\p{Lt}]", "X"), r"(?!X)\p{L}", "x")
        full = value
    else:
        hidden, full = F.repeat(F.lit(mask_char), n - kept), F.repeat(F.lit(mask_char), n)
    return F.when(n <= kept, full).otherwise(F.concat(F.substring(value, 1, keep_leading), hidden, F.substring(value, n - keep_trailing + 1, F.lit(keep_trailing))))


def _let(value: Column, f) -> Column:
    """f(value), value evaluated once whatever f does with it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _djb_step(h: Column, unit: Column) -> Column:
    return (h * 33).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(unit)


def _djb_column(text: Column) -> Column:
    """The hash of a text's UTF-16 units, as a number."""
    wide = lambda p: F.when(p < 65536, F.array(p)).otherwise(F.array(F.lit(0xD800) + F.shiftright(p - 65536, 10), F.lit(0xDC00) + (p - 65536).bitwiseAND(F.lit(1023))))
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.lit(5381).cast("long")
    pairs = F.aggregate(F.flatten(F.transform(points, wide)), start, _djb_step)
    return F.when(F.length(text) == F.octet_length(text), F.aggregate(points, start, _djb_step)).otherwise(pairs)


def pseudonymize_column(value: Column, prefix: str = "id_", seed: str | None = None) -> Column:
    """Without a seed random: write the result before using it twice."""
    if seed is None:
        return F.when(value.isNotNull(), F.concat(F.lit(prefix), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)))
    head = F.concat(F.lit(f"{seed}:"), value)
    written = lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")
    longer = lambda h: reduce(_djb_step, [F.lit(ord(c)).cast("long") for c in ":v2"], h)  # noqa: E731 - the hash of head and :v2
    return _let(_djb_column(head), lambda h: F.concat(F.lit(prefix), written(h), written(longer(h))))


def hash_column(value: Column, pepper: str | None = None, truncate: int = 16) -> Column:
    hashed("", pepper, truncate)
    return F.substring(F.sha2(value if pepper is None else F.concat(F.lit(f"{pepper}:"), value), 256), 1, truncate)


def generalize_column(value: Column, bucket_size: int = 10, numeric: bool = False) -> Column:
    """Of a number (numeric: the column is of a numeric type, so that no text is read) or of a text that is one; other texts stay."""
    low = lambda n: F.floor(F.floor(n) / bucket_size) * bucket_size
    named = lambda n: _let(low(n).cast("long"), lambda x: F.concat_ws("-", x, x + F.lit(bucket_size - 1).cast("long")))
    if numeric:
        n = value.cast("double")
        return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), named(n)).otherwise(value.cast("string"))
    text = value.cast("string")

    def number(t: Column) -> Column:
        plain = F.when(t.rlike(r"\A[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"), t.try_cast("double"))
        based = lambda mark, digits, base: F.when(t.rlike(rf"\A0{mark}{digits}{{1,12}}\z"), F.conv(F.substring(t, F.lit(3), F.length(t)), base, 10).cast("double"))
        return F.when(t == "", 0.0).otherwise(F.coalesce(plain, based("[xX]", "[0-9a-fA-F]", 16), based("[oO]", "[0-7]", 8), based("[bB]", "[01]", 2)))

    trimmed = F.regexp_replace(text, r"\A[\s\xa0\ufeff\u2028\u2029]+|[\s\xa0\ufeff\u2028\u2029]+\z", "")
    bucket = _let(trimmed, lambda t: _let(number(t), lambda n: F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), named(n))))
    return F.coalesce(bucket, text)


def encrypt_column(value: Column, key: Column, aad: str = "") -> Column:
    """enc:iv:ciphertext and tag in base64, AES-GCM with a random nonce. key is a binary column of 16 or 32 bytes."""
    sealed = F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad)) if aad else F.aes_encrypt(value, key, F.lit("GCM"))
    part = lambda x: F.base64(F.unhex(x))
    # One evaluation, two uses: each evaluation has a nonce of its own.
    split = lambda raw: F.concat_ws(":", F.lit("enc"), part(F.substring(raw, F.lit(1), F.lit(24))), part(F.substring(raw, F.lit(25), F.length(raw))))
    return F.when(value.isNotNull(), F.get(F.transform(F.array(F.hex(sealed)), split), F.lit(0)))


def decrypt_column(sealed: Column, key: Column) -> Column:
    """The value of encrypt_column's result; null where that fails."""
    raw = lambda e, i: F.hex(F.unbase64(F.get(F.split(e, ":"), F.lit(i))))
    opened = lambda e: F.try_aes_decrypt(F.unhex(F.concat(raw(e, 1), raw(e, 2))), key, F.lit("GCM")).cast("string")
    return F.get(F.transform(F.array(sealed), lambda e: F.when(e.startswith("enc:"), opened(e))), F.lit(0))


def derive_key(passphrase: str) -> bytes:
    """PBKDF2 of 100 000 rounds with a fixed salt, as passphrase encryption of single values has it."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), b"cloakspark-encrypt-v1", 100_000, 32)


def column(value: Column, spec: dict, key: Column | None = None) -> Column:
    """The Column of a strategy {strategy, ...options}."""
    o = {k: v for k, v in spec.items() if k != "strategy"}
    table = {"redact": redact_column, "mask": mask_column, "pseudonymize": pseudonymize_column, "hash": hash_column, "generalize": generalize_column}
    if spec.get("strategy") in table:
        return table[spec["strategy"]](value.cast("string"), **o)
    if spec.get("strategy") == "encrypt" and key is not None:
        return encrypt_column(value.cast("string"), key)
    if spec.get("strategy") == "synthesize":
        category = o.pop("category", "custom")
        return F.udf(lambda v: None if v is None else synthesize(v, category, **o), "string", useArrow=True)(value.cast("string"))
    raise UnsupportedStrategyError(f"{spec.get('strategy')!r} has no column form")
