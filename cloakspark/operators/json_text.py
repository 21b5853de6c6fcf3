"""The JSON sanitizer on columns of JSON texts."""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.json_tools import LONG_NUMBER, Sanitizer
from ..plans.spec import cached, compile_pipeline


def sanitize(text: Column, spec: dict | None = None, *, key_rules: dict[str, str] | None = None, skip_keys=(), json_string_keys=(), keys: str = "keep", fallback_to_text: bool = False, number_digits: int = LONG_NUMBER, key_patterns: dict[str, str] | None = None, skip_paths=()) -> Column:
    """Struct of json, fields (path, category, detector, count), replaced, flagged_keys, skipped, error.

    The JSON is the same byte for byte if nothing was replaced. What isn't JSON, or repeats a key of an object, is an
    error without text, or goes through the pipeline as text if asked for.
    """
    compile_pipeline(spec)
    s = json.dumps(spec or {}, sort_keys=True)
    options = (key_rules, skip_keys, json_string_keys, keys, number_digits, key_patterns, skip_paths)
    Sanitizer(None, *options)

    def run(t):
        if t is None:
            return None
        try:
            return (*Sanitizer(cached(s), *options).run(t), None)
        except ValueError:
            if fallback_to_text:
                new, spans = cached(s).transform(t)
                return new, [("", x[2], x[4], 1) for x in spans], len(spans), [], [], None
            return None, [], 0, [], [], "not JSON"
        except Exception as e:  # noqa: BLE001 - withheld
            return None, [], 0, [], [], type(e).__name__

    return F.udf(run, S.SANITIZED, useArrow=True).asNondeterministic()(text)


def sanitize_events(body: Column, spec: dict | None = None, *, limit: int | None = None) -> Column:
    """Event streams, event by event (blank lines end them): data that is JSON as JSON, the rest as text.

    With a limit of characters, an event beyond it is withheld, and an error event that says so stands for it.
    """
    compile_pipeline(spec)
    s = json.dumps(spec or {}, sort_keys=True)

    def line(x: str) -> str:
        head, colon, data = x.partition(":")
        if head == "data" and colon:
            try:
                return "data: " + Sanitizer(cached(s)).run(data.strip())[0]
            except ValueError:
                pass
        return cached(s).transform(x)[0]

    def event(e: str) -> str:
        if limit is not None and len(e) > limit:
            return f"event: error\ndata: withheld: an event of more than {limit} characters"
        return "\n".join(map(line, e.split("\n")))

    def run(t):
        if t is None:
            return None
        return "".join(e if i % 2 else event(e) for i, e in enumerate(re.split(r"(\r?\n\r?\n)", t)))

    return F.udf(run, "string", useArrow=True).asNondeterministic()(body)


def sanitize_body(content_type: Column, body: Column, spec: dict | None = None, *, limit: int | None = None) -> Column:
    """Struct of text and error of bodies by content type: JSON, texts, event streams (each event apart); others pass.

    What isn't the JSON that it is said to be, and with a limit of characters what is longer, is an error without text.
    """
    from .text import transform

    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    is_json = kind.rlike(r"^(application|text)/(json|.*[+]json)$")
    stream = kind == "text/event-stream"
    text = (kind.rlike(r"^text/") | kind.isin("application/xml", "application/x-www-form-urlencoded")) & ~is_json & ~stream
    long = F.length(body) > limit if limit is not None else F.lit(False)
    result = lambda t, e: F.struct(t.alias("text"), e.cast("string").alias("error"))
    none = F.lit(None).cast("string")
    as_json, as_text = sanitize(F.when(is_json & ~long, body), spec), transform(F.when(text & ~long, body), spec)
    done = (
        F.when(long, result(none, F.lit("too long")))
        .when(is_json, result(as_json["json"], as_json["error"]))
        .when(stream, result(sanitize_events(F.when(stream, body), spec), none))
        .when(text, result(as_text["text"], as_text["error"]))
        .otherwise(result(body, none))
    )
    return F.when(body.isNotNull(), done)


def decode_body(content_type: Column, encoding: Column, body: Column, *, limit: int = 64 << 20) -> Column:
    """Struct of text and error of bodies as they were sent: bytes, inflated (gzip, deflate, identity) to limit bytes at
    most and decoded by the charset of the content type (UTF-8, if none is named)."""

    def inflate(data: bytes, name: str) -> bytes:
        for wbits in {"gzip": (47,), "x-gzip": (47,), "deflate": (15, -15)}[name]:
            try:
                d = zlib.decompressobj(wbits)
                out = d.decompress(data, limit + 1)
                break
            except zlib.error:
                out = None
        if out is None or not (d.eof or len(out) > limit):
            raise ValueError("not " + name)
        return out

    def run(kind, name, data):
        if data is None:
            return None
        try:
            for n in reversed([x.strip().lower() for x in (name or "").split(",")]):
                if n not in ("", "identity"):
                    data = inflate(bytes(data), n)
            if len(data) > limit:
                return None, "too long"
            charset = re.search(r"charset\s*=\s*\"?([^\s;\"]+)", kind or "", re.I)
            return bytes(data).decode(charset[1] if charset else "utf-8-sig"), None
        except KeyError:
            return None, "unknown encoding"
        except LookupError:
            return None, "unknown charset"
        except UnicodeDecodeError:
            return None, "not in its charset"
        except ValueError as e:
            return None, str(e)

    return F.udf(run, "struct<text:string,error:string>", useArrow=True)(content_type, encoding, body)
