"""Conversations on their way to a language model and back: tokens out, values in.

Messages of one conversation share their tokens. They are texts, or JSON objects with content parts and tool calls, of
which what is data is looked at and what is structure (roles, ids, names of functions, signatures, media) stays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.json_tools import DEPTH, LONG_NUMBER, Literal, parse, write
from . import vault


def sanitize_messages(df: DataFrame, conv_col: str, turn_col: str, text_col: str, *, role_col: str | None = None, skip_roles=(), categories=None, shape: str = "bracket") -> tuple[DataFrame, DataFrame]:
    """(messages with tokens, mapping): persist the mapping, and give restore_messages what comes back. Messages of skipped roles stay as they are."""
    if role_col is None or not skip_roles:
        return vault.tokenize_scopes(df, text_col, conv_col, order=[turn_col], categories=categories, shape=shape)
    skipped = F.coalesce(F.col(role_col).isin(*skip_roles), F.lit(False))
    done, mapping = vault.tokenize_scopes(df.where(~skipped), text_col, conv_col, order=[turn_col], categories=categories, shape=shape)
    return done.select(*df.columns).unionByName(df.where(skipped)), mapping


def restore_messages(df: DataFrame, conv_col: str, turn_col: str, text_col: str, mapping: DataFrame) -> DataFrame:
    return vault.restore_scopes(df, text_col, mapping, conv_col, order=[turn_col])


#: The same under the names of the round trip.
sanitize_for_llm, restore_from_llm = sanitize_messages, restore_messages

# Messages as JSON

_OF_MESSAGE = frozenset("cache_control finish_reason id model name role stop_reason toolCallId tool_call_id type".split())
_OF_PART = frozenset("cache_control id is_error name toolCallId toolName tool_call_id tool_use_id type".split())
_OF_CALL = frozenset("id index type".split())
_OPAQUE = frozenset("encrypted_content encrypted_index providerMetadata providerOptions reasoningEncryptedContent signature thoughtSignature thought_signature".split())
_MEDIA = frozenset("audio document file image image_url input_audio input_file input_image".split())
_DATA_URL = re.compile(r"data:[\w.+-]+/[\w.+-]+;base64,", re.I)


class Leaves:
    """Walks JSON values and puts each text through f; the value itself if nothing changes."""

    def __init__(self, f):
        self.f = f

    def any(self, x, key: str | None = None, parent: dict | None = None, depth: int = 0):
        if depth > DEPTH:
            raise ValidationError("json", f"is nested more than {DEPTH} deep")
        if isinstance(x, dict):
            return self.members(x, lambda k, v: self.any(v, k, x, depth + 1))
        if isinstance(x, list):
            return [self.any(v, None, None, depth + 1) for v in x]
        if isinstance(x, Literal):
            if x.lstrip("-").isdigit() and len(x.lstrip("-")) >= LONG_NUMBER:
                new = self.f(str(x))
                return x if new == x else new
            return x
        if isinstance(x, str):
            if key == "arguments":
                try:
                    inner = parse(x)
                except ValueError:
                    return self.f(x)
                new = write(self.any(inner, None, None, depth + 1))
                return x if new == write(inner) else new
            return self.f(x)
        return x

    def members(self, x: dict, f, keep=frozenset()) -> dict:
        out: dict = {}
        for k, v in x.items():
            if k in keep:
                out[k] = v
                continue
            name = base = self.f(k)
            n = 2
            while name in out or (name != k and name in x):
                name, n = f"{base}#{n}", n + 1
            out[name] = f(k, v)
        return out

    def message(self, x, depth: int = 0):
        """A message: content, function_call and tool_calls by their structure, opaque members as they are, the rest as data."""

        def other(k, v, of, media=False):
            opaque = k in _OPAQUE or (isinstance(v, str) and _DATA_URL.match(v)) or (k == "data" and (media or of.get("type") in ("base64", "redacted_thinking")))
            return v if opaque else self.members(v, lambda a, b: other(a, b, v, media)) if isinstance(v, dict) else self.any(v, k, of, depth)

        def call(v):
            return self.members(v, lambda k, w: other(k, w, v), {"name"}) if isinstance(v, dict) else self.any(v)

        def content(v):
            return [part(p) for p in v] if isinstance(v, list) else self.any(v)

        def part(p):
            if not isinstance(p, dict):
                return self.any(p)
            media = p.get("type") in _MEDIA
            return self.members(p, lambda k, v: content(v) if k == "content" else other(k, v, p, media), _OF_PART)

        def tool(v):
            return self.members(v, lambda k, w: call(w) if k == "function" else other(k, w, v), _OF_CALL) if isinstance(v, dict) else self.any(v)

        def member(k, v):
            if k == "content":
                return content(v)
            if k == "function_call":
                return call(v)
            return [tool(t) for t in v] if k == "tool_calls" and isinstance(v, list) else other(k, v, x)

        return self.members(x, member, _OF_MESSAGE) if isinstance(x, dict) else self.any(x)


def _leaves(json_text: str, whole: bool, else_text: bool) -> list[str] | None:
    out: list[str] = []

    def see(t: str) -> str:
        out.append(t)
        return t

    walk = Leaves(see)
    try:
        (walk.any if whole else walk.message)(parse(json_text))
    except (ValueError, ValidationError, RecursionError):
        return [json_text] if else_text else None
    return out


def _rebuilt(json_text: str, texts: list[str], whole: bool, else_text: bool) -> str | None:
    if texts is None or any(t is None for t in texts):
        return None
    try:
        value = parse(json_text)
    except ValueError:
        return texts[0] if else_text and len(texts) == 1 else None
    rest = iter(texts)
    walk = Leaves(lambda t: next(rest))
    new = write((walk.any if whole else walk.message)(value))
    return json_text if new == write(value) else new


def _through(df: DataFrame, json_col: str, scope: list[str], order: list[str], step, whole: bool, else_text: bool):
    """(df with the texts of json_col as step made them, what else step returns); nulls where that can't be done."""
    own = df.withColumn("__j", vault._row_id(*dict.fromkeys([*scope, *order, json_col])))
    leaves = F.udf(lambda t: None if t is None else _leaves(t, whole, else_text), "array<string>", useArrow=True)
    keep = [c for c in dict.fromkeys([*scope, *order])]
    rows = own.dropDuplicates(["__j"]).select("__j", *keep, leaves(F.col(f"`{json_col}`")).alias("__l")).select("__j", *keep, F.posexplode("__l").alias("__k", "__x"))
    done, more = step(rows)
    back = done.groupBy("__j").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__x"))), lambda x: x["__x"]).alias("__l"))
    rebuilt = F.udf(lambda t, x: None if t is None else _rebuilt(t, [] if x is None else list(x), whole, else_text), "string", useArrow=True)
    joined = own.join(back, "__j", "left")
    return joined.select(*[rebuilt(F.col(f"`{c}`"), F.col("__l")).alias(c) if c == json_col else F.col(f"`{c}`") for c in df.columns]), more


def _withheld(df: DataFrame, json_col: str, whole: bool) -> DataFrame:
    """df with null where json_col isn't JSON: it has no leaves and must not pass."""
    good = F.udf(lambda t: t if t is not None and _leaves(t, whole, False) is not None else None, "string", useArrow=True)
    return df.withColumn(json_col, good(F.col(f"`{json_col}`")))


def sanitize_chat(df: DataFrame, conv_col: str, turn_col: str, message_col: str, *, categories=None, shape: str = "bracket") -> tuple[DataFrame, DataFrame]:
    """(messages, as JSON, with tokens in their contents, tool calls and other data; mapping). Messages that aren't JSON, or repeat a key, are withheld (null)."""

    def step(rows):
        return vault.tokenize_scopes(rows, "__x", conv_col, order=[turn_col, "__k"], categories=categories, shape=shape)

    return _through(_withheld(df, message_col, False), message_col, [conv_col], [turn_col], step, False, False)


def restore_chat(df: DataFrame, conv_col: str, turn_col: str, message_col: str, mapping: DataFrame) -> DataFrame:
    """The messages with their values, which stay JSON whatever the values hold."""
    return restore_json(df, message_col, mapping, conv_col)


def restore_json(df: DataFrame, json_col: str, mapping: DataFrame, *scope: str) -> DataFrame:
    """df with the tokens in the strings and keys of JSON texts restored; what isn't JSON is restored as a text."""

    def step(rows):
        return vault.restore_scopes(rows, "__x", mapping, *scope, order=[]), None

    return _through(df, json_col, list(scope), [], step, True, True)[0]
