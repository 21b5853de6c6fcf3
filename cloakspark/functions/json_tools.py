"""JSON texts: a reader that keeps number literals, a canonical form, pointers, and the sanitizer's walk."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import re

from ..errors import ValidationError

DEPTH = 512
#: Digits from which an integer may be an identifier.
LONG_NUMBER = 12


class Literal(str):
    """A number as it is written."""


def parse(text: str):
    return json.loads(text, parse_int=Literal, parse_float=Literal, parse_constant=_refuse, object_pairs_hook=_pairs)


def _refuse(name):
    raise ValueError(f"{name} isn't JSON")


def _pairs(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):  # one of them would go through unseen
        raise ValueError("a key is repeated")
    return out


def write(x) -> str:
    if isinstance(x, Literal):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(write, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def pointer(path) -> str:
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in path)


def canonical(x) -> str:
    """Keys in the order of UTF-16 units, no spaces, no negative zero, doubles in their shortest form."""
    if isinstance(x, dict):
        items = sorted(x.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in items) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(canonical, x)) + "]"
    if isinstance(x, float):
        if not math.isfinite(x):
            raise ValidationError("number", "must be finite")
        return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x).replace("e-0", "e-").replace("e+0", "e+")
    return json.dumps(x, ensure_ascii=False)


def digest(text: str, key: bytes | None = None, domain: str = "") -> str:
    """SHA-256 in hex, or with a key HMAC-SHA-256 over domain, a zero and the text."""
    if key is None:
        return hashlib.sha256(text.encode()).hexdigest()
    return hmac.digest(key, domain.encode() + b"\0" + text.encode(), "sha256").hex()


class Sanitizer:
    """Walks JSON values. key_rules: {key in any case: category} forces a category on all below; skip_keys stay as they are.

    key_patterns does the same for keys that a regular expression finds; skip_paths are JSON pointers, * for any one
    member, of what stays as it is. Integers of number_digits digits and more are looked at as texts (0: none is).
    """

    def __init__(self, pipeline, key_rules: dict[str, str] | None = None, skip_keys=(), json_string_keys=(), keys: str = "keep", number_digits: int = LONG_NUMBER, key_patterns: dict[str, str] | None = None, skip_paths=()):
        if keys not in ("keep", "replace", "flag"):
            raise ValidationError("keys", "must be keep, replace or flag")
        self.pipeline, self.keys, self.number_digits = pipeline, keys, number_digits
        self.rules = {k.lower(): v for k, v in (key_rules or {}).items()}
        try:
            self.patterns = [(re.compile(k, re.I), v) for k, v in (key_patterns or {}).items()]
        except re.error:
            raise ValidationError("key_patterns", "must be regular expressions") from None
        self.skip_paths = [p.split("/") for p in skip_paths]
        self.skip, self.nested = {k.lower() for k in skip_keys}, {k.lower() for k in json_string_keys}

    def run(self, text: str):
        """(json, fields, replaced, flagged keys, skipped); the text itself if nothing was replaced."""
        self.fields: dict[tuple, int] = {}
        self.replaced, self.flagged, self.skipped, self.seen = 0, [], [], {}
        value = self._walk(parse(text), (), None, 0)
        out = write(value) if self.replaced else text
        fields = [(*k, n) for k, n in self.fields.items()]
        return out, fields, self.replaced, self.flagged, self.skipped

    def _note(self, path, category: str, detector: str) -> None:
        k = (pointer(path), category, detector)
        self.fields[k] = self.fields.get(k, 0) + 1
        self.replaced += 1

    def _text(self, s: str, path) -> str:
        if s not in self.seen:
            self.seen[s] = self.pipeline.transform(s)
        new, spans = self.seen[s]
        for span in spans:
            self._note(path, span[2], span[4])
        return new

    def _forced(self, s: str, path, category: str) -> str:
        self._note(path, category, "key")
        return self.pipeline.by_category.get(category, self.pipeline.fallback)(s, category)

    def _skips(self, path) -> bool:
        at = pointer(path).split("/") if self.skip_paths else None
        return any(len(p) == len(at) and all(a in ("*", b) for a, b in zip(p, at)) for p in self.skip_paths)

    def _rule(self, low: str, key: str, category):
        return self.rules.get(low) or next((c for p, c in self.patterns if p.search(key)), category)

    def _walk(self, x, path, category, depth: int):
        if depth > DEPTH:
            raise ValidationError("json", f"is nested more than {DEPTH} deep")
        if isinstance(x, dict):
            out = {}
            for k, v in x.items():
                low, at = k.lower(), (*path, k)
                if low in self.skip or self._skips(at):
                    self.skipped.append(pointer(at))
                    out[k] = v
                    continue
                name = k
                if self.keys != "keep" and self.pipeline.test(k):
                    if self.keys == "flag":
                        self.flagged.append(pointer(at))
                    else:
                        name = base = self._text(k, at)
                        n = 2
                        while name in out or (name != k and name in x):
                            name, n = f"{base}#{n}", n + 1
                rule = self._rule(low, k, category)
                if low in self.nested and isinstance(v, str) and rule is None:
                    try:
                        before = self.replaced
                        inner = self._walk(parse(v), at, None, depth + 1)
                        out[name] = write(inner) if self.replaced > before else v
                        continue
                    except ValueError:
                        pass
                out[name] = self._walk(v, at, rule, depth + 1)
            return out
        if isinstance(x, list):
            return [self._walk(v, (*path, i), category, depth + 1) for i, v in enumerate(x)]
        if isinstance(x, Literal):
            if category is not None:
                return self._forced(str(x), path, category)
            digits = x.lstrip("-")
            if self.number_digits and digits.isdigit() and len(digits) >= self.number_digits:
                new = self._text(str(x), path)
                return x if new == x else new
            return x
        if isinstance(x, bool):
            return self._forced("true" if x else "false", path, category) if category is not None else x
        if isinstance(x, str):
            return self._forced(x, path, category) if category is not None and x else self._text(x, path)
        return x
