"""Pipelines: a JSON-like specification is checked on the driver and compiled to detectors, resolver and replacers.

Members: categories, preset, detection (precise, legacy), aggressive, patterns, rules, default_strategy, min_confidence,
allow, allow_case_sensitive, overlap (cover, legacy). Workers compile the specification once and keep it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

import regex

from ..errors import ValidationError
from ..functions import legacy, precise, strategies
from ..functions.checksums import CHECKSUMS
from ..functions.resolve import Candidate, Span, resolve
from . import presets

MEMBERS = {"categories", "preset", "detection", "aggressive", "patterns", "rules", "default_strategy", "min_confidence", "allow", "allow_case_sensitive", "overlap", "secrets"}
_LETTER = regex.compile(r"[\p{L}\p{N}_]")
_OTHER = r"[^\p{N}\p{L}]+"
_EDGES = regex.compile(rf"\A{_OTHER}|{_OTHER}\Z")
MAX_WORD = 40


def _pattern(source, flags: str, path: str):
    try:
        return regex.compile(source, (regex.I if "i" in flags else 0) | (regex.S if "s" in flags else 0) | (regex.M if "m" in flags else 0))
    except (regex.error, TypeError):
        raise ValidationError(path, "is not a valid regular expression") from None


def regex_detector(id: str, category: str, source: str, flags: str = "", confidence: float = 0.85, check=None, requires=(), group: int = 0, path: str = "pattern") -> precise.Detector:
    """A detector of one pattern; empty matches are skipped, requires names substrings without which there is no match."""
    compiled = _pattern(source, flags, path)

    def scan(text):
        for m in compiled.finditer(text):
            if m.end(group) > m.start(group) and (check is None or check(m[group])):
                yield m.start(group), m.end(group), confidence

    return precise.Detector(id, category, scan, (lambda t: any(r in t for r in requires)) if requires else None)


def with_context(d: precise.Detector, keywords, window: int = 3, boost: float = 0.15, required: bool = False, path: str = "context") -> precise.Detector:
    """d, more confident (or reporting at all) where a keyword is among the words before a match."""
    if not isinstance(keywords, (list, tuple)) or not keywords or not all(isinstance(k, str) and k.strip() for k in keywords):
        raise ValidationError(f"{path}.keywords", "must be a list of texts that aren't blank")
    if not isinstance(window, int) or window < 1:
        raise ValidationError(f"{path}.window", "must be a positive integer")
    if not 0 <= boost <= 1:
        raise ValidationError(f"{path}.boost", "must be between 0 and 1")
    words = "|".join(r"\s+".join(map(regex.escape, k.split())) for k in keywords)
    said = regex.compile(rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])", regex.I)
    reach = window * (MAX_WORD + 1)

    def begin(text: str, at: int) -> int:
        limit = max(0, at - reach)
        for _ in range(window):
            while at > limit and not _LETTER.match(text[at - 1]):
                at -= 1
            while at > limit and _LETTER.match(text[at - 1]):
                at -= 1
        return at

    def scan(text):
        for s, e, c in d.scan(text):
            if said.search(text[begin(text, s) : s]):
                yield s, e, min(1.0, c + boost)
            elif not required:
                yield s, e, c

    def prefilter(text: str) -> bool:
        low = text.lower()
        return any(k.split()[0].lower() in low for k in keywords) and (d.prefilter is None or d.prefilter(text))

    return precise.Detector(d.id, d.category, scan, prefilter if required else d.prefilter)


@dataclass
class Pipeline:
    detectors: list[precise.Detector]
    fallback: strategies.Replacer
    by_category: dict[str, strategies.Replacer] = field(default_factory=dict)
    min_confidence: float = 0.0
    allow: list = field(default_factory=list)
    allow_case_sensitive: bool = False
    overlap: str = "cover"

    def __post_init__(self):
        ids = [d.id for d in self.detectors]
        if len(set(ids)) < len(ids):
            raise ValidationError("detectors", "ids must differ")
        fold = (lambda s: s) if self.allow_case_sensitive else str.lower
        self._fold = fold
        self._words = {fold(a) for a in self.allow if isinstance(a, str)}
        self._rules = [_pattern(a["pattern"], a.get("flags", ""), "allow") for a in self.allow if not isinstance(a, str)]

    def _allowed(self, value: str) -> bool:
        return self._fold(value) in self._words or any(r.search(value) for r in self._rules)

    def _none_allowed(self, text: str) -> bool:
        """That nothing in the text can be allowed (of other than ASCII texts, a part may fold otherwise than the whole)."""
        return not self._rules and text.isascii() and not any(map(self._fold(text).__contains__, self._words))

    def candidates(self, text: str) -> list[Candidate]:
        out = []
        some = self._words or self._rules
        for i, d in enumerate(self.detectors):
            if d.prefilter is None or d.prefilter(text):
                for s, e, c in d.scan(text):
                    if not 0 <= s < e <= len(text):
                        raise ValueError(f"detector {d.id} reports offsets outside the text")
                    if c >= self.min_confidence:
                        out.append(Candidate(s, e, c, i, bool(some) and self._allowed(text[s:e])))
        return out

    def spans(self, text: str) -> list[Span]:
        return resolve(text, self.candidates(text), self.overlap)

    def test(self, text: str) -> bool:
        for d in self.detectors:
            if d.prefilter is None or d.prefilter(text):
                for s, e, c in d.scan(text):
                    if c >= self.min_confidence:
                        if not self.allow or self._none_allowed(text):
                            return True
                        return bool(self.spans(text))
        return False

    def scan(self, text: str) -> list[tuple]:
        """(start, end, category, confidence, detector, residual)."""
        return [(s, e, self.detectors[d].category, c, self.detectors[d].id, r) for s, e, c, d, r in self.spans(text)]

    def transform(self, text: str, replacer=None) -> tuple[str, list[tuple]]:
        """The text with all spans replaced, in document order, and the spans with their places in it."""
        out, spans, at, size = [], [], 0, 0
        for span in self.scan(text):
            s, e, category = span[:3]
            new = (replacer or self.by_category.get(category, self.fallback))(text[s:e], category)
            out += [text[at:s], new]
            size += s - at
            spans.append((*span, size, size + len(new)))
            size, at = size + len(new), e
        return "".join(out) + text[at:], spans


def compile_pipeline(spec: dict | None = None, tokenizer=None) -> Pipeline:
    spec = {} if spec is None else spec
    if not isinstance(spec, dict):
        raise ValidationError("spec", "must be an object")
    if unknown := set(spec) - MEMBERS:
        raise ValidationError(sorted(unknown)[0], "is not a member of a pipeline")
    own = presets.combine(spec["preset"]) if spec.get("preset") else (None, None, {})
    if spec.get("detection", "precise") not in ("precise", "legacy"):
        raise ValidationError("detection", "must be precise or legacy")
    if spec.get("overlap", "cover") not in ("cover", "legacy"):
        raise ValidationError("overlap", "must be cover or legacy")
    detectors = precise.builtin(spec.get("categories") or own[0], detection=spec.get("detection", "precise"), aggressive=bool(spec.get("aggressive")))
    for i, p in enumerate(spec.get("patterns") or []):
        path = f"patterns[{i}]"
        if not isinstance(p.get("category"), str) or not p["category"]:
            raise ValidationError(f"{path}.category", "must be a text that isn't empty")
        if not 0 <= p.get("confidence", 0.85) <= 1:
            raise ValidationError(f"{path}.confidence", "must be between 0 and 1")
        if p.get("validator") is not None and p["validator"] not in CHECKSUMS:
            raise ValidationError(f"{path}.validator", "must be one of " + ", ".join(sorted(CHECKSUMS)))
        d = regex_detector(f"pattern/{i}", p["category"], p.get("source"), p.get("flags", ""), p.get("confidence", 0.85), CHECKSUMS.get(p.get("validator")), p.get("requires", ()), path=path)
        detectors.append(with_context(d, **p["context"], path=f"{path}.context") if p.get("context") else d)
    rules = {**own[2], **(spec.get("rules") or {})}
    for category, rule in rules.items():
        if not isinstance(rule, dict):
            raise ValidationError(f"rules.{category}", "must be a strategy object")
    default = spec.get("default_strategy") or own[1] or {"strategy": "redact"}
    labels = set()
    for s in (default, *rules.values()):  # a second pass finds nothing in what the first has written
        if s.get("strategy") not in ("tokenize", "hash", "encrypt"):
            label = s.get("label", strategies.LABEL) if s.get("strategy") == "redact" else strategies.LABEL
            labels |= {label, _EDGES.sub("", label)}
    make = lambda s: strategies.replacer(s, spec.get("secrets"), tokenizer)
    return Pipeline(
        detectors,
        make(default),
        {c: make(s) for c, s in rules.items()},
        spec.get("min_confidence", 0.0),
        [*(spec.get("allow") or []), *sorted(labels - {""})],
        bool(spec.get("allow_case_sensitive")),
        spec.get("overlap", "cover"),
    )


@lru_cache(maxsize=32)
def cached(spec: str) -> Pipeline:
    """The pipeline of a specification in JSON, once for each worker."""
    return compile_pipeline(json.loads(spec))


# The first generation


OPTIONS = {"categories", "preset", "rules", "default_strategy", "global_replacement", "consistent_tokens", "custom_patterns", "min_confidence", "allow", "allow_case_sensitive", "aggressive", "hash_mode"}


def _legacy_replacer(spec: dict, hash_mode: str) -> strategies.Replacer:
    """Without async crypto: hash is a seeded pseudonym, what can't be done at once is redacted."""
    name = spec.get("strategy")
    if name == "hash" and hash_mode != "sha256":
        return lambda v, c: strategies.pseudonymize(v, "hsh_", spec.get("pepper", ""))
    if name in ("tokenize", "encrypt", "synthesize"):
        return lambda v, c: strategies.LABEL
    o = {k: v for k, v in spec.items() if k != "strategy"}
    plain = {"redact": strategies.redact, "mask": strategies.mask, "pseudonymize": strategies.pseudonymize, "generalize": strategies.generalize, "hash": strategies.hashed}
    if name not in plain:
        raise ValidationError("strategy", f"{name!r} is unknown")
    plain[name]("0", **o)
    return lambda v, c: plain[name](v, **o)


class Legacy:
    """Detect, resolve, then filter; custom patterns take part in a second resolution and aren't reported."""

    def __init__(self, options: dict | None = None, detectors: dict | None = None, validators: dict | None = None):
        o = dict(options or {})
        if unknown := set(o) - OPTIONS:
            raise ValidationError(sorted(unknown)[0], "is not an option")
        if "global_replacement" in o and not str(o["global_replacement"]).strip():
            raise ValidationError("global_replacement", "must not be blank")
        rules, default = dict(o.get("rules") or {}), o.get("default_strategy") or {"strategy": "redact"}
        if o.get("preset"):
            categories, own, special = presets.combine(o["preset"])
            rules = {c: special.get(c, own) for c in categories} | rules
            default = o.get("default_strategy") or own
        self.categories = list(rules) if rules else list(o.get("categories") or legacy.CATEGORIES)
        for c in self.categories:
            if c not in legacy.DETECTORS and c not in (detectors or {}):
                raise ValidationError("categories", f"unknown category {c!r}")
        mode = o.get("hash_mode", "pseudonym")
        self.rules = {c: _legacy_replacer(s, mode) for c, s in rules.items()}
        self.default = _legacy_replacer(default, mode)
        self.options, self.detectors, self.validators = o, detectors or {}, validators or {}
        self.custom = [(legacy.custom(p["pattern"], p.get("flags", "")), p.get("label", strategies.LABEL)) for p in o.get("custom_patterns") or []]
        self._allow = Pipeline([], self.default, allow=o.get("allow") or [], allow_case_sensitive=bool(o.get("allow_case_sensitive")))

    def matches(self, text: str) -> list[legacy.Match]:
        found = legacy.detect(text, self.categories, detectors=self.detectors, aggressive=bool(self.options.get("aggressive")))
        least = self.options.get("min_confidence", 0.0)
        return [m for m in found if m[4] >= least and not self._allow._allowed(m[1]) and all(v(m[1]) for v in self.validators.get(m[0], ()))]

    def anonymize(self, text: str) -> tuple[str, list[legacy.Match]]:
        found = self.matches(text)
        labels = {}
        both = list(found)
        for detect, label in self.custom:
            for m in detect(text):
                labels[id(m)] = label
                both.append(m)
        tokens: dict[tuple[str, str], str] = {}
        counts: dict[str, int] = {}
        out = text
        for m in reversed(legacy.greedy(both)):
            category, value = m[0], m[1]
            if self.options.get("global_replacement"):
                new = self.options["global_replacement"]
            elif self.options.get("consistent_tokens"):
                prefix = presets.PREFIXES.get(category, category.upper())
                if (category, value.lower()) not in tokens:
                    counts[prefix] = counts.get(prefix, 0) + 1
                    tokens[category, value.lower()] = f"{prefix}_{counts[prefix]}"
                new = tokens[category, value.lower()]
            elif id(m) in labels:
                new = labels[id(m)]
            else:
                new = self.rules.get(category, self.default)(value, category)
            out = out[: m[2]] + new + out[m[3] :]
        return out, found
