"""Texts that come in pieces: transformed and restored as if they had come whole."""

from __future__ import annotations

from ..plans.spec import Pipeline
from . import tokens as tk
from .patterns import SPACE, rx
from .resolve import resolve

WINDOW, CONTEXT, RUN_LIMIT = 256, 512, 8192
_SPACE = rx(f"[{SPACE}]")


class ChunkTransformer:
    """push gives what is safe to write, flush the rest.

    The end of what has come is held back by a window; a cut is made only after white space (or, in a run without any that is
    longer than the limit, where no match is), never inside a candidate. What was written stays as context to the left. What
    is held back is scanned again only after it has doubled.
    """

    def __init__(self, pipeline: Pipeline, window: int | None = None, state: dict | None = None):
        self.pipeline = pipeline
        longest = [d.max_match_length for d in pipeline.detectors]
        self.window = window or max([WINDOW, *[n for n in longest if n]])
        s = state or {}
        self.context, self.pending, self.consumed, self.spans, self.least = s.get("context", ""), s.get("pending", ""), s.get("consumed", 0), s.get("spans", 0), s.get("least", 0)
        self.scans = 0

    def state(self) -> dict:
        return {"context": self.context, "pending": self.pending, "consumed": self.consumed, "spans": self.spans, "least": self.least}

    def push(self, chunk: str) -> str:
        self.pending += chunk
        if len(self.pending) <= self.window or len(self.pending) < self.least:
            return ""
        out = self._advance(False)
        self.least = len(self.pending) + max(4 * self.window, len(self.pending))
        return out

    def flush(self) -> str:
        return self._advance(True)

    def _advance(self, final: bool) -> str:
        if not self.pending:
            return ""
        self.scans += 1
        text, base = self.context + self.pending, len(self.context)
        candidates = self.pipeline.candidates(text)
        cut = len(text) if final else self._cut(text, base, candidates)
        if cut <= base:
            return ""
        own = [c for c in candidates if c.start >= base and c.end <= cut]
        out, at = [], base
        for s, e, _, d, _ in resolve(text, own, self.pipeline.overlap):
            category = self.pipeline.detectors[d].category
            out += [text[at:s], self.pipeline.by_category.get(category, self.pipeline.fallback)(text[s:e], category)]
            at = e
            self.spans += 1
        out.append(text[at:cut])
        self.consumed += cut - base
        self.context, self.pending = text[max(0, cut - CONTEXT) : cut], text[cut:]
        return "".join(out)

    def _cut(self, text: str, base: int, candidates) -> int:
        """The last place after white space that is a window before the end and inside no candidate."""
        at = len(text) - self.window
        inside = sorted(((c.start, c.end) for c in candidates), reverse=True)
        while at > base:
            covering = [s for s, e in inside if s < at < e]
            if covering:
                at = min(covering)
                continue
            if _SPACE.match(text[at - 1]) and not (at < len(text) and _SPACE.match(text[at])):
                return at
            if len(text) - base > RUN_LIMIT and not any(_SPACE.match(c) for c in text[base:at][-RUN_LIMIT:]):
                return at
            at -= 1
        return base


class ChunkRestorer:
    """Tokens back to values; the beginning of a token at the end of a piece is held back."""

    def __init__(self, mapping: dict[str, str], carry: str = ""):
        self.mapping, self.carry = mapping, carry

    def push(self, chunk: str) -> str:
        text = self.carry + chunk
        m = tk.PARTIAL.search(text)
        cut = m.start() if m else len(text)
        self.carry = text[cut:]
        return tk.restore(text[:cut], self.mapping)[0]

    def flush(self) -> str:
        out, self.carry = tk.restore(self.carry, self.mapping)[0], ""
        return out
