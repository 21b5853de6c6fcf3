"""Overlapping candidates, resolved: legacy keeps the earliest start, cover leaves no reported character out."""

from __future__ import annotations

from dataclasses import dataclass

from .patterns import SPACE, rx

_SPACE = rx(f"[{SPACE}]")


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    confidence: float
    detector: int
    allowed: bool = False


#: start, end, confidence, detector, residual
Span = tuple[int, int, float, int, bool]


def legacy(candidates: list[Candidate]) -> list[Span]:
    out, cursor = [], 0
    for c in sorted(candidates, key=lambda c: (c.start, -c.confidence)):
        if c.start >= cursor:
            cursor = c.end
            if not c.allowed:
                out.append((c.start, c.end, c.confidence, c.detector, False))
    return out


def _cluster(text: str, own: list[Candidate]) -> list[Span]:
    if len(own) == 1:
        return [] if own[0].allowed else [(own[0].start, own[0].end, own[0].confidence, own[0].detector, False)]
    base = min(c.start for c in own)
    claimed = bytearray(max(c.end for c in own) - base)
    out: list[Span] = []
    for c in sorted(own, key=lambda c: (-c.confidence, c.start - c.end, c.start, c.detector)):
        a, b = c.start - base, c.end - base
        if not any(claimed[a:b]):
            claimed[a:b] = b"\1" * (b - a)
            if not c.allowed:
                out.append((c.start, c.end, c.confidence, c.detector, False))
            continue
        if c.allowed:
            continue
        at = claimed.find(0, a, b)
        while at >= 0:
            stop = claimed.find(1, at, b)
            stop = b if stop < 0 else stop
            s, e = at + base, stop + base
            while s < e and _SPACE.match(text[s]):
                s += 1
            while e > s and _SPACE.match(text[e - 1]):
                e -= 1
            if s < e:
                claimed[s - base : e - base] = b"\1" * (e - s)
                out.append((s, e, c.confidence, c.detector, True))
            at = claimed.find(0, stop, b)
    return out


def cover(text: str, candidates: list[Candidate]) -> list[Span]:
    """Clusters of touching candidates: the most confident, then longest one is whole, what it leaves of others are residues."""
    out: list[Span] = []
    own: list[Candidate] = []
    end = -1
    for c in sorted(candidates, key=lambda c: (c.start, c.end)):
        if own and c.start >= end:
            out += _cluster(text, own)
            own, end = [], -1
        own.append(c)
        end = max(end, c.end)
    if own:
        out += _cluster(text, own)
    return sorted(out, key=lambda s: s[0])


def resolve(text: str, candidates: list[Candidate], policy: str = "cover") -> list[Span]:
    return legacy(candidates) if policy == "legacy" else cover(text, candidates)
