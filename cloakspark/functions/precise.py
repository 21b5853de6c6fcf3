"""The second generation of detectors: higher precision by grammar, context and number ranges.

A detector takes a text and yields (start, end, confidence) in code points; offsets only, never the value.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from . import checksums as ck
from . import legacy
from .patterns import rx

Scan = Callable[[str], Iterator[tuple[int, int, float]]]


@dataclass(frozen=True)
class Detector:
    id: str
    category: str
    scan: Scan
    prefilter: Callable[[str], bool] | None = None
    max_match_length: int | None = None


_LN = r"\p{L}\p{N}"
_EMAIL = (
    rf"(?<![{_LN}%+_-])[{_LN}%+_-](?:[{_LN}%+_.'-]{{0,62}}[{_LN}%+_-])?"
    rf"@((?:[{_LN}](?:[{_LN}-]{{0,61}}[{_LN}])?\.)+)(\p{{L}}{{2,24}}|xn--[0-9a-z-]{{1,59}})(?!\p{{L}})"
)
#: File and unit endings that look like domains.
FILE_ENDINGS = frozenset("bmp css gif ico jpeg jpg js json map mount png scope service slice socket svg target timer webp".split())
USUAL_ENDINGS = frozenset("ai app biz co com dev edu gov info int io me mil name net org pro".split())
_USERINFO = re.compile(r"[a-z][+.0-9a-z-]*://[%*!$+:a-z0-9._~-]*\Z", re.I | re.A)
_MESSAGE_ID = rx(r"~(?:references|in-reply-to|message-id)%s*:%s*(?:<[^<>SPACE]*>%s*)*<[^@<>SPACE]*\Z".replace("SPACE", r"\s"), "i")


def _email(text: str):
    for m in rx(_EMAIL, "ip").finditer(text):
        top = m[2].lower()
        if top in FILE_ENDINGS or re.match(r"[0-9]+\.[0-9]+\.", m[1]) or m[0].startswith("git@"):
            continue
        called = text[m.end() : m.end() + 1] == "("  # a short method call: a@b.foo(
        if called and m[0].index("@") <= 2 < len(top) and top not in USUAL_ENDINGS:
            continue
        before = text[max(0, m.start() - 96) : m.start()]
        if not (_USERINFO.search(before) or _MESSAGE_ID.search(before)):
            yield m.start(), m.end(), 0.99


_TABS = r"[\t ]"
_AT = rf"(?:%s*(?:\{{at\}}|\(at\)|\[at\]|\[@\])%s*|{_TABS}+@{_TABS}*|@{_TABS}+)"
_DOT = r"%s*(?:\{dot\}|\(dot\)|\[dot\]|\[\.\]|\.)%s*"
_LABEL = rf"[{_LN}](?:[{_LN}-]*[{_LN}])?"
_HIDDEN = rf"(?<![{_LN}%+._-])[{_LN}%+_-][{_LN}%+._-]{{0,63}}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,24}}(?![{_LN}])"


def _hidden_email(text: str):
    for m in rx(_HIDDEN, "ip").finditer(text):
        yield m.start(), m.end(), 0.75


_DASH = "‐-―−"
_SSN_GAP = rf"(?:%s?[.{_DASH}-]%s?|%s{{1,2}})"
_SSN = rf"(?<!%d)(?<!%d[./{_DASH}-])(%d{{3}}){_SSN_GAP}(%d{{2}}){_SSN_GAP}(%d{{4}})(?![.{_DASH}-]?%d)"
_SSN_SAID = r"(?:~social%s+security|~ss[n#])(?:%s*(?:num\.?|number|no\.?|#))?[^!.;?0-9\n]{0,24}(%d{9})(?!%d)"
_SSN_BARE = "(?<![,.0-9])(%d{3})(%d{2})(%d{4})(?![,.0-9]?%d)"


def _assigned(area: str, group: str, serial: str) -> bool:
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _ssn(text: str):
    for m in rx(_SSN).finditer(text):
        if _assigned(*m.groups()):
            yield m.start(), m.end(), 0.95
    for m in rx(_SSN_SAID, "i").finditer(text):
        if _assigned(m[1][:3], m[1][3:5], m[1][5:]):
            yield m.start(1), m.end(1), 0.9


def _ssn_bare(text: str):
    for m in rx(_SSN_BARE).finditer(text):
        if _assigned(*m.groups()):
            yield m.start(), m.end(), 0.5


#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    c: int(n)
    for n, codes in (
        line.split(":")
        for line in """15:NO|16:BE|18:DK FI FK FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH HR LI LV|22:BG BH CR DE GB GE IE ME RS VA|23:AE GI IL IQ OM SO TL
24:AD CZ ES MD PK RO SA SE SK TN VG|25:AO CV GW LY PT ST|26:DZ IR IS TR|27:BI CF CG CM FR GA GQ GR IT KM MC MG MR SM TD|28:AL AZ BF BJ BY CI CY DO GT HN HU LB LC_ MA ML NE NI PL SN SV TG
29:BR EG PS QA UA|30:JO KW MU YE|31:MT SC|32:LC|33:RU|27:DJ|25:MZ""".replace("\n", "|").split("|")
    )
    for c in codes.split()
}


def _iban(text: str):
    at = 0
    while m := rx("(?<!%z)[A-Za-z]{2}%d{2}").search(text, at):
        at = m.end()
        size = IBAN_LENGTHS.get(m[0][:2].upper(), 0)
        got, end, gap = "", m.start(), 2
        i = m.start()
        while len(got) < size and i < len(text):
            c = text[i]
            if c.isascii() and c.isalnum():
                got, gap, end = got + c, 0, i + 1
            elif gap < 2 and c in "\t\n\r -\xa0":
                gap += 1
            else:
                break
            i += 1
        after = text[end : end + 1]
        if size and len(got) == size and not (after.isascii() and after.isalnum()) and 2 <= int(got[2:4]) <= 98 and ck.iban(got):
            yield m.start(), end, 0.99
            at = end


_OCT = "(?:2[0-4]%d|25[0-5]|[01]?%d?%d)"
_V4 = rf"(?<![.0-9])({_OCT}\.)({_OCT}\.{_OCT}\.{_OCT})(/(?:[12]?%d|3[0-2])(?![./0-9A-Za-z_]))?(?!\.?%d)"
_OPENS = r"%s*[(:=#\"']{0,3}%s*\Z"
_VERSION = r"(?:version|~firmware|~ver\.?|~rev\.?|~v)" + _OPENS
_PRODUCT = r"(?<![+./0-9A-Za-z_-])(?!(?:inet|ipv4|ip|tcp|udp|sctp|icmp|ssh|dns|peer|host|addr|src|dst)/)[a-z][+.0-9A-Za-z_-]*/%s*\Z"
_NUMBERED = r"(?:~sec\.|~section|~clause|~chapter|~annex|~appendix|~oid|§)" + _OPENS
_RELEASE = r"(?:~build|~release)" + _OPENS
_REFERENCE = r"(?:~Fig\.|~Figure|~Table|~%u{2,6}-%d+)" + _OPENS


def _reserved(o: list[int]) -> bool:
    a, b, c = o[:3]
    return (
        a in (10, 127)
        or (a, b) in ((192, 168), (169, 254))
        or (a == 172 and 16 <= b < 32)
        or (a == 100 and 64 <= b < 128)
        or (a, b, c) in ((192, 0, 2), (198, 51, 100), (203, 0, 113))
    )


def _ipv4(text: str):
    for m in rx(_V4).finditer(text):
        start, end, parts = m.start(), m.end(), (m[1] + m[2]).split(".")
        if parts[0] == "255" or m[0].startswith("0.0.0.0"):
            continue
        if any(len(p) == 2 and p[0] == "0" for p in parts) or ("000" in parts and any(len(p) != 3 for p in parts)):
            continue
        before = text[max(0, start - 48) : start]
        small = all(len(p) <= 2 for p in parts)
        if rx(_VERSION, "i").search(before) or rx(_PRODUCT, "i").search(before) or (small and rx(_NUMBERED, "i").search(before)):
            continue
        if not _reserved([int(p) for p in parts]):
            if rx(_RELEASE, "i").search(before) or (small and rx(_REFERENCE).search(before)):
                continue
            if re.match(r"[.-][A-Za-z]|-[0-9]+[A-Za-z]", text[end : end + 8]):
                continue
        if m[3] and before.endswith("//"):
            end -= len(m[3])
        yield start, end, 0.95


_QUAD = re.compile(r"(?:(?:2[0-4][0-9]|25[0-5]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\Z)|\Z)){4}")
_GROUP = re.compile(r"[0-9A-Fa-f]{1,4}")
_LETTERISH = rx(r"[_\p{N}\p{L}]", "p")


def _groups(side: str, quad: bool) -> int:
    """How many 16-bit groups; a negative number if it isn't a list of groups."""
    n, parts = 0, side.split(":") if side else []
    for i, g in enumerate(parts):
        if _GROUP.fullmatch(g):
            n += 1
        elif quad and i == len(parts) - 1 and g.count(".") == 3 and _QUAD.fullmatch(g):
            n += 2
        else:
            return -100
    return n


def is_ipv6(s: str) -> bool:
    head, found, tail = s.partition("::")
    if not found:
        return not (s.count(":") == 7 and all(len(g) == 2 for g in s.split(":"))) and _groups(s, True) == 8
    if "::" in s[len(head) + 1 :]:
        return False
    a, b = _groups(head, False), _groups(tail, True)
    return a >= 0 and b >= 0 and 0 < a + b <= 7


def _ipv6(text: str):
    for m in rx("[.:0-9A-Fa-f]{2,}").finditer(text):
        start, v = m.start(), m[0]
        glued = start > 0 and bool(_LETTERISH.match(text[start - 1]))
        colon = v.find(":")
        if not v.startswith("::") and (colon == 0 or (glued and 0 < colon <= 2)):
            start, v = start + colon + 1, v[colon + 1 :]
        elif glued:
            continue
        v = v.rstrip(".")
        if v.endswith(":") and not v.endswith("::"):
            v = v[:-1]
        end = start + len(v)
        if not 3 <= len(v) <= 45 or v.count(":") < 2 or _LETTERISH.match(text[end : end + 1]):
            continue
        if not any(c.isdigit() for c in v) and sum(g != "" for g in v.split(":")) < 3:
            continue
        if is_ipv6(v):
            yield start, end, 0.95


#: How card numbers are grouped.
GROUPINGS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 4, 4, 3), (4, 4, 4, 2), (4, 4, 4, 1), (4, 6, 5), (4, 6, 4), (8, 8), (6, 13))
_GAPS = {" ": "space", "\xa0": "space", "-": "-", ".": ".", "\n": "line", "\r\n": "line", **{a + b: "space" for a in " \xa0" for b in " \xa0"}}
_DINERS = re.compile(r"3(?:6|8|9|0[0-5]|095)")


def _issued(d: str, grouped: bool) -> bool:
    """Whether issuers have numbers of this beginning and length."""
    n = len(d)
    within = lambda k, *ranges: any(a <= int(d[:k]) <= b for a, b in ranges)
    if d[0] == "4":
        return n in (13, 16, 19)
    if within(2, (51, 55)) or within(4, (2221, 2720)):
        return n == 16
    if d[:2] in ("34", "37"):
        return n == 15
    if d[0] == "1":
        return grouped and n == 15
    if n == 14:
        return bool(_DINERS.match(d))
    return n >= 16 and (bool(_DINERS.match(d)) or within(2, (50, 50), (56, 69), (81, 82), (31, 31)) or within(3, (644, 649)) or within(4, (2200, 2205), (3528, 3589), (6011, 6011), (8600, 8600), (9860, 9860), (9792, 9792), (9704, 9704)))


def _card(text: str):
    runs = [m.span() for m in rx("%d+").finditer(text)]
    found: list[tuple[int, int, float]] = []  # first run, end, confidence
    reach: dict[int, int] = {}
    for i, (a, b) in enumerate(runs):
        hits = []
        if 13 <= b - a <= 19:
            if _issued(text[a:b], False) and ck.luhn(text[a:b]):
                hits.append((b, 0.92))
        else:
            for g in GROUPINGS:
                own = runs[i : i + len(g)]
                if g[0] != b - a or [y - x for x, y in own] != list(g):
                    continue
                gaps = [_GAPS.get(text[x[1] : y[0]]) for x, y in zip(own, own[1:])]
                digits = "".join(text[x:y] for x, y in own)
                if None in gaps or not ck.luhn(digits):
                    continue
                even = len(set(gaps)) == 1
                if _issued(digits, True):
                    hits.append((own[-1][1], 0.97 if even else 0.85))
                elif even and g == (4, 4, 4, 4) and len(set(digits)) > 1:
                    hits.append((own[-1][1], 0.6))
        for end, c in hits:
            found.append((i, end, c))
            reach[i] = max(reach.get(i, 0), end)
    covered = -1
    for i, end, c in found:
        if end <= covered:
            continue
        if runs[i][0] < covered:  # out of phase: one that begins after the last one and reaches as far is the better reading
            j = i
            while j < len(runs) and runs[j][0] < covered:
                j += 1
            if reach.get(j, 0) >= end:
                continue
        yield runs[i][0], end, c
        covered = max(covered, end)


def _masked(text: str):
    for m in rx("(?<![*0-9A-Za-z_])(?:[Xx*•]{4}(?:-| )?){2,3}(?:%d{4}|[Xx*•]{2}%d{2})(?!%d)").finditer(text):
        yield m.start(), m.end(), 0.8


def from_legacy(category: str, detect: Callable[[str], list[legacy.Match]], id: str | None = None) -> Detector:
    return Detector(id or category, category, lambda t: ((s, e, c) for _, _, s, e, c in detect(t)), legacy.PREFILTERS.get(category))


def _has(pattern: str) -> Callable[[str], bool]:
    return lambda t: rx(pattern).search(t) is not None


PRECISE: dict[str, tuple[Detector, ...]] = {
    "email": (Detector("email", "email", _email, lambda t: "@" in t, 320), Detector("email/obfuscated", "email", _hidden_email, lambda t: "@" in t or "at" in t.lower(), 320)),
    "ssn": (Detector("ssn", "ssn", _ssn, _has("%d{4}"), 48), Detector("ssn/bare", "ssn", _ssn_bare, _has("%d{9}"), 12)),
    "iban": (Detector("iban", "iban", _iban, _has("[A-Za-z]{2}%d{2}"), 72),),
    "ipv4": (Detector("ipv4", "ipv4", _ipv4, _has(r"%d\.%d"), 40),),
    "ipv6": (Detector("ipv6", "ipv6", _ipv6, lambda t: ":" in t, 64),),
    "credit-card": (Detector("credit-card", "credit-card", _card, _has("%d{4}"), 48), Detector("credit-card/masked", "credit-card", _masked, _has("[Xx*•]{4}"), 24)),
    "national-id": (from_legacy("national-id", legacy.strict_national_id, "national-id/strict"),),
}


def builtin(categories=None, *, detection: str = "precise", aggressive: bool = False) -> list[Detector]:
    """The detectors of the categories, in their order; of precise ones, the second of a pair only if aggressive."""
    out = []
    for c in dict.fromkeys(legacy.CATEGORIES if categories is None else categories):
        if c not in legacy.DETECTORS:
            from ..errors import UnknownCategoryError

            raise UnknownCategoryError(c)
        if detection == "precise" and c in PRECISE:
            out += PRECISE[c] if aggressive else PRECISE[c][:1]
        else:
            out.append(from_legacy(c, (legacy.AGGRESSIVE if aggressive else legacy.DETECTORS)[c]))
    return out
