"""The first generation of detectors: 27 categories, each a table of rules over one text.

A rule is a pattern and a confidence, which may depend on the value and on whether a label ends at most so many
characters before it. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import regex

from . import checksums as ck
from .patterns import rx

_DIGIT = rx("%d")

#: category, value, start, end, confidence
Match = tuple[str, str, int, int, float]
Confidence = Callable[[str, bool], "float | None"]


@dataclass(frozen=True)
class Rule:
    pattern: str
    confidence: float | Confidence
    flags: str = ""
    label: str | None = None  # another label than the category's


@dataclass(frozen=True)
class Table:
    rules: tuple[Rule, ...]
    label: str = ""
    reach: int = 0
    label_flags: str = "i"

    @cached_property
    def compiled(self) -> list[tuple]:
        """finditer, confidence, whether that is a function, label, whether there is nothing without the label."""
        return [(rx(r.pattern, r.flags).finditer, r.confidence, callable(r.confidence), r.label or self.label, hasattr(r.confidence, "labelled_only")) for r in self.rules]


def _labelled_only(f: Confidence) -> Confidence:
    """Marks a confidence that nothing has without a label: where a text has none, its pattern needn't be tried."""
    f.labelled_only = True
    return f


def near(c: float) -> Confidence:
    return _labelled_only(lambda value, labelled: c if labelled else None)


def by(far: float, close: float) -> Confidence:
    return lambda value, labelled: close if labelled else far


def valid(check: Callable[[str], bool], then: float | Confidence) -> Confidence:
    f = lambda value, labelled: (then(value, labelled) if callable(then) else then) if check(value) else None
    return _labelled_only(f) if hasattr(then, "labelled_only") else f


def raised(c: float, more: float, most: float, needs: bool = False, check: Callable[[str], bool] | None = None) -> Confidence:
    def rule(value: str, labelled: bool) -> float | None:
        if (needs and not labelled) or (check is not None and not check(value)):
            return None
        return min(c + more, most) if labelled else c

    return _labelled_only(rule) if needs else rule


def _label_ends(pattern: str, flags: str, text: str) -> list[int]:
    return [m.end() for m in rx(pattern, flags).finditer(text)]


def scan_table(category: str, table: Table, text: str) -> list[Match]:
    out, seen, ends = [], set(), {}
    for matches, confident, asks, label, labelled_only in table.compiled:
        if label and labelled_only:
            if label not in ends:
                ends[label] = _label_ends(label, table.label_flags, text)
            if not ends[label]:
                continue
        for m in matches(text):
            if (m.start(), m.end()) in seen:
                continue
            confidence = confident
            if asks:
                labelled = False
                if label:
                    if label not in ends:
                        ends[label] = _label_ends(label, table.label_flags, text)
                    at = bisect_right(ends[label], m.start()) - 1
                    labelled = at >= 0 and m.start() - ends[label][at] <= table.reach
                confidence = confident(m[0], labelled)
            if confidence is not None:
                seen.add((m.start(), m.end()))
                out.append((category, m[0], m.start(), m.end(), confidence))
    return out


_OCTET = "(?:2[0-4]%d|25[0-5]|[01]?%d%d?)"
_HOST = "%z(?:[0-9A-Za-z-]{0,61}%z)?"
_HEX = "[0-9A-Fa-f]{1,4}"
_B58 = "[1-9A-HJ-NP-Za-km-z]"
_MONTH = "(?:" + "|".join("January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec".split()) + ")"
_YEAR, _MM, _DD = "(?:20|19)%d{2}", "(?:1[0-2]|0[1-9])", "(?:3[01]|0[1-9]|[12]%d)"
_DAY = "(?:0?[1-9]|3[01]|[12]%d)"
_DEA = "~[A-HJ-NPR-UX][A-Z9]%d{7}~"
_NUMBER = "(?:number|no\\.?|#)"
_END = "%s*:?%s*"
_MBI, _MBN = "[AC-HJ-NP-RT-Y]", "[0-9AC-HJ-NP-RT-Y]"


def _url_part() -> str:
    from .patterns import SPACE

    return rf"[^{SPACE},;'\"<>()\[\]{{}}]*"


_V6 = "|".join(
    [f"~(?:{_HEX}:){{7}}{_HEX}~", f"~(?:{_HEX}:){{1,7}}:~", f"~(?:{_HEX}:){{1,6}}:{_HEX}~"]
    + [f"~(?:{_HEX}:){{1,{7 - n}}}(?::{_HEX}){{1,{n}}}~" for n in range(2, 6)]
    + [f"~{_HEX}:(?::{_HEX}){{1,6}}~", f"~:(?::{_HEX}){{1,7}}~", f"~::(?:[Ff]{{4}}(?::0{{1,4}})?:)?{_OCTET}(?:\\.{_OCTET}){{3}}~"]
)

TABLES: dict[str, Table] = {
    "email": Table((Rule(rf"~[0-9A-Za-z.!#$&'*+/=?^_`{{|}}%\x7e-]+@{_HOST}(?:\.{_HOST})*\.[A-Za-z]{{2,}}~", 0.99),)),
    "ssn": Table((Rule("~(?!9%d{2}|666|000)%d{3}[- ]?(?!00)%d{2}[- ]?(?!0000)%d{4}~", 0.95),)),
    "credit-card": Table((Rule("~(?:%d[ -]?){13,19}~", valid(lambda v: 13 <= len(d := v.replace(" ", "").replace("-", "")) <= 19 and ck.luhn(d), 0.97)),)),
    "ipv4": Table((Rule(rf"~(?:{_OCTET}\.){{3}}{_OCTET}(?:/%d{{1,2}})?~", 0.98),)),
    "ipv6": Table((Rule(_V6, 0.98),)),
    "url": Table((Rule(rf"~https?://(?:(?:[0-9A-Za-z-]+\.)+[A-Za-z]{{2,}}|localhost|(?:%d{{1,3}}\.){{3}}%d{{1,3}})(?::%d{{1,5}})?(?:/{_url_part()})?(?:\?{_url_part()})?(?:\#{_url_part()})?~", 0.95),)),
    "iban": Table((Rule("~%u{2}%d{2} ?(?:%m{4} ?){1,7}%m{1,4}~", valid(lambda v: 5 <= len(c := v.replace(" ", "")) <= 34 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1, 0.99)),)),
    "passport": Table(
        tuple(Rule(p, raised(c, 0.15, 0.95, needs=c < 0.7)) for p, c in (("~%u%d{8}~", 0.75), ("~%u{2}%d{6}~", 0.75), ("~%u%d{7}~", 0.73), ("~%d{9}~", 0.6), ("~%u{1,2}%d{5,8}~", 0.7))),
        r"~passport(?:%s+(?:no\.?|number|\#))?" + _END,
        30,
    ),
    "drivers-license": Table(
        (Rule("~[9A-Z]{5}%d{6}[02-9]%d%u{2}%w{2}~", 0.78), Rule("~%m{5,15}~", near(0.85))),
        rf"~(?:driving%s+licen[cs]e|driver(?:'?s)?%s+licen[cs]e|DL%s*\#?|D\.?L\.?(?:%s*\#)?|licen[cs]e%s+(?:\#|no|number))" + _END,
        20,
    ),
    "bank-account": Table(
        (
            Rule("~(?:80|[026][1-9]|[137][0-2])%d{7}~", lambda v, n: (0.9 if ck.CHECKSUMS["aba-routing"](v) else 0.85) if n else None),
            Rule("~%d{2}-%d{2}-%d{2}~", 0.8),
            Rule("~%u{6}%m{2}(?:%m{3})?~", 0.82),
            Rule("~%d{7,18}~", near(0.8)),
        ),
        r"~(?:SWIFT|BIC|IBAN|ABA|bank%s+account|sort%s+code|routing%s+(?:no\.?|number|\#)|account%s+(?:no\.?|number|\#))" + _END,
        30,
    ),
    "cryptocurrency": Table(
        tuple(
            Rule(p, raised(c, 0.03, 0.99, needs=n))
            for p, c, n in (
                ("~0x[0-9A-Fa-f]{40}~", 0.97, False),
                ("~bc1[0-9a-z]{39,59}~", 0.95, False),
                ("~addr1[0-9a-z]{58,98}~", 0.92, False),
                (f"~1{_B58}{{25,34}}~", 0.88, False),
                (f"~3{_B58}{{25,34}}~", 0.85, False),
                (f"~L{_B58}{{26,33}}~", 0.83, False),
                (f"~M{_B58}{{26,33}}~", 0.8, False),
                (f"~4[AB0-9]{_B58}{{93}}~", 0.9, False),
                (f"~r{_B58}{{24,33}}~", 0.78, True),
                (f"~{_B58}{{43,44}}~", 0.72, True),
            )
        ),
        "~(?:crypto(?:currency)?(?:%s+address)?|wallet(?:%s+address)?|" + "|".join("bitcoin btc ethereum eth litecoin ltc monero xmr ripple xrp solana sol cardano ada address".split()) + ")" + _END,
        40,
    ),
    "tax-id": Table(
        (
            Rule("~%d{2}-%d{7}~", by(0.8, 0.92)),
            Rule("~9%d{2}[%s-](?:5%d|6[0-5]|7%d|8[0-8]|9[0-24-9])[%s-]%d{4}~".replace("[%s-]", "(?:%s|-)"), 0.9),
            Rule("~(?:" + "|".join("AT BE BG CY CZ DE DK EE EL ES FI FR GB HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK".split()) + ")(?:%s|-)?%m{8,12}~", by(0.78, 0.9)),
            Rule("~%d{2}%s?%d{3}%s?%d{3}%s?%d{3}~", near(0.82)),
            Rule(r"~%m{2}\.%m{3}\.%m{3}/%m{4}-%d{2}~", valid(ck.cnpj, 0.95), "i"),
            Rule("~%m{12}%d{2}~", valid(ck.cnpj, near(0.9)), "i"),
            Rule("~%d{10}~", near(0.85)),
        ),
        rf"~(?:ABN|CNPJ|EIN|ITIN|TFN|T\.?I\.?N\.?|UTR|tax(?:%s+(?:id(?:entification)?|reference|{_NUMBER}))?|VAT(?:%s+(?:reg(?:istration)?|{_NUMBER}))?)".replace("#", r"\#") + _END,
        30,
    ),
    "medical-record": Table(
        (
            Rule(_DEA, valid(ck.dea, 0.9), "i"),
            Rule("~[12]%d{9}~", valid(lambda v: ck.luhn("80840" + v), by(0.75, 0.88))),
            Rule("~%m{6,12}~", near(0.85)),
        ),
        rf"~(?:MRN|chart%s+{_NUMBER}|patient%s+(?:id|{_NUMBER})|medical%s+record%s+{_NUMBER})".replace("#", r"\#") + _END,
        30,
    ),
    "health-insurance": Table(
        (
            Rule(f"~[1-9]{_MBI}%d{_MBI}{_MBN}%d{_MBI}{_MBN}{{2}}%d{{2}}~", by(0.8, 0.9), "i"),
            Rule("~%d{3}(?:%s|-)%d{3}(?:%s|-)%d{4}~|~%d{10}~", valid(ck.CHECKSUMS["nhs"], by(0.82, 0.92))),
            Rule("~%u{2}%d{6,10}~", near(0.78)),
            Rule("~%m{8,14}~", near(0.75)),
        ),
        rf"~(?:medicare|medicaid|EHIC|NHS(?:%s+{_NUMBER})?|health%s+insurance(?:%s+(?:id|card|{_NUMBER}))?|insurance%s+(?:id|member%s+id|{_NUMBER})|member%s+(?:no\.?|number|id)|policy%s+{_NUMBER}|beneficiary%s+(?:number|id))".replace("#", r"\#") + _END,
        40,
    ),
    "prescription": Table(
        (
            Rule(_DEA, valid(ck.dea, 0.9), "i"),
            Rule("|".join(f"~%d{{{a}}}-%d{{{b}}}-%d{{{c}}}~" for a, b, c in ((4, 4, 2), (5, 3, 2), (5, 4, 1), (5, 4, 2))), by(0.78, 0.9)),
            Rule("~%d{4,12}~", near(0.82)),
        ),
        rf"~(?:NDC|drug%s+code|(?:Rx|DEA|prescription)%s*(?:{_NUMBER})?|prescription%s+id)".replace("#", r"\#") + _END,
        30,
    ),
    "api-key": Table(
        tuple(
            Rule(f"~{p}~", c)
            for p, c in (
                ("AKIA%m{16}", 0.99),
                ("sk_live_%z{24,99}", 0.99),
                ("pk_live_%z{24,99}", 0.99),
                ("[ps]k_test_%z{24,99}", 0.97),
                *((f"gh{k}_%z{{36}}", 0.99) for k in "pos"),
                ("ghr_%z{36,76}", 0.99),
                ("github_pat_%w{59,}", 0.99),
                *((f"xox{k}-[0-9A-Za-z-]{{40,}}", c) for k, c in zip("bpas", (0.98, 0.98, 0.98, 0.96))),
                ("sk-%z{32,}", 0.9),
                ("AIza[0-9A-Za-z_-]{35}", 0.99),
                (r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{20,}", 0.95),
            )
        )
        + (Rule("~[0-9A-Za-z_.-]{20,80}~", near(0.82)),),
        "~(?:x-api-key|credentials?|bearer(?:%s+token)?|(?:api|access)(?:%s|[_-])?token|(?:api|secret)(?:%s|[_-])?key|auth(?:orization)?(?:%s|[_-])?(?:token|key))%s*[=:]%s*",
        10,
    ),
    "social-media": Table(
        (
            Rule("(?<!%z)@%w{1,15}(?![@0-9A-Za-z_])", 0.78),
            Rule("~UC[0-9A-Za-z_-]{22}~", 0.9),
            Rule("~(?:/u|u)/[0-9A-Za-z_-]{3,20}~", 0.85),
            Rule(r"~linkedin\.com/in/[0-9A-Za-z-]{3,100}~", 0.92, "i"),
            Rule("~%d{17,19}~", near(0.85)),
        ),
        "~(?:uid|user%s+id|discord(?:%s+(?:user|id|guild|server))?)" + _END,
        30,
    ),
    "vin": Table((Rule("~[0-9A-HJ-NPR-Z]{17}~", valid(ck.vin, 0.95), "i"),)),
    "license-plate": Table(
        (
            Rule("~%u{2}%d{2}%s?%u{3}~", by(0.78, 0.9), "i"),
            Rule("~%u%d{1,4}%s?%u{3}~", by(0.7, 0.85), "i"),
            Rule("~%u{1,2}(?:%s|-)?%d{1,4}(?:%s|-)?%u{1,3}~", near(0.82), "i"),
            Rule("~%m{2,8}~", near(0.8)),
        ),
        r"~(?:licen[cs]e%s+plate|number%s+plate|plate(?:%s+(?:no\.?|number))?|registration%s+(?:number|plate)|reg(?:istration)?%s*(?::|\#|no\.?))" + _END,
        20,
    ),
    "tracking-number": Table(
        (
            Rule("~1Z%m{16}~", 0.96, "i"),
            Rule("~TBA%d{12}~", 0.97, "i"),
            Rule("~(?:%u{2}%d{9}US|9[2-5]%d{18,20})~", 0.9, "i"),
            Rule("~JD%d{9}~|~%d{10,11}~", lambda v, n: 0.88 if v[:2] in ("JD", "jd") else 0.78 if n else None, "i"),
            Rule("~%d{20,22}~", near(0.8)),
            Rule("~(?:%d{20,22}|%d{15}|%d{12})~", near(0.78)),
        ),
        r"~(?:tracking(?:%s+(?:id|no\.?|number|\#))?|shipment(?:%s+(?:id|number|tracking))?|parcel(?:%s+(?:id|number))?|package(?:%s+(?:id|number|tracking))?|(?:amazon|dhl|usps|ups|fedex)%s+(?:shipment|tracking)?)" + _END,
        30,
    ),
    "case-number": Table(
        (
            Rule("~(?:%d:%s*)?%d{2}(?:%s|-)(?:" + "|".join("adv ap bk br civ crim cr cv mc mj po".split()) + ")(?:%s|-)%d{4,6}~", by(0.8, 0.92), "i"),
            Rule("~(?:%u{1,4}(?:-|%s))?%d{2,4}[/-]%d{2,6}(?:[/-]%m{1,5})?~", near(0.78), "i"),
        ),
        rf"~(?:case(?:%s+(?:id|{_NUMBER}))?|docket(?:%s+{_NUMBER})?|file%s+{_NUMBER}|matter%s+no\.?|civil%s+action|criminal%s+(?:#|no\.?|case)|court%s+(?:case|file(?:%s+no\.?)?))".replace("#", r"\#") + _END,
        30,
    ),
    "company-registration": Table(
        (
            Rule("~%d{2}-%d{7}~", by(0.72, 0.88)),
            Rule("~(?:%d{8}|%u{2}%d{6})~", near(0.85), "i"),
            Rule("~%d{3}%s?%d{3}%s?%d{3}~", near(0.82)),
            Rule("~%u{2}(?:-|%s)?%m{5,12}~", near(0.78)),
        ),
        rf"~(?:ABN|ACN|CIK|company%s+reg(?:istration)?%s*(?:{_NUMBER})?|companies%s+house%s*(?:{_NUMBER})?|incorporation%s*(?:{_NUMBER})?|registered%s+(?:company%s+number|number|no\.?)|company%s+{_NUMBER}|corporate%s+(?:registration|number|no\.?|id)|business%s+(?:number|registration))".replace("#", r"\#") + _END,
        30,
    ),
}

_NATIONAL_LABEL = (
    r"~(?:identificat(?:or|ion)|id%s+(?:\#|no\.?|number)|citizen(?:ship)?%s+(?:id|number)|personal%s+(?:identification|id)%s*(?:number|no\.?)?|national%s+(?:identification|identity|id)%s*(?:card|\#|no\.?|number)?)" + _END
)
_RG_LABEL = r"~(?:R\.G\.|RG|registro%s+geral|identidade|(?:c[éÉe]dula|carteira)%s+de%s+identidade)%s*(?:n[o.º°]?%s*)?:?%s*"
_SEP = "(?:-|%s)"
#: pattern, confidence, needs a label, checksum, another label
NATIONAL = (
    (f"~%d{{3}}{_SEP}%d{{3}}{_SEP}%d{{3}}~", 0.85, False, ck.luhn, None),
    ("~%u{4}%d{6}[MH]%u{5}%m%d~", 0.9, False, None, None),
    ("~[A-ZÑ&]{3,4}%d{6}%m{3}~", 0.78, True, None, None),
    (f"~[A-CEGHJ-PR-TW-Z]{{2}}{_SEP}?%d{{2}}{_SEP}?%d{{2}}{_SEP}?%d{{2}}{_SEP}?[A-D]~", 0.9, False, ck.nino, None),
    (f"~[2-9]%d{{3}}{_SEP}?%d{{4}}{_SEP}?%d{{4}}~", 0.82, False, ck.verhoeff, None),
    ("~%d{17}[X0-9]~", 0.8, True, ck.CHECKSUMS["cn-resident-id"], None),
    (f"~%d{{6}}{_SEP}%d{{7}}~", 0.87, False, None, None),
    (rf"~%d{{3}}\.%d{{3}}\.%d{{3}}{_SEP}%d{{2}}~", 0.92, False, ck.cpf, None),
    ("~%d{6}[+-]%d{4}~", 0.87, False, ck.se_personnummer, None),
    ("~(?:[X-Z]%d{7}%u|%d{8}%u)~", 0.82, False, ck.es_dni, None),
    ("~%u{6}%d{2}[A-EHLMPRST]%d{2}%u%d{3}%u~", 0.88, False, ck.it_fiscal_code, None),
    ("~[12]" + "%s?%d{2}" * 3 + "%s?%d{3}" * 2 + "%s?%d{2}~", 0.84, False, ck.fr_nir, None),
    (r"~%d{2,3}(?:%s|\.)?%d{3}(?:%s|\.)?%d{3}~", 0.75, True, None, None),
    ("~%d{13}~", 0.72, True, ck.luhn, None),
    ("~%d{11}~", 0.7, True, None, None),
    (f"~%d{{3}}{_SEP}?%d{{3}}{_SEP}?%d{{3}}~", 0.75, True, ck.CHECKSUMS["au-tfn"], None),
    ("~%m{9}~", 0.75, True, None, None),
    ("~[1-9]%d{8}~", 0.7, True, ck.CHECKSUMS["pt-nif"], None),
    ("~%d{9}~", 0.7, True, ck.CHECKSUMS["bsn"], None),
    (r"~%d{1,2}\.?%d{3}\.?%d{3}-?[0-9Xx]~", 0.85, True, None, _RG_LABEL),
)


def _national(strict: bool) -> Table:
    return Table(tuple(Rule(p, raised(c, 0.05, 0.97, needs, check if strict else None), "", own) for p, c, needs, check, own in NATIONAL), _NATIONAL_LABEL, 40)


TABLES["national-id"] = _national(False)
STRICT_NATIONAL = _national(True)

_PHONE = r"(?<!%d)(?:\+?1[-.%s]?)?(?:%d{3}|\(%d{3}\))[-.%s]?%d{3}[-.%s]?%d{4}(?!%d)|\+(?:%d[ .()-]{0,2}){6,14}%d(?!%d)".replace("[-.%s]", r"(?:[.-]|%s)")
_TAIL = r"(?![ ./-]?%d)"
_GAP = r"(?:[.-]|%s)"
_NATIONAL_PHONES = (
    (rf"\(0?[1-9]{{2}}\)%s?(?:9%s?%d{{4}}|[2-5]%d{{3}}){_GAP}?%d{{4}}", 0.88),
    (r"0?[1-9]{2}(?:\.|%s)?(?:9%s?%d{4}|[2-5]%d{3})(?:-|%s)%d{4}", 0.82),
    (rf"0[1-9]({_GAP})%d{{2}}(?:\1%d{{2}}){{3}}", 0.85),
    (r"0(?:%d{4} %d{5,6}|%d{2} %d{4} %d{4}|%d{3} %d{3} %d{4})", 0.82),
    (r"(?:9[1-8] %d{3}(?: %d{2}){2}|[6-9]%d{2}(?: %d{2}){3})", 0.8),
    (r"0%d{1,3} %d{3,4} %d{3,4}", 0.78),
    (r"0[1-9]%d{1,4}[ /-]%d{5,8}", 0.76),
)


def _phone(text: str) -> list[Match]:
    out = [("phone", m[0].strip(), m.start(), m.end(), 0.9) for m in rx(_PHONE).finditer(text) if sum(c.isdigit() for c in m[0]) >= 7]
    for p, c in _NATIONAL_PHONES:
        for m in rx("(?<![+0-9])" + p + _TAIL).finditer(text):
            if not any(s <= m.start() and m.end() <= e for _, _, s, e, _ in out):
                out.append(("phone", m[0], m.start(), m.end(), c))
    return out


_DOB = (
    (f"~{_YEAR}[/ -]{_MM}[/ -]{_DD}~", 0.85),
    (f"~{_MM}[/-]{_DD}[/-]{_YEAR}~", 0.8),
    (f"~{_DD}[./]{_MM}[./]{_YEAR}~", 0.78),
    (f"~{_MONTH}%s+{_DAY},?%s+{_YEAR}~", 0.88),
    (f"~{_DAY}%s+{_MONTH}%s+{_YEAR}~", 0.88),
)


def _birth(text: str) -> list[Match]:
    found = [("date-of-birth", m[0], m.start(), m.end(), c) for p, c in _DOB for m in rx(p).finditer(text)]
    kept: list[tuple[int, int]] = []  # disjoint, sorted
    out = []
    for match in sorted(found, key=lambda x: -x[4]):
        at = bisect_left(kept, (match[2], match[3]))
        if (at == 0 or kept[at - 1][1] <= match[2]) and (at == len(kept) or match[3] <= kept[at][0]):
            kept.insert(at, (match[2], match[3]))
            out.append(match)
    return sorted(out, key=lambda x: x[2])


_NAMES = "([A-Z][a-z]+(?:%s+[A-Z][a-z]+){n})"
_HELLO = r"(?:^|\.%s+)(?:hey there|hey|hi|hello|dear|greetings)%s+"
_TITLE = "~(?:" + "|".join(["Mrs", "Mr", "Ms", "Miss", "Mx", "Dr", "Prof(?:essor)?", "Rev(?:erend)?", "Hon(?:orable)?", "Capt(?:ain)?", "Commander", "Cmdr", "Lieu?t(?:enant)?", "Lt", "Sergeant", "Sgt", "Father", "Fr", "Sister", "Sr", "Brother", "Br", "Esquire", "Esq"]) + r")\.?%s+"
_ROLES = (
    "patient client defendant plaintiff applicant appellant respondent petitioner claimant employee employer teacher student author by from to".split()
    + [f"{w} by" for w in "signed authored submitted prepared filed reviewed approved written sent received".split()]
    + ["referring to", "regarding", "re:", "concerning", "subject:", "for", "name:", "full name:", "contact:"]
)
_ROLE = "~(?:" + "|".join(_ROLES) + ")%s+"
#: The broad pattern has all words in one alternation, whose bars it once escaped by mistake: only the whole list would match.
_BROAD = [_HELLO + _NAMES.replace("{n}", "*"), _TITLE + _NAMES.replace("{n}", "*"), "~" + "".join("\\" + c if c in "|. :" else c for c in "|".join(_ROLES)) + "%s+" + _NAMES.replace("{n}", "+")]


def _names(text: str, pattern: str, flags: str, confidence: float) -> list[Match]:
    out = []
    for m in rx(pattern, flags).finditer(text):
        raw = next((g for g in m.groups() if g is not None), "").strip()
        at = text.find(raw, m.start()) if raw else -1
        if at >= 0 and "A" <= text[at] <= "Z" and (name := rx("[A-Z][a-z]+(?:%s+[A-Z][a-z]+)*").match(text, at)):
            out.append(("name", name[0], at, name.end(), confidence))
    return out


def greedy(matches: list[Match]) -> list[Match]:
    """The earliest start first, of equal ones the most confident; what begins before the last one's end is dropped."""
    out, cursor = [], 0
    for m in sorted(matches, key=lambda x: (x[2], -x[4])):
        if m[2] >= cursor:
            out.append(m)
            cursor = m[3]
    return out


def _name(text: str) -> list[Match]:
    parts = ((_HELLO + _NAMES.replace("{n}", "+"), "i", 0.75), (_TITLE + _NAMES.replace("{n}", "*"), "", 0.78), (_ROLE + _NAMES.replace("{n}", "+"), "", 0.7))
    return greedy([m for p in parts for m in _names(text, *p)])


_UL = r"[\p{L}'-]"
_TOWN = rf"(?:,?%s+(?:%u{{1,2}}-)?%d{{4,5}}(?:%s%u{{2}}|-%d{{3}})?%s+\p{{Lu}}{_UL}+(?:%s\p{{Lu}}{_UL}+)?)?"
_SUFFIX = "(?:" + "|".join(r"str\. stra(?:ss|ß)e weg gasse platz allee damm ufer straat laan gracht plein kade singel gatan vägen veien gade".split()) + ")"
_STREET_WORD = r"(?:Str\.|Stra(?:ss|ß)e|" + "|".join("Weg Gasse Platz Allee Damm Ufer Straat Laan".split()) + ")"
_TYPE = "(?:" + "|".join(r"[Rr]ue [Aa]venue [Bb]oulevard [Bb]d [Cc]hemin [Ii]mpasse [Aa]llée [Qq]uai Calle C/ Avenida Avda\. Av\. Paseo Plaza Carrer Via Viale Piazza Corso Largo Rua Travessa Praça Alameda Estrada Rodovia".split()) + ")"
_LINK = "(?:(?:" + "|".join("de la|della|delle|del|dei|des|de|du|d'|di|da|das|do|dos|la|las|le|l'|los|el".split("|")) + ")%s?)"
_STREET = rf"{_LINK}{{0,3}}\p{{Lu}}{_UL}*(?:%s{_LINK}{{0,3}}\p{{Lu}}{_UL}*){{0,3}}"
_NOT = r"(?<![0-9\p{L}])"
_US = (
    "~%d{1,5}%s+(?:(?:" + "|".join("NE|NW|SE|SW|N|S|E|W|Northeast|Northwest|Southeast|Southwest|North|South|East|West".split("|")) + r")\.?%s+)?(?:%u[a-z]+%s+){1,4}(?:"
    + "|".join("St(?:reet)? Ave(?:nue)? Boulevard Blvd Dr(?:ive)? Road Rd Lane Ln Court Ct Place Pl Circle Cir Way Parkway Pkwy Highway Hwy Trail Trl Terr(?:ace)?".split()) + r")\.?(?:%s+(?:Apartment|Apt|Suite|Ste|Unit|\#)%s*%w+)?~"
)
_LABELLED = "(?:" + "|".join(r"mailing address|billing address|home address|office address|headquartered at|residence|resides at|shipped? to|located at|lives at|address(?:ed to)?".split("|")) + r")%s*:?%s*([^,\n]{10,80})"


_ADDRESS_WORDS = ("address", "lives at", "located at", "ship", "residence", "resides at", "headquartered")


def _address(text: str) -> list[Match]:
    found: dict[tuple[int, int], Match] = {}
    streets: list[tuple[int, int]] = []

    def put(value: str, start: int, end: int, c: float) -> None:
        found.setdefault((start, end), ("address", value, start, end, c))

    digits = _DIGIT.search(text) is not None  # only labelled addresses have none
    for m in rx(_US, "i").finditer(text) if digits else ():
        put(m[0], m.start(), m.end(), 0.8)
    absorbed: set[tuple[int, int]] = set()
    for p in (
        rf"{_NOT}(?:\p{{Lu}}\p{{Ll}}*{_SUFFIX}|\p{{Lu}}\p{{Ll}}+(?:-|%s){_STREET_WORD})%s+%d{{1,4}}%s?[a-z]?(?![0-9\p{{L}}]){_TOWN}",
        rf"{_NOT}%d{{1,4}}(?:%s?(?:ter|bis))?,?%s+{_TYPE}%s+{_STREET}{_TOWN}",
        rf"{_NOT}{_TYPE}%s+{_STREET},?%s+(?:n[o.º°]%s?)?%d{{1,5}}[A-Za-z]?(?![0-9\p{{L}}]){_TOWN}",
    ):
        for m in rx(p, "p").finditer(text) if digits else ():
            a, b = m.span()
            live = [k for k in found if k not in absorbed]
            if any(s <= a and b <= e for s, e in live):
                continue
            absorbed.update(k for k in live if a <= k[0] and k[1] <= b)
            put(m[0], a, b, 0.8)
            streets.append((a, b))
    for p, c in ((r"~%u{1,2}%d%m?%s*%d%u{2}~", 0.78), (r"~P\.?O\.?%s+Box%s+%d+~", 0.85)):
        for m in rx(p, "i").finditer(text) if digits else ():
            put(m[0], m.start(), m.end(), c)
    low = text.lower()
    for m in rx(_LABELLED, "i").finditer(text) if any(map(low.__contains__, _ADDRESS_WORDS)) else ():
        value = m[1].strip()
        at = text.find(value, m.start())
        if at >= 0 and not any(s <= at and at + len(value) <= e for s, e in streets):
            put(value, at, at + len(value), 0.82)
    return [m for k, m in found.items() if k not in absorbed]


def _pix(text: str) -> list[Match]:
    """Payment payloads: from 000201 to a checksum field that holds, at most 512 printable characters."""
    out, start = [], text.find("000201")
    while start >= 0:
        end, crc = -1, text.find("6304", start + 6)
        while 0 <= crc <= start + 504:
            payload = text[start : crc + 8]
            if not all(" " <= c <= "\x7e" for c in payload):
                break
            if "0014br.gov.bcb.pix" in payload.lower() and ck.pix(payload):
                end = crc + 8
                break
            crc = text.find("6304", crc + 1)
        if end >= 0:
            out.append(("bank-account", text[start:end], start, end, 0.97))
        start = text.find("000201", end if end >= 0 else start + 1)
    return out


_PIX_KEY = Table((Rule("~[0-9a-f]{8}" + "-[0-9a-f]{4}" * 3 + "-[0-9a-f]{12}~", near(0.9), "i"),), "~(?:pix(?:%s+key)?|chave%s+(?:pix|aleat[óÓo]ria))" + _END, 30)


_KEYS_OF_NO_VENDOR = Table(TABLES["api-key"].rules[-1:], TABLES["api-key"].label, TABLES["api-key"].reach)
_KEY_PARTS = rx("AKIA|_live_|_test_|gh[oprs]_|github_pat_|xox[abps]-|sk-|AIza|eyJ")


def _api_key(text: str) -> list[Match]:
    """The vendors' patterns only where a part that one of them must have occurs."""
    return scan_table("api-key", TABLES["api-key"] if _KEY_PARTS.search(text) else _KEYS_OF_NO_VENDOR, text)


def _bank(text: str) -> list[Match]:
    found: dict[tuple[int, int], Match] = {}
    for m in _pix(text) + scan_table("bank-account", _PIX_KEY, text) + scan_table("bank-account", TABLES["bank-account"], text):
        found.setdefault((m[2], m[3]), m)
    return list(found.values())


def _table(category: str) -> Callable[[str], list[Match]]:
    return lambda text: scan_table(category, TABLES[category], text)


CATEGORIES = (
    "email phone ssn credit-card ipv4 ipv6 url iban date-of-birth name address passport drivers-license national-id bank-account cryptocurrency "
    "tax-id medical-record health-insurance prescription api-key social-media vin license-plate tracking-number case-number company-registration"
).split()
_OWN = {"phone": _phone, "date-of-birth": _birth, "name": _name, "address": _address, "bank-account": _bank, "api-key": _api_key}
#: Cheap tests that every text with a match of the category passes.
PREFILTERS: dict[str, Callable[[str], bool]] = {
    "email": lambda t: "@" in t,
    "url": lambda t: "://" in t,
    "ipv6": lambda t: ":" in t,
    "national-id": lambda t: _DIGIT.search(t) is not None or rx(_NATIONAL_LABEL, "i").search(t) is not None,
    "social-media": lambda t: "@" in t or "/" in t or "UC" in t or _DIGIT.search(t) is not None,
    # A digit, or as many capital letters in a row as the shortest value has.
    **{c: (lambda t, p=rx(f"%d|%u{{{n}}}"): p.search(t) is not None) for c, n in {"tax-id": 8, "bank-account": 8, "health-insurance": 8, "medical-record": 6, "drivers-license": 5, "company-registration": 5, "license-plate": 2}.items()},
    "address": lambda t: _DIGIT.search(t) is not None or any(map(t.lower().__contains__, _ADDRESS_WORDS)),
    "cryptocurrency": lambda t: rx("%z{25}").search(t) is not None,
    "vin": lambda t: rx("%z{17}").search(t) is not None,
    **dict.fromkeys("phone ssn credit-card ipv4 iban date-of-birth passport prescription case-number tracking-number".split(), lambda t: _DIGIT.search(t) is not None),
}


def _filtered(category: str) -> Callable[[str], list[Match]]:
    own, passes = _OWN.get(category) or _table(category), PREFILTERS.get(category)
    return (lambda text: own(text) if passes(text) else []) if passes else own


DETECTORS: dict[str, Callable[[str], list[Match]]] = {c: _filtered(c) for c in CATEGORIES}


def strict_national_id(text: str) -> list[Match]:
    return scan_table("national-id", STRICT_NATIONAL, text)


def _apart(category: str, pattern: str, flags: str, confidence: float) -> Callable[[str], list[Match]]:
    """The standard matches, and the pattern's where no standard one overlaps."""

    def detect(text: str) -> list[Match]:
        standard = DETECTORS[category](text)
        more = [(category, m[0], m.start(), m.end(), confidence) for m in rx(pattern, flags).finditer(text)]
        return standard + [x for x in more if not any(x[2] < e and s < x[3] for _, _, s, e, _ in standard)]

    return detect


def _vin_any(text: str) -> list[Match]:
    standard = DETECTORS["vin"](text)
    spans = {(m[2], m[3]) for m in standard}
    return standard + [("vin", m[0], m.start(), m.end(), 0.7) for m in rx(TABLES["vin"].rules[0].pattern, "i").finditer(text) if m.span() not in spans]


AGGRESSIVE = {
    **DETECTORS,
    "email": _apart("email", r"~[0-9a-z][0-9a-z._-]*%s*(?:\(at\)|\[at\]|@)%s*[0-9a-z](?:%w|[.-])*%s*(?:\(dot\)|\[dot\]|\.)%s*[a-z]{2,}~", "i", 0.75),
    "phone": _apart("phone", r"~%d{3}(?:[.-]|%s)%d{4}~", "", 0.7),
    "ssn": _apart("ssn", "~(?!9%d{2}|666|000)%d{3}(?!00)%d{2}(?!0{4})%d{4}~", "", 0.8),
    "credit-card": _apart("credit-card", r"(?:\*{4}[ -]?){3}%d{4}~", "", 0.8),
    "name": lambda text: greedy(_names(text, "|".join(_BROAD), "i", 0.65)),
    "vin": _vin_any,
}


def custom(pattern: str, flags: str = "") -> Callable[[str], list[Match]]:
    """A detector of one pattern of the caller's, category custom; empty matches are skipped."""
    compiled = regex.compile(pattern, regex.IGNORECASE if "i" in flags else 0)
    return lambda text: [("custom", m[0], m.start(), m.end(), 0.85) for m in compiled.finditer(text) if m.end() > m.start()]


def detect(text: str, categories=None, *, detectors=None, aggressive: bool = False, apart: bool = False) -> list[Match]:
    """All matches of the categories, sorted and disjoint; detectors replace those of their categories. apart: each category is
    resolved on its own, so that matches of different ones may overlap."""
    table, own = AGGRESSIVE if aggressive else DETECTORS, detectors or {}
    found = [(own.get(c) or table[c])(text) for c in (CATEGORIES if categories is None else categories)]
    if apart:
        return sorted((m for ms in found for m in greedy(ms)), key=lambda m: m[2])
    return greedy([m for ms in found for m in ms])
