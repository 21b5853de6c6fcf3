"""Categories, presets and regulations as data, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import PresetError, ValidationError
from ..functions.legacy import CATEGORIES

PREFIXES = {c: c.upper().replace("-", "_") for c in CATEGORIES} | {"date-of-birth": "DATE", "name": "PERSON", "cryptocurrency": "CRYPTO", "company-registration": "COMPANY_REG"}

REDACT, LAST_FOUR = {"strategy": "redact"}, {"strategy": "mask", "keep_trailing": 4}

#: name: categories, default strategy, rules.
PRESETS: dict[str, tuple[list[str], dict, dict[str, dict]]] = {
    name: (categories.split(), strategy, rules)
    for name, categories, strategy, rules in (
        ("gdpr", "name email phone address date-of-birth ssn national-id passport drivers-license iban bank-account credit-card ipv4 ipv6 url medical-record health-insurance prescription social-media cryptocurrency tax-id", {"strategy": "pseudonymize"}, {}),
        ("lgpd", "name email phone address date-of-birth national-id tax-id passport drivers-license bank-account iban credit-card cryptocurrency ipv4 ipv6 url social-media license-plate medical-record health-insurance prescription", REDACT, {}),
        ("pipeda", "name email phone address date-of-birth national-id ssn passport drivers-license tax-id bank-account iban credit-card ipv4 ipv6 social-media medical-record health-insurance prescription", REDACT, {}),
        ("hipaa", "name address date-of-birth phone email ssn medical-record health-insurance prescription bank-account credit-card iban drivers-license passport vin license-plate url ipv4 ipv6 national-id tax-id social-media company-registration", REDACT, {}),
        ("ccpa", "name email phone address ssn national-id passport drivers-license bank-account credit-card tax-id ipv4 ipv6 url social-media date-of-birth medical-record health-insurance api-key", REDACT, {}),
        ("pci-dss", "credit-card bank-account name address email phone", REDACT, {"credit-card": LAST_FOUR, "bank-account": LAST_FOUR}),
        ("sox", "name email tax-id bank-account company-registration ssn address phone", REDACT, {}),
        ("ferpa", "name email phone address date-of-birth ssn national-id", REDACT, {}),
    )
}

KEYED, NONE = {"keyed": True}, {}
REMOVED = {"not_derived": True, "max_revealed": (0, 0)}
_HEALTH = "medical-record health-insurance prescription"
#: regulation: groups of categories, requirement, recommended strategy, citation.
REGULATIONS: dict[str, list[tuple[str, dict, dict, str]]] = {
    "gdpr": [
        (c, KEYED, {"strategy": "pseudonymize"}, cite)
        for c, cite in (
            ("name email phone address date-of-birth", "GDPR Art. 4(1)"),
            ("national-id ssn passport drivers-license tax-id", "GDPR Art. 87"),
            ("iban bank-account credit-card cryptocurrency", "GDPR Art. 4(1)"),
            ("ipv4 ipv6 url social-media", "GDPR Recital 30"),
            (_HEALTH, "GDPR Art. 9(1)"),
        )
    ],
    "lgpd": [(" ".join(PRESETS["lgpd"][0][:-3]), KEYED, REDACT, "LGPD Art. 5(I)"), (_HEALTH, KEYED, REDACT, "LGPD Art. 5(II)")],
    "pipeda": [(" ".join(PRESETS["pipeda"][0][:-3]), NONE, REDACT, "PIPEDA s. 2(1)"), (_HEALTH, KEYED, REDACT, "PIPEDA Sch. 1, 4.7")],
    "hipaa": [
        (c, REMOVED, REDACT, f"45 CFR 164.514(b)(2)(i)({letter})")
        for c, letter in (
            ("name", "A"), ("address", "B"), ("date-of-birth", "C"), ("phone", "D"), ("email", "F"), ("ssn", "G"), ("medical-record", "H"), ("health-insurance", "I"),
            ("bank-account credit-card iban", "J"), ("drivers-license passport prescription", "K"), ("vin license-plate", "L"), ("url", "N"), ("ipv4 ipv6", "O"), ("national-id tax-id social-media", "R"),
        )
    ],
    "ccpa": [
        ("name email phone address ipv4 ipv6 url social-media date-of-birth tax-id", NONE, REDACT, "Cal. Civ. Code 1798.140(v)"),
        ("ssn national-id passport drivers-license bank-account credit-card medical-record health-insurance api-key", KEYED, REDACT, "Cal. Civ. Code 1798.140(ae)"),
    ],
    "pci-dss": [
        ("credit-card", {"keyed": True, "max_revealed": (6, 4)}, LAST_FOUR, "PCI DSS 3.4.1"),
        ("name", NONE, REDACT, "PCI DSS 3.2.1"),
        ("bank-account", NONE, LAST_FOUR, "PCI DSS 3.2.1"),
        ("address email phone", NONE, REDACT, "PCI DSS 3.2.1"),
    ],
}


def preset(name: str) -> tuple[list[str], dict, dict[str, dict]]:
    if name not in PRESETS:
        raise PresetError(f"unknown preset {name!r}")
    return PRESETS[name]


def traits(spec: dict, tokenization: dict | None = None) -> dict:
    """What a strategy's output lets others do with it: reversible, derived, keyed, linkable, revealed (lead, trail) or all."""
    name = spec["strategy"]
    out = {"reversible": False, "derived": False, "keyed": False, "linkable": False, "revealed": (0, 0)}
    if name == "mask":
        out["revealed"] = (spec.get("keep_leading", 0), spec.get("keep_trailing", 0))
    elif name == "generalize":
        out |= {"derived": True, "linkable": True, "revealed": "all"}
    elif name == "synthesize" or (name == "pseudonymize" and spec.get("seed") is not None):
        out |= {"derived": True, "linkable": True}
    elif name == "hash":
        out |= {"derived": True, "linkable": True, "keyed": spec.get("pepper") is not None}
    elif name == "encrypt":
        out |= {"derived": True, "reversible": True, "keyed": True}
    elif name == "tokenize":
        derived = (tokenization or {}).get("scheme") != "session"
        out |= {"reversible": (tokenization or {}).get("reversible", True), "derived": derived, "keyed": derived, "linkable": True}
    return out


def unmet(t: dict, requirement: dict) -> list[str]:
    """Why traits don't meet a requirement."""
    out = []
    if requirement.get("irreversible") and t["reversible"]:
        out.append("whoever holds the key or vault can restore the value")
    if requirement.get("not_derived") and t["derived"]:
        out.append("the output is computed from the value")
    if requirement.get("keyed") and t["derived"] and not t["keyed"]:
        out.append("the output is computed from the value without a secret key")
    if most := requirement.get("max_revealed"):
        if t["revealed"] == "all":
            out.append("the value can pass through unchanged")
        elif t["revealed"][0] > most[0] or t["revealed"][1] > most[1]:
            out.append(f"more than {most[0]} leading and {most[1]} trailing characters stay visible")
    return out


def exposure(spec: dict) -> int:
    t = traits(spec)
    return 8 * t["reversible"] + 4 * t["linkable"] + (3 if t["revealed"] == "all" else int(sum(t["revealed"]) > 0))


def combine(names) -> tuple[list[str], dict, dict[str, dict]]:
    """One preset, or several: all their categories, each with the strategy that exposes least (of equals the first)."""
    names = list(dict.fromkeys([names] if isinstance(names, str) else names))
    if not names:
        raise ValidationError("preset", "must name at least one preset")
    own = [preset(n) for n in names]
    if len(own) == 1:
        return own[0]
    categories = list(dict.fromkeys(c for p in own for c in p[0]))
    default = min((p[1] for p in own), key=exposure)
    best = {c: min((p[2].get(c, p[1]) for p in own if c in p[0]), key=exposure) for c in categories}
    return categories, default, {c: s for c, s in best.items() if s != default}


def describe(requirement: dict) -> str:
    parts = ["irreversible"] * bool(requirement.get("irreversible")) + ["not derived from the value"] * bool(requirement.get("not_derived")) + ["keyed if derived from the value"] * bool(requirement.get("keyed"))
    if most := requirement.get("max_revealed"):
        parts.append("nothing visible" if most == (0, 0) else f"at most {most[0]} leading and {most[1]} trailing characters visible")
    return "; ".join(parts) or "none"


def spelled(spec: dict) -> str:
    options = ", ".join(f"{k}: {v}" for k, v in spec.items() if k != "strategy")
    return f"{spec['strategy']} ({options})" if options else spec["strategy"]


#: What detection doesn't reach, by regulation, and what to do about it.
GAPS = {
    "gdpr": [("location data", "custom patterns, or drop the fields"), ("special categories in free text", "review, or leave the text out")],
    "lgpd": [("RG, CNH and CEP numbers", "custom patterns"), ("sensitive data in free text", "review")],
    "pipeda": [("provincial health cards, postal codes", "custom patterns")],
    "hipaa": [("city, county and ZIP code", "rules by field"), ("dates other than of birth, ages over 89", "generalize by field"), ("device ids, biometrics, photographs", "drop the fields")],
    "ccpa": [("browsing and purchase history, geolocation", "drop the fields"), ("inferences", "review")],
    "pci-dss": [("card verification codes, PINs, track data", "never store them: drop the fields")],
}


def categories_frame(spark: SparkSession) -> DataFrame:
    """category, prefix."""
    return spark.createDataFrame(list(PREFIXES.items()), "category string, prefix string")


def gaps_frame(spark: SparkSession) -> DataFrame:
    """regulation, element, mitigation."""
    return spark.createDataFrame([(r, e, m) for r, gaps in GAPS.items() for e, m in gaps], "regulation string, element string, mitigation string")


def preset_matrix(spark: SparkSession) -> DataFrame:
    """preset, category, strategy."""
    rows = [(name, c, spelled(rules.get(c, default))) for name, (cs, default, rules) in PRESETS.items() for c in cs]
    return spark.createDataFrame(rows, "preset string, category string, strategy string")


def compliance_matrix(spark: SparkSession) -> DataFrame:
    """regulation, category, citation, requirement, recommended: a row for each regulation and category."""
    rows = [(r, c, cite, describe(req), spelled(rec)) for r, groups in REGULATIONS.items() for cs, req, rec, cite in groups for c in cs.split()]
    return spark.createDataFrame(rows, "regulation string, category string, citation string, requirement string, recommended string")
