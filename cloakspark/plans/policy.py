"""Policy documents: checked with paths and codes, compiled to pipelines; plans for erasure."""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, SparkSession

from ..errors import PolicyError
from ..functions.checksums import CHECKSUMS
from ..functions.legacy import CATEGORIES
from ..functions.strategies import STRATEGIES
from . import presets

MEMBERS = set("aggressive allow categories default_strategy description extends id min_confidence overlap patterns rules version".split())
OPTIONS = {
    "redact": {"label"},
    "mask": {"mask_char", "keep_leading", "keep_trailing", "preserve_format"},
    "pseudonymize": {"prefix", "seed"},
    "hash": {"pepper", "truncate"},
    "generalize": {"bucket_size"},
    "synthesize": {"seed"},
    "encrypt": set(),
    "tokenize": set(),
}
NUMERIC = {"ssn", "credit-card"}
_KINDS = {"id": str, "description": str, "extends": list, "categories": dict, "default_strategy": dict, "rules": dict, "patterns": list, "min_confidence": (int, float), "allow": list, "aggressive": bool, "overlap": str}


def check(document, tokenization: dict | None = None) -> list[dict]:
    """Issues (severity, path, code, message), errors first; none means that the document is a policy."""
    out: list[dict] = []

    def say(path: str, code: str, message: str, severity: str = "error") -> None:
        issue = {"severity": severity, "path": path, "code": code, "message": message}
        if issue not in out:
            out.append(issue)

    if not isinstance(document, dict):
        say("", "not-an-object", "a policy is an object")
        return out
    d = document
    for k in sorted(set(d) - MEMBERS):
        say(f"/{k}", "unknown-member", f"{k} is not a member of a policy")
    if d.get("version") != 1:
        say("/version", "unsupported-version", "only version 1 is known")
    for k, kind in _KINDS.items():
        if k in d and (not isinstance(d[k], kind) or (kind is not bool and isinstance(d[k], bool))):
            say(f"/{k}", "invalid-type", f"{k} has the wrong type")
    if isinstance(d.get("id"), str) and not regex.fullmatch(r"(?![._-])[\w.-]{1,64}", d["id"], regex.ASCII):
        say("/id", "invalid-id", "an id has 1 to 64 letters, digits, dots, dashes and underscores")
    typed = {k: d[k] for k in _KINDS if k in d and not any(i["path"] == f"/{k}" for i in out)}
    regulations = []
    for i, r in enumerate(typed.get("extends", [])):
        if r not in presets.REGULATIONS:
            say(f"/extends/{i}", "unknown-regulation", f"{r!r} is not a regulation")
        else:
            regulations.append(r)
    own = {p["category"] for p in typed.get("patterns", []) if isinstance(p, dict) and isinstance(p.get("category"), str)}
    named = typed.get("categories", {})
    for part in ("include", "exclude"):
        for i, c in enumerate(named.get(part, [])):
            if c not in CATEGORIES and c not in own:
                say(f"/categories/{part}/{i}", "unknown-category", f"{c!r} is not a category")
    required = {c: (req, r) for r in regulations for cs, req, _, _ in presets.REGULATIONS[r] for c in cs.split()}
    active = (set(required) | set(named.get("include", [])) | own) - set(named.get("exclude", []))
    for i, c in enumerate(named.get("exclude", [])):
        if c in required:
            say(f"/categories/exclude/{i}", "required-category-excluded", f"{required[c][1]} covers {c}")

    def strategy(spec, path: str) -> bool:
        if not isinstance(spec, dict) or spec.get("strategy") not in STRATEGIES:
            say(f"{path}/strategy", "unknown-strategy", "is not a strategy")
            return False
        for k in sorted(set(spec) - {"strategy"} - OPTIONS[spec["strategy"]]):
            say(f"{path}/{k}", "unknown-option", f"{spec['strategy']} has no option {k}")
        bad = {
            "label": lambda v: not isinstance(v, str) or not v.strip(),
            "mask_char": lambda v: not isinstance(v, str) or len(v) != 1,
            "truncate": lambda v: not isinstance(v, int) or not 1 <= v <= 64,
            "bucket_size": lambda v: not isinstance(v, int) or v < 2,
            **dict.fromkeys(("keep_leading", "keep_trailing"), lambda v: not isinstance(v, int) or v < 0),
        }
        for k, v in spec.items():
            if k in OPTIONS[spec["strategy"]] and k in bad and bad[k](v):
                say(f"{path}/{k}", "invalid-option", f"{v!r} is not allowed")
        if spec["strategy"] == "hash" and spec.get("pepper") is None:
            say(path, "unkeyed-hash", "anyone can recompute a hash without a pepper", "warning")
        return True

    default = typed.get("default_strategy", {"strategy": "redact"})
    good = strategy(default, "/default_strategy")
    rules = typed.get("rules", {})
    for c, spec in rules.items():
        if c not in CATEGORIES and c not in own:
            say(f"/rules/{c}", "unknown-category", f"{c!r} is not a category")
        elif c not in active and active:
            say(f"/rules/{c}", "unused-rule", f"{c} is not among the policy's categories", "warning")
        if strategy(spec, f"/rules/{c}") and spec["strategy"] == "generalize" and c not in NUMERIC:
            say(f"/rules/{c}", "generalize-non-numeric", f"values of {c} are rarely numbers", "warning")
    for i, p in enumerate(typed.get("patterns", [])):
        try:
            regex.compile(p["source"])
        except (regex.error, TypeError, KeyError):
            say(f"/patterns/{i}/source", "invalid-pattern", "is not a valid regular expression")
        if isinstance(p, dict) and p.get("validator") is not None and p["validator"] not in CHECKSUMS:
            say(f"/patterns/{i}/validator", "invalid-pattern", "is not a checksum")
    for c in sorted(active & set(required)):
        spec = rules.get(c, default if good else None)
        if isinstance(spec, dict) and spec.get("strategy") in STRATEGIES:
            for reason in presets.unmet(presets.traits(spec, tokenization), required[c][0]):
                say(f"/rules/{c}" if c in rules else "/default_strategy", "requirement-violated", f"{required[c][1]}, {c}: {reason}")
    return sorted(out, key=lambda i: i["severity"] != "error")


def parse(document, tokenization: dict | None = None) -> dict:
    """The document, if it has no error; raised with all issues otherwise."""
    issues = check(document, tokenization)
    if any(i["severity"] == "error" for i in issues):
        raise PolicyError("; ".join(f"{i['path']}: {i['code']}" for i in issues if i["severity"] == "error"), issues=issues)
    return document


def to_spec(policy: dict) -> dict:
    """The pipeline of a policy: categories of what it extends and includes, without what it excludes."""
    named = policy.get("categories", {})
    wanted = [c for r in policy.get("extends", []) for cs, *_ in presets.REGULATIONS[r] for c in cs.split()] + named.get("include", [])
    categories = [c for c in dict.fromkeys(wanted or CATEGORIES) if c not in named.get("exclude", []) and c in CATEGORIES]
    spec = {"categories": categories, "rules": policy.get("rules", {}), "patterns": policy.get("patterns", [])}
    return spec | {k: policy[k] for k in ("default_strategy", "min_confidence", "allow", "aggressive", "overlap") if k in policy}


def regulation_policy(name: str) -> dict:
    """A policy that follows a regulation's recommendations."""
    if name not in presets.REGULATIONS:
        raise PolicyError(f"unknown regulation {name!r}")
    groups = presets.REGULATIONS[name]
    default = groups[0][2] if name != "pci-dss" else presets.REDACT
    rules = {c: rec for cs, _, rec, _ in groups for c in cs.split() if rec != default}
    return {"version": 1, "id": name, "extends": [name], "default_strategy": default, "rules": rules}


def issues_frame(spark: SparkSession, documents: list) -> DataFrame:
    """document (its number), severity, path, code."""
    rows = [(i, x["severity"], x["path"], x["code"]) for i, d in enumerate(documents) for x in check(d)]
    return spark.createDataFrame(rows, "document int, severity string, path string, code string")


def plan_erasure(places: list[dict]) -> list[dict]:
    """Steps to erase a subject: what to do in each place (kind: vault, sealed, session, hashed, redacted, text)."""
    steps = {
        "vault": ("forget_subject", True),
        "sealed": ("shred_key", True),
        "session": ("forget", True),
        "hashed": ("rotate_pepper", True),
        "pseudonymized": ("drop_seed", True),
        "redacted": ("none", True),
        "text": ("rescan", False),
    }
    out = []
    for i, p in enumerate(places):
        if p.get("kind") not in steps:
            raise PolicyError(f"places[{i}]: unknown kind {p.get('kind')!r}")
        action, complete = steps[p["kind"]]
        out.append({"place": p.get("name", str(i)), "kind": p["kind"], "action": action, "complete": complete})
    return out
