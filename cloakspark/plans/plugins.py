"""Plugins: detectors, strategies and validators of the caller's, under names that don't clash."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import ValidationError
from ..functions import legacy, strategies
from .spec import Legacy


@dataclass(frozen=True)
class Plugin:
    name: str
    detectors: dict[str, Callable] = field(default_factory=dict)
    strategies: dict[str, Callable] = field(default_factory=dict)  # (value, category, options) -> replacement
    validators: dict[str, Callable] = field(default_factory=dict)  # category -> whether a value counts


class Registry:
    """Plugins by name. A category or strategy may come from one plugin only, and strategies mustn't hide built-in ones."""

    def __init__(self):
        self.plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> "Registry":
        if not isinstance(plugin.name, str) or not plugin.name.strip():
            raise ValidationError("plugin.name", "must not be blank")
        if plugin.name in self.plugins:
            raise ValidationError("plugin.name", f"{plugin.name!r} is registered already")
        for kind in ("detectors", "strategies"):
            for other in self.plugins.values():
                if both := set(getattr(plugin, kind)) & set(getattr(other, kind)):
                    raise ValidationError(f"plugin.{kind}", f"{sorted(both)[0]!r} is {other.name}'s")
        if hidden := set(plugin.strategies) & set(strategies.STRATEGIES):
            raise ValidationError("plugin.strategies", f"{sorted(hidden)[0]!r} is built in")
        for kind in ("detectors", "strategies", "validators"):
            if not all(callable(f) for f in getattr(plugin, kind).values()):
                raise ValidationError(f"plugin.{kind}", "must be functions")
        self.plugins[plugin.name] = plugin
        return self

    def unregister(self, name: str) -> bool:
        return self.plugins.pop(name, None) is not None

    def names(self) -> list[str]:
        return list(self.plugins)

    def anonymizer(self, options: dict | None = None) -> Legacy:
        """The first generation with what the plugins add; a plugin's detector replaces the built-in one of its category."""
        o = dict(options or {})
        detectors = {c: f for p in self.plugins.values() for c, f in p.detectors.items()}
        checks: dict[str, list[Callable]] = {}
        for p in self.plugins.values():
            for c, f in p.validators.items():
                checks.setdefault(c, []).append(f)
        own = {n: f for p in self.plugins.values() for n, f in p.strategies.items()}
        rules = dict(o.pop("rules", {}) or {})
        special = {c: s for c, s in rules.items() if isinstance(s, dict) and s.get("strategy") in own}
        plain = {c: ({"strategy": "redact"} if c in special else s) for c, s in rules.items()}
        if not plain and "categories" not in o and "preset" not in o:
            o["categories"] = [*legacy.CATEGORIES, *[c for c in detectors if c not in legacy.CATEGORIES]]
        out = Legacy(o | ({"rules": plain} if plain else {}), detectors, checks)
        for c, s in special.items():
            out.rules[c] = lambda v, k, s=s: own[s["strategy"]](v, k, {x: y for x, y in s.items() if x != "strategy"})
        return out

    def anonymize(self, options: dict | None = None):
        """A Column function text -> struct of text, matches and error."""
        from pyspark.sql import functions as F

        from .. import schemas as S

        self.anonymizer(options)

        def run(t):
            if t is None:
                return None
            try:
                return (*self.anonymizer(options).anonymize(t), None)
            except Exception as e:  # noqa: BLE001 - withheld
                return None, None, type(e).__name__

        return F.udf(run, S.ANONYMIZED, useArrow=True)
