"""One notation for patterns, so that Python reads them as the common script dialect does.

~ is a word boundary of ASCII words; %d, %w, %s are a digit, a word character, a white space character; %u, %m, %z are an
upper-case letter, one or a digit, any letter or digit of ASCII.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

SPACE = "\t-\r \xa0  -     　﻿"
_WORD = "[0-9A-Za-z_]"
_MACROS = {
    "%d": "[0-9]",
    "%w": _WORD,
    "%s": f"[{SPACE}]",
    "%S": f"[^{SPACE}]",
    "%u": "[A-Z]",
    "%m": "[0-9A-Z]",
    "%z": "[0-9A-Za-z]",
    "~": r"\b",
}


def expand(pattern: str) -> str:
    return re.sub(r"%[dwsSumz]|~", lambda m: _MACROS[m[0]], pattern)


@lru_cache(maxsize=None)
def rx(pattern: str, flags: str = "") -> re.Pattern | regex.Pattern:
    """Compiled; i: any case of ASCII letters, p: properties of Unicode characters are needed (then without ~)."""
    text = expand(pattern)
    if "p" in flags:
        return regex.compile(text, (regex.IGNORECASE if "i" in flags else 0) | regex.V0)
    return re.compile(text, re.ASCII | (re.IGNORECASE if "i" in flags else 0))
