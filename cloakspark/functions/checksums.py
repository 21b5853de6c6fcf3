"""Checksum validators: plain Python for the kernels, and Column expressions that stay inside the JVM.

Both take a text and say whether it is valid; separators that are usual for the kind are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _w(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split()))


DIHEDRAL = [[(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
_STEP = _w("1 5 7 6 2 8 3 0 9 4")
PERMUTED = [list(range(10))]
for _ in range(7):
    PERMUTED.append([PERMUTED[-1][_STEP[d]] for d in range(10)])

VIN_VALUES = {**{str(d): d for d in range(10)}, **dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ", [*range(1, 9), *range(1, 6), 7, 9, *range(2, 10)]))}
_FIRST_TEN = "1 0 5 7 9 13 15 17 19 21"
IT_ODD = dict(zip("0123456789", _w(_FIRST_TEN))) | dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _w(f"{_FIRST_TEN} 2 4 18 20 11 3 6 8 12 14 16 10 22 25 24 23")))
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
BLANK = "[\t-\r \xa0  -     　﻿"

#: name: separators to drop, format, weights, how the sum is judged ("zero": divisible; else see _WEIGHTED_RULES).
WEIGHTED: dict[str, tuple[str, str, tuple[int, ...], str]] = {
    "aba-routing": (r"-]", r"[0-9]{9}", (3, 7, 1) * 3, "mod10"),
    "bsn": (r".-]", r"[0-9]{9}", (*range(9, 1, -1), -1), "mod11"),
    "au-tfn": (r"-]", r"[0-9]{9}", _w("1 4 3 7 5 8 6 9 10"), "mod11"),
    "nhs": (r"-]", r"[0-9]{10}", tuple(range(10, 1, -1)), "nhs"),
    "pt-nif": (r".-]", r"[1-9][0-9]{8}", tuple(range(9, 1, -1)), "nif"),
    "cn-resident-id": ("]", r"[0-9]{17}[0-9X]", tuple(2**i % 11 for i in range(17, 0, -1)), "cn"),
}
UNREPEATED = {"aba-routing", "bsn", "au-tfn", "pt-nif"}


def _strip(value: str, more: str) -> str:
    return re.sub(BLANK + more, "", value)


def _sum(value: str, weights: tuple[int, ...]) -> int:
    return sum((ord(c) - 48) * w for c, w in zip(value, weights))


def _repeated(value: str) -> bool:
    return len(set(value)) == 1


def luhn(value: str) -> bool:
    digits = _strip(value, "-]")
    if not re.fullmatch("[0-9]{2,}", digits):
        return False
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def verhoeff(value: str) -> bool:
    digits, state = _strip(value, "-]"), 0
    if not re.fullmatch("[0-9]+", digits):
        return False
    for i, d in enumerate(map(int, reversed(digits))):
        state = DIHEDRAL[state][PERMUTED[i % 8][d]]
    return state == 0


def weighted(name: str) -> Callable[[str], bool]:
    more, form, weights, rule = WEIGHTED[name]

    def check(value: str) -> bool:
        v = _strip(value, more).upper()
        v = v.rjust(9, "0") if name == "bsn" else v
        if not re.fullmatch(form, v) or (name in UNREPEATED and _repeated(v)):
            return False
        total = _sum(v, weights)
        if rule in ("mod10", "mod11"):
            return total % int(rule[3:]) == 0
        rest = total % 11
        if rule == "nhs":
            return rest != 1 and int(v[9]) == (11 - rest) % 11
        if rule == "nif":
            return int(v[8]) == (0 if rest < 2 else 11 - rest)
        return "10X98765432"[rest] == v[17]

    return check


def cpf(value: str) -> bool:
    v = _strip(value, ".-]")
    if not re.fullmatch("[0-9]{11}", v) or _repeated(v):
        return False
    return all(_sum(v, tuple(range(n + 1, 1, -1))) * 10 % 11 % 10 == int(v[n]) for n in (9, 10))


_CNPJ = (*range(6, 1, -1), *range(9, 1, -1))


def cnpj(value: str) -> bool:
    v = _strip(value, "./-]").upper()
    if not re.fullmatch("[0-9A-Z]{12}[0-9]{2}", v) or _repeated(v):
        return False
    digit = lambda s, w: (11 - r) if (r := _sum(s, w) % 11) >= 2 else 0
    first = digit(v[:12], _CNPJ[1:])
    return v[12:] == f"{first}{digit(v[:12] + str(first), _CNPJ)}"


_VIN_WEIGHTS = (*range(8, 1, -1), 10, 0, *range(9, 1, -1))


def vin(value: str) -> bool:
    v = value.upper()
    if len(v) != 17 or any(c not in VIN_VALUES for c in v):
        return False
    return "0123456789X"[sum(VIN_VALUES[c] * w for c, w in zip(v, _VIN_WEIGHTS)) % 11] == v[8]


DEA_FORM = r"[A-HJ-NPR-UX][A-Z9][0-9]{7}"


def dea(value: str) -> bool:
    v = _strip(value, "-]").upper()
    return bool(re.fullmatch(DEA_FORM, v)) and _sum(v[2:8], (1, 2, 1, 2, 1, 2)) % 10 == int(v[8])


def iban(value: str) -> bool:
    v = _strip(value, "]").upper()
    if not 15 <= len(v) <= 34 or not re.fullmatch("[0-9A-Z]+", v):
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


_NINO = ("[ABCEGHJKLMNOPRSTWXYZ]", "[ABCEGHJKLMNPRSTWXYZ]")
NINO_FORM = rf"(?!BG|GB|KN|NK|NT|TN|ZZ){_NINO[0]}{_NINO[1]}[0-9]{{6}}[A-D]"


def nino(value: str) -> bool:
    return bool(re.fullmatch(NINO_FORM, _strip(value, "]").upper()))


def aadhaar(value: str) -> bool:
    return bool(re.fullmatch("[2-9][0-9]{11}", _strip(value, "-]"))) and verhoeff(value)


def npi(value: str) -> bool:
    v = _strip(value, "-]")
    return bool(re.fullmatch("[12][0-9]{9}", v)) and luhn("80840" + v)


def imei(value: str) -> bool:
    v = _strip(value, "/-]")
    return bool(re.fullmatch("[0-9]{15}", v)) and not _repeated(v) and luhn(v)


def es_dni(value: str) -> bool:
    m = re.fullmatch("([XYZ][0-9]{7}|[0-9]{8})([A-Z])", _strip(value, "-]").upper())
    return bool(m) and DNI_LETTERS[int(m[1].translate(str.maketrans("XYZ", "012"))) % 23] == m[2]


def it_fiscal_code(value: str) -> bool:
    v = _strip(value, "]").upper()
    if not re.fullmatch("[0-9A-Z]{15}[A-Z]", v):
        return False
    even = lambda c: int(c) if c.isdigit() else ord(c) - 65
    return chr(65 + sum(even(c) if i % 2 else IT_ODD[c] for i, c in enumerate(v[:15])) % 26) == v[15]


def fr_nir(value: str) -> bool:
    m = re.fullmatch("([12][0-9]{4})([0-9]{2}|2A|2B)([0-9]{6})([0-9]{2})", _strip(value, "]").upper())
    return bool(m) and 97 - int(m[1] + {"2A": "19", "2B": "18"}.get(m[2], m[2]) + m[3]) % 97 == int(m[4])


def se_personnummer(value: str) -> bool:
    v = _strip(value, "+-]")
    return bool(re.fullmatch("([0-9]{2})?[0-9]{10}", v)) and luhn(v[-10:])


def crc16(data: bytes) -> int:
    """CRC-16/CCITT-FALSE."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 * (crc >> 15)) & 0xFFFF
    return crc


def pix(value: str) -> bool:
    if not re.search(r"6304[0-9A-Fa-f]{4}\Z", value) or any(ord(c) > 255 for c in value):
        return False
    return f"{crc16(value[:-4].encode('latin-1')):04X}" == value[-4:].upper()


CHECKSUMS: dict[str, Callable[[str], bool]] = {
    "luhn": luhn,
    "verhoeff": verhoeff,
    "iban": iban,
    "cpf": cpf,
    "cnpj": cnpj,
    "npi": npi,
    "imei": imei,
    "dea": dea,
    "vin": vin,
    "nino": nino,
    "aadhaar": aadhaar,
    "es-dni": es_dni,
    "it-fiscal-code": it_fiscal_code,
    "fr-nir": fr_nir,
    "se-personnummer": se_personnummer,
    "pix": pix,
    **{name: weighted(name) for name in WEIGHTED},
}


# Column forms


def _chars(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


def _drop(v: Column, more: str) -> Column:
    return F.upper(F.regexp_replace(v, BLANK + more, ""))


def _fold(v: Column, weights) -> Column:
    digits = F.transform(_chars(v), lambda c: (F.ascii(c) - 48).cast("long"))
    products = F.zip_with(digits, F.array(*[F.lit(w).cast("long") for w in weights]), lambda d, w: F.coalesce(d, F.lit(0)) * F.coalesce(w, F.lit(0)))
    return F.aggregate(products, F.lit(0).cast("long"), lambda a, x: a + x)


def _same(v: Column) -> Column:
    return v.rlike(r"^(.)\1*\z")


def _whole(v: Column, form: str) -> Column:
    return v.rlike(rf"^(?:{form})\z")


def _lookup(table: dict[str, int], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def checksum(name: str, value: Column) -> Column:
    """The validator called name as a Column; null for null. pix goes through a Python function: a CRC has no JVM form."""
    if name not in CHECKSUMS:
        raise ValueError(f"unknown checksum {name!r}")
    digit = lambda v, n: F.substring(v, n, 1)
    if name in WEIGHTED:
        more, form, weights, rule = WEIGHTED[name]
        v = _drop(value, more)
        v = F.when(F.length(v) < 9, F.lpad(v, 9, "0")).otherwise(v) if name == "bsn" else v
        total = _fold(v, weights)
        rest = total % 11
        ok = {
            "mod10": total % 10 == 0,
            "mod11": rest == 0,
            "nhs": (rest != 1) & (digit(v, 10).cast("long") == (11 - rest) % 11),
            "nif": digit(v, 9).cast("long") == F.when(rest < 2, 0).otherwise(11 - rest),
            "cn": digit(v, 18) == F.substring(F.lit("10X98765432"), (rest + 1).cast("int"), F.lit(1)),
        }[rule]
        good = _whole(v, form)
        return F.when(value.isNull(), None).when(~good if name not in UNREPEATED else ~good | _same(v), False).otherwise(ok)
    lu = lambda v: F.call_function("luhn_check", v)
    if name == "luhn":
        v, good, ok = _drop(value, "-]"), "[0-9]{2,}", lu
    elif name == "npi":
        v, good, ok = _drop(value, "-]"), "[12][0-9]{9}", lambda v: lu(F.concat(F.lit("80840"), v))
    elif name == "imei":
        v, good, ok = _drop(value, "/-]"), "[0-9]{15}", lambda v: lu(v) & ~_same(v)
    elif name == "se-personnummer":
        v, good, ok = _drop(value, "+-]"), "([0-9]{2})?[0-9]{10}", lambda v: lu(F.right(v, F.lit(10)))
    elif name == "nino":
        v, good, ok = _drop(value, "]"), NINO_FORM, lambda v: F.lit(True)
    elif name == "dea":
        v, good, ok = _drop(value, "-]"), DEA_FORM, lambda v: _fold(F.substring(v, 3, 6), (1, 2, 1, 2, 1, 2)) % 10 == digit(v, 9).cast("long")
    elif name == "cpf":
        rule = lambda v, n: _fold(v, range(n + 1, 1, -1)) * 10 % 11 % 10 == digit(v, n + 1).cast("long")
        v, good, ok = _drop(value, ".-]"), "[0-9]{11}", lambda v: ~_same(v) & rule(v, 9) & rule(v, 10)
    elif name == "cnpj":
        rule = lambda v, w: F.when(_fold(v, w) % 11 < 2, 0).otherwise(11 - _fold(v, w) % 11)
        v, good = _drop(value, "./-]"), "[0-9A-Z]{12}[0-9]{2}"
        ok = lambda v: ~_same(v) & (digit(v, 13).cast("long") == rule(v, _CNPJ[1:])) & (digit(v, 14).cast("long") == rule(v, _CNPJ))
    elif name in ("verhoeff", "aadhaar"):
        table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in DIHEDRAL])
        turns = F.array(*[F.array(*[F.lit(x) for x in row]) for row in PERMUTED])
        placed = lambda v: F.transform(F.reverse(_chars(v)), lambda c, i: F.get(F.get(turns, i % 8), c.cast("int")))
        v, good = _drop(value, "-]"), "[0-9]+" if name == "verhoeff" else "[2-9][0-9]{11}"
        ok = lambda v: F.aggregate(placed(v), F.lit(0), lambda a, x: F.get(F.get(table, a), x)) == 0
    elif name == "vin":
        v, good = F.upper(value), "[A-HJ-NPR-Z0-9]{17}"
        values = lambda v: F.zip_with(_chars(v), F.array(*[F.lit(w) for w in _VIN_WEIGHTS]), lambda c, w: _lookup(VIN_VALUES, c) * w)
        ok = lambda v: digit(v, 9) == F.substring(F.lit("0123456789X"), (F.aggregate(values(v), F.lit(0), lambda a, x: a + x) % 11 + 1).cast("int"), F.lit(1))
    elif name == "iban":
        v, good = _drop(value, "]"), "[0-9A-Z]{15,34}"
        turned = lambda v: F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
        step = lambda a, c: F.when(F.ascii(c) < 65, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
        ok = lambda v: F.aggregate(_chars(turned(v)), F.lit(0), step) == 1
    elif name == "es-dni":
        v, good = _drop(value, "-]"), "([XYZ][0-9]{7}|[0-9]{8})[A-Z]"
        ok = lambda v: F.right(v, F.lit(1)) == F.substring(F.lit(DNI_LETTERS), (F.translate(F.left(v, F.lit(8)), "XYZ", "012").cast("int") % 23 + 1), F.lit(1))
    elif name == "it-fiscal-code":
        v, good = _drop(value, "]"), "[0-9A-Z]{15}[A-Z]"
        even = lambda c: F.when(F.ascii(c) < 65, F.ascii(c) - 48).otherwise(F.ascii(c) - 65)
        each = lambda v: F.transform(_chars(F.left(v, F.lit(15))), lambda c, i: F.when(i % 2 == 1, even(c)).otherwise(_lookup(IT_ODD, c)))
        ok = lambda v: F.ascii(digit(v, 16)) == 65 + F.aggregate(each(v), F.lit(0), lambda a, x: a + x) % 26
    elif name == "fr-nir":
        v, good = _drop(value, "]"), "[12][0-9]{4}([0-9]{2}|2A|2B)[0-9]{8}"
        dep = lambda v: F.when(F.substring(v, 6, 2) == "2A", "19").when(F.substring(v, 6, 2) == "2B", "18").otherwise(F.substring(v, 6, 2))
        ok = lambda v: 97 - F.concat(F.left(v, F.lit(5)), dep(v), F.substring(v, 8, 6)).cast("long") % 97 == F.right(v, F.lit(2)).cast("long")
    else:
        return F.udf(lambda x: None if x is None else CHECKSUMS[name](x), "boolean", useArrow=True)(value)
    return F.when(value.isNull(), None).when(~_whole(v, good), False).otherwise(ok(v))
