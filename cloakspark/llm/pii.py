"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod-97) and counts confirm them, words nearby adjust the score. The
expressions are the plain ones with possessive repetitions and a look at the character before, so that no text
takes more than linear time: a run that could begin a match is tried at its beginning only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

LOCAL = "A-Za-z0-9._%+-"
LABEL = "[A-Za-z0-9-]++"
#: Characters before a span in which context words count.
CONTEXT = 40
NEAR, FAR = 0.1, 0.0
#: Matches that are folded at once.
BLOCK = 128


@dataclass(frozen=True)
class Kind:
    """What finds spans of one kind: expression, a cheap test that every text with a match passes, score, context words."""

    name: str
    pattern: str
    needs: str
    score: float
    words: str


KINDS = (
    # After a match, a local part may begin in the middle of a run: \G.
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@{LABEL}(?:\.{LABEL})++", "@", 0.85, r"e-?mail|contact|write to|courriel|kontakt|correo"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "0-9", 0.75, r"(?:^|[^a-z])ip(?:[^a-z]|$)|address|host|server|client|adresse"),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", "0-9", 0.8, r"card|visa|master|amex|credit|debit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, r"phone|tel|call|mobile|fax|fon|llame"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+", "0-9", 0.9, r"iban|bank|account|konto|compte|cuenta"),
)
BASE = tuple(k.name for k in KINDS[:4])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """Whether an IBAN's check digits hold: letters as two digits, the first four characters at the end."""
    turned = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))
    code = lambda c: F.ascii(c)
    step = lambda a, c: F.when(code(c) < 65, (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


_EMPTY = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def _spans(text: Column, order: int, kind: Kind) -> Column:
    """The confirmed spans of one kind: what lies between the matches, and the matches, give the offsets."""
    gaps, values = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(g.alias("g"), v.alias("v")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("found"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        end = start + F.length(p["v"])
        near = F.lower(F.substring(p["g"], F.greatest(F.length(p["g"]) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT))).rlike(kind.words)
        score = F.round(F.lit(kind.score) + F.when(near, NEAR).otherwise(FAR), 2)
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(confirmed(kind.name, p["v"]), F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    # Appending to one array would take quadratic time: blocks of matches are folded apart, then moved to their places.
    def folded(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(p, b * BLOCK + 1, F.lit(BLOCK)), zero, step))
        return _let(blocks, moved)

    def moved(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        at = F.aggregate(blocks, begin, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
        shift = lambda x, o: F.transform(x["found"], lambda s: F.struct((s["start"] + o).alias("start"), s["ord"].alias("ord"), (s["end"] + o).alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
        return F.flatten(F.zip_with(blocks, at, shift))

    has = text.rlike("[0-9]") if kind.needs == "0-9" else F.contains(text, F.lit(kind.needs))
    return F.when(has, _let(pairs, lambda p: F.when(F.size(p) > 0, folded(p)).otherwise(F.array().cast(_EMPTY)))).otherwise(F.array().cast(_EMPTY))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: for each whole text, an array of (start, ord, end, kind, score) by start and then by kind.

    Offsets are code points, end exclusive; matches of a kind don't overlap, the leftmost comes first, a match that
    its check refutes is dropped. Null and empty texts have no spans; a null id stays null; repeated rows give repeated
    results; an empty table gives an empty one; other columns are left behind.
    """
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    found = [_spans(F.col("text"), i, k) for i, k in enumerate(KINDS)]
    return d.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the count of each kind, base_sha256, spans, best_score."""
    say = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda name: F.size(F.filter("found", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k.name) for k in KINDS], F.sha2(say(base), 256).alias("base_sha256"), say(F.col("found")).alias("spans"), F.array_max(F.transform("found", lambda x: x["score"])).alias("best_score"))
