"""Tokens of whole tables: numbering by scope, restoring by joins, and the vault as a table.

A vault is a DataFrame of the type schemas.VAULT; operations return the new table, to be written by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..errors import VaultError
from ..functions import tokens as tk
from ..functions.legacy import CATEGORIES
from ..plans.presets import PREFIXES
from .text import detect


def tokenize(text: Column, categories=None, shape: str = "bracket") -> Column:
    """Struct of text, mapping, tokens and error, numbered within each text from right to left."""
    tk.token("X", 1, shape)

    def run(t):
        if t is None:
            return None
        try:
            return (*tk.tokenize(t, categories, shape), None)
        except Exception as e:  # noqa: BLE001 - withheld
            return None, None, None, type(e).__name__

    return F.udf(run, S.TOKENIZED, useArrow=True).asNondeterministic()(text)


def restore(text: Column, mapping: Column, lenient: bool = False) -> Column:
    """Struct of text, restored and unresolved, by a map column."""
    return F.udf(lambda t, m: None if t is None else tk.restore(t, m or {}, lenient), S.RESTORED, useArrow=True)(text, mapping)


def _prefix(category: Column) -> Column:
    """The token prefix of a category; of others than the built-in ones, its capital letters and digits."""
    table = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    clean = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.upper(category), "[^0-9A-Z]+", "_"), "^_+", ""), 1, 38), "_+$", "")
    return F.coalesce(F.element_at(table, category), F.when(clean.rlike("^[A-Z]"), clean).when(clean == "", F.lit("X")).otherwise(F.concat(F.lit("X_"), clean)))


def _joined(a: DataFrame, b: DataFrame, names: list[str], how: str) -> DataFrame:
    """a join b by the named columns, which may be null; they come from a."""
    other = b.select(*[F.col(f"`{n}`").alias(f"__on{i}") if n in names else F.col(f"`{n}`") for i, n in enumerate(b.columns)])
    on = F.lit(True)
    for n in names:
        on = on & a[f"`{n}`"].eqNullSafe(other[f"__on{b.columns.index(n)}"])
    out = a.join(other, on, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[c for c in other.columns if c.startswith("__on")])


def _row_id(*columns: str) -> Column:
    """The same for equal values of the columns, on every machine and in every attempt; else different."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).cast("binary")))


def number_tokens(found: DataFrame, *scope: str, order: list[str], existing: DataFrame | None = None, shape: str = "bracket") -> DataFrame:
    """scope, category, value, token: each distinct value of a scope numbered by first appearance within its prefix.

    found has category, value and the columns of order; existing holds earlier results, whose tokens and numbers
    stay as they are. One row for each distinct value is ranked, not one for each appearance.
    """
    p = _prefix(F.col("category"))
    first = found.groupBy(*scope, "category", "value").agg(F.min(F.struct(*order)).alias("__at"))
    a, b, pad = tk.SHAPES[shape]
    offset = F.lit(0)
    if existing is not None:
        first = _joined(first, existing.select(*scope, "category", "value"), [*scope, "category", "value"], "left_anti")
        used = existing.withColumn("__p", p).groupBy(*scope, "__p").agg(F.max(F.regexp_extract("token", r"_([0-9]+)\D*$", 1).cast("long")).alias("__used"))
        first = _joined(first.withColumn("__p", p), used, [*scope, "__p"], "left")
        offset = F.coalesce("__used", F.lit(0))
    else:
        first = first.withColumn("__p", p)
    w = Window.partitionBy(*scope, "__p").orderBy("__at", "category", "value")
    n = (F.row_number().over(w) + offset).cast("string")
    n = F.when(F.length(n) < pad, F.lpad(n, pad, "0")).otherwise(n) if pad else n
    new = first.withColumn("token", F.concat(F.lit(a), F.col("__p"), F.lit("_"), n, F.lit(b))).select(*scope, "category", "value", "token")
    return new if existing is None else existing.select(*scope, "category", "value", "token").unionByName(new)


def tokenize_scopes(df: DataFrame, text_col: str, *scope: str, order: list[str], categories=None, shape: str = "bracket") -> tuple[DataFrame, DataFrame]:
    """(df with tokens in its texts, mapping): all texts of a scope, such as a conversation, share their tokens.

    order says which rows of a scope come first. Scopes and orders may be null, which is a scope or a place like others,
    and rows may share both. The mapping is joined back by value: no scope is gathered in one task, only the values of one
    text are. A text whose matches don't all find their tokens in their places is withheld (null).
    """
    own = df.withColumn("__r", _row_id(*dict.fromkeys([*scope, *order, text_col])))
    found = own.select("__r", *dict.fromkeys([*scope, *order]), detect(F.col(f"`{text_col}`"), categories).alias("__m"))
    hits = found.select("__r", *dict.fromkeys([*scope, *order]), F.explode("__m").alias("__s")).select("__r", *dict.fromkeys([*scope, *order]), "__s.*")
    mapping = number_tokens(hits, *scope, order=[*order, "start"], shape=shape)
    placed = _joined(hits.select("__r", *scope, "category", "value", "start", "end"), mapping, [*scope, "category", "value"], "left")
    placed = placed.groupBy("__r").agg(F.array_sort(F.collect_set(F.struct("start", "end", "token", "value"))).alias("__t"))
    joined = own.join(placed, "__r", "left")
    text = F.col(f"`{text_col}`")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"))
    there = lambda x: (x["start"] >= 0) & (F.substring(text, x["start"] + 1, x["end"] - x["start"]) == x["value"])
    # concat gives null if a token is missing
    step = lambda acc, x: F.struct(x["end"].alias("at"), F.when(there(x) & (x["start"] >= acc["at"]), F.concat(acc["s"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), x["token"])).alias("s"))
    done = F.aggregate("__t", zero, step, lambda acc: F.concat(acc["s"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = F.when(F.col("__t").isNull(), text).otherwise(done)
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]), mapping


def restore_scopes(df: DataFrame, text_col: str, mapping: DataFrame, *scope: str, order: list[str]) -> DataFrame:
    """df with text_col restored by a left join with the mapping, and restored and unresolved; unknown tokens stay.

    Scopes may be null and rows may repeat, as in tokenize_scopes. A token that the mapping has with several values is unknown.
    """
    pattern = tk.ANY_TOKEN.pattern
    own = df.withColumn("__r", _row_id(*dict.fromkeys([*scope, text_col])))
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(pattern), F.lit(0))
    parts = own.select("__r", *scope, F.posexplode(found).alias("__i", "token"))
    known = mapping.groupBy(*scope, "token").agg(F.when(F.min("value") == F.max("value"), F.min("value")).alias("value"))
    hit = _joined(parts, known, [*scope, "token"], "left").groupBy("__r")
    values = hit.agg(F.array_sort(F.collect_set(F.struct("__i", F.coalesce("value", "token").alias("v"), F.col("value").isNotNull().alias("k"), "token"))).alias("__v"))
    joined = own.join(values, "__r", "left")
    gaps = F.split(F.col(f"`{text_col}`"), pattern, -1)
    whole = F.array_join(F.flatten(F.zip_with(gaps, F.col("__v"), lambda g, v: F.array(g, F.coalesce(v["v"], F.lit(""))))), "")
    text = F.when(F.col("__v").isNull(), F.col(f"`{text_col}`")).otherwise(whole)
    unknown = F.array_sort(F.array_distinct(F.transform(F.filter("__v", lambda v: ~v["k"]), lambda v: v["token"])))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns],
        F.coalesce(F.size(F.filter("__v", lambda v: v["k"])), F.lit(0)).alias("restored"),
        F.coalesce(unknown, F.array().cast("array<string>")).alias("unresolved"),
    )


# Keyed and sealed tokens


def keyed_tokens(value: Column, category: str, ring: tk.KeyRing, length: int = 12) -> Column:
    """The same token for the same value on every machine, without a table: a MAC in a function's closure."""
    key, id = ring.derive("keyed"), ring.active
    tk.keyed_token(key, id, category, "", length)
    return F.udf(lambda v: None if v is None else tk.keyed_token(key, id, category, v, length), "string", useArrow=True)(value)


def vault_rows(df: DataFrame, value_col: str, category: str, ring: tk.KeyRing, *, subject_col: str | None = None, now: int = 0, ttl: int | None = None, length: int = 12) -> DataFrame:
    """The vault's rows for the distinct values of a column: token, sealed value, subjects' tags, times."""
    seal, tag_key, check_key, id = ring.derive("seal"), ring.derive("subject"), ring.derive("check"), ring.active
    tag = F.udf(lambda s: None if s is None else tk.subject_tag(tag_key, str(s)), "string", useArrow=True)
    check = F.udf(lambda v: tk.subject_tag(check_key, v), "string", useArrow=True)
    own = df.where(F.col(value_col).isNotNull()).withColumn("token", keyed_tokens(F.col(value_col), category, ring, length))
    tags = F.array_sort(F.collect_set(tag(F.col(subject_col).cast("string")))) if subject_col else F.array().cast("array<string>")
    rows = own.groupBy("token").agg(F.first(value_col).alias("__v"), F.max(value_col).alias("__w"), tags.alias("subjects"))
    clash = F.when(F.col("__v") == F.col("__w"), F.col("__v")).otherwise(F.raise_error(F.concat(F.lit("token collision: "), F.col("token"))))
    return rows.select(
        "token",
        F.lit(category).alias("category"),
        F.lit(id).alias("key_id"),
        F.aes_encrypt(clash, F.lit(seal), F.lit("GCM")).alias("sealed"),
        check(F.col("__v")).alias("check"),
        "subjects",
        F.lit(now).cast("long").alias("created_at"),
        F.lit(now + ttl if ttl is not None else None).cast("long").alias("expires_at"),
    )


def put_if_absent(vault: DataFrame, new: DataFrame) -> DataFrame:
    """The vault and the new rows whose tokens it doesn't have."""
    return vault.unionByName(new.dropDuplicates(["token"]).join(vault.select("token"), "token", "left_anti"))


def get(vault: DataFrame, ring: tk.KeyRing, now: int = 0) -> DataFrame:
    """token, category, value of the rows that haven't expired; null values where the key is destroyed."""
    value = F.lit(None).cast("string")
    for id, v in ring.versions.items():
        if v["state"] != "destroyed":
            value = F.when(F.col("key_id") == id, F.try_aes_decrypt("sealed", F.lit(ring.derive("seal", id)), F.lit("GCM")).cast("string")).otherwise(value)
    return vault.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("token", "category", value.alias("value"))


def replace(vault: DataFrame, expected: DataFrame, new: DataFrame) -> DataFrame:
    """Compare and swap: rows of new take the place of those whose token, key, sealed value and subjects' tags are as expected."""
    same = [F.col("v.token") == F.col("e.token"), F.col("v.key_id") == F.col("e.key_id"), F.col("v.sealed") == F.col("e.sealed"), F.col("v.subjects").eqNullSafe(F.col("e.subjects"))]
    hit = vault.alias("v").join(expected.alias("e"), same, "left_semi").select("token")
    return vault.join(hit, "token", "left_anti").unionByName(new.join(hit, "token", "left_semi"))


def forget_token(vault: DataFrame, *tokens: str) -> DataFrame:
    return vault.where(~F.col("token").isin(*tokens))


def forget_subject(vault: DataFrame, ring: tk.KeyRing, subject: str) -> DataFrame:
    """Without the subject: rows of it alone go, rows that others share lose its tag."""
    tag = tk.subject_tag(ring.derive("subject"), subject)
    rest = F.array_remove("subjects", tag)
    return vault.where(~(F.array_contains("subjects", tag) & (F.size(rest) == 0))).withColumn("subjects", rest)


def rewrap(vault: DataFrame, ring: tk.KeyRing) -> DataFrame:
    """All rows sealed by the active key; those of destroyed keys, which nothing can open, stay as they are."""
    value = F.lit(None).cast("string")
    for id, v in ring.versions.items():
        if v["state"] == "retired":
            value = F.when(F.col("key_id") == id, F.try_aes_decrypt("sealed", F.lit(ring.derive("seal", id)), F.lit("GCM")).cast("string")).otherwise(value)
    own = vault.withColumn("__v", value)
    opened = F.col("__v").isNotNull()
    return own.withColumn("sealed", F.when(opened, F.aes_encrypt("__v", F.lit(ring.derive("seal")), F.lit("GCM"))).otherwise(F.col("sealed"))).withColumn("key_id", F.when(opened, F.lit(ring.active)).otherwise(F.col("key_id"))).drop("__v")


def shred_key(vault: DataFrame, ring: tk.KeyRing, key_id: str) -> DataFrame:
    """Without the rows of a key, which is destroyed."""
    if key_id == ring.active:
        raise VaultError("the active key can't be shredded")
    if ring.versions.get(key_id, {}).get("state") != "destroyed":
        ring.destroy(key_id)
    return vault.where(F.col("key_id") != key_id)


def seal_tokens(value: Column, category: str, ring: tk.KeyRing) -> Column:
    """[PREFIX_KEY.sealed]: the value itself, encrypted, of at most 256 bytes (longer: null). Equal values have equal tokens."""
    key, mac, id = ring.derive("sealed"), ring.derive("sealed-iv"), ring.active
    iv = F.udf(lambda v: None if v is None else tk.sealed_iv(mac, category, id, v), "binary", useArrow=True)
    raw = F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), iv(value), F.lit(f"{category}:{id}"))
    url = F.rtrim(F.translate(F.base64(raw), "+/=\r\n", "-_"))
    return F.when(F.octet_length(value) <= 256, F.concat(F.lit(f"[{tk.prefix_of(category)}_{id}."), url, F.lit("]")))


def open_tokens(token: Column, category: str, ring: tk.KeyRing) -> Column:
    """The value of a sealed token; null if it isn't one or its key is destroyed."""
    body, id = F.regexp_extract(token, tk.SEALED_TOKEN.pattern, 3), F.regexp_extract(token, tk.SEALED_TOKEN.pattern, 2)
    padded = F.translate(body, "-_", "+/")
    padded = F.concat(padded, F.repeat(F.lit("="), (4 - F.length(padded) % 4) % 4))
    out = F.lit(None).cast("string")
    for k, v in ring.versions.items():
        if v["state"] != "destroyed":
            out = F.when(id == k, F.try_aes_decrypt(F.unbase64(padded), F.lit(ring.derive("sealed", k)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(f"{category}:{k}")).cast("string")).otherwise(out)
    return out


assert set(PREFIXES) == set(CATEGORIES)
