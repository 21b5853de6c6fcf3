"""The corpus operators as registered queries, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table as table
from . import bpe, chat, decontam, langid, licenses, linededup, lm, neardup, pii, topk


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = r"\### Assistant: </turn> ok"
    mine = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trial).alias("text"))
    return chat.digests(chat.read_back(chat.render(chat.fold(chat.as_streamed(talk.unionByName(mine))))))


OP2_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '### ', '\h') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '### ', '\h'), ':', '\c') AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def _op6_kind(order: int, name: str, pattern: str, check: str) -> str:
    k = pii.KINDS[order]
    return f"""
SELECT rid, "start", {order} AS ord, "start" + length(value) AS "end", '{name}' AS kind,
  round({k.score} + CASE WHEN regexp_matches(lower(right(gap, {pii.CONTEXT})), '{k.words}') THEN {pii.NEAR} ELSE 0 END, 2) AS score
FROM (SELECT rid, v[i] AS value, g[i] AS gap, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS "start"
      FROM (SELECT rid, g, v, unnest(generate_series(1, len(v))) AS i FROM (SELECT rid, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS v FROM d)))
WHERE coalesce({check}, false)"""


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(list_reverse(string_split({_DIGITS}, '')), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4 THEN 2 * c::INTEGER - 9 ELSE 2 * c::INTEGER END)) % 10 = 0"
_MOD97 = "array_to_string(list_transform(string_split(substr(value, 5) || substr(value, 1, 4), ''), lambda c: CASE WHEN ord(c) < 65 THEN c ELSE (ord(c) - 55)::VARCHAR END), '')"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split({_MOD97}, ''), lambda c: c::INTEGER)), lambda a, c: (a * 10 + c) % 97) = 1"
_OP6_KINDS = (
    ("email", rf"[{pii.LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(value, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) <= 255))"),
    ("card", "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    ("iban", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", _MOD97),
)
OP6_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), s AS ("
    + " UNION ALL ".join(_op6_kind(i, *k) for i, k in enumerate(_OP6_KINDS))
    + "), a AS (SELECT rid, "
    + ", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in _OP6_KINDS)
    + """, string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", ord) FILTER (ord < 4) AS base,
string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", ord) AS spans, max(score)::DOUBLE AS best_score FROM s GROUP BY rid)
SELECT doc_id, """
    + ", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in _OP6_KINDS)
    + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, best_score FROM d LEFT JOIN a USING (rid)"
)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, min(a.n) + min(b.n) AS n FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2),
k AS (SELECT x, y FROM p WHERE 100 * c >= 80 * (n - c)),
l AS (SELECT x, y FROM k UNION SELECT y, x FROM k),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(y, doc_id)) AS kept FROM s LEFT JOIN m ON doc_id = x
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.dedup_lines(docs, dropped_col="n_dropped")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT source, count(*) AS n FROM d GROUP BY source),
l AS (SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM d),
c AS (SELECT source, line, count(*) AS c FROM l GROUP BY source, line),
b AS (SELECT c.source, list(line) AS found FROM c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
      WHERE c.c > 1 AND {linededup.share('c.c', 'p.n')} > {linededup.RATIO} GROUP BY c.source),
k AS (SELECT d.doc_id, d.source, d.text, d.lines, b.found,
             list_filter(d.lines, lambda x: trim(x) = '' OR NOT list_contains(coalesce(b.found, []), trim(x))) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CASE WHEN text IS NULL OR found IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CASE WHEN text IS NULL OR found IS NULL THEN 0 ELSE len(lines) - len(kept) END AS n_dropped
FROM k
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, qr ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_chat_format, op3_bpe, op4_lm_score, op5_decontamination, op6_pii, op7_minhash_near_dedup, op8_line_dedup, op9_language_id, op10_top_k)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op6_pii": OP6_SQL, "op7_minhash_near_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL, "op10_top_k": OP10_SQL}
