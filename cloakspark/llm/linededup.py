"""Line dedup by site-relative frequency, in DataFrame functions only.

Documents are grouped by host. A line's frequency is the number of a host's other documents that contain it too, divided by
the number of its other documents. What is known of a frequency depends on how many documents there are, so lines
whose frequency exceeds the boilerplate ratio at the lower end of its confidence interval (Wilson's) are dropped from all of
the host's documents: 18 in a host of 500, 3 in one of 10, 2 in one of 2. No host is too small.
With copies_once, equal texts of a host count as one document and what is mostly shared text stays whole, so that
groups of copies are left to near-dedup.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, pick

#: A line that surely more than this share of a host's other documents contain is boilerplate.
RATIO = 0.02
#: The lower bound of the share k / n of k of n other documents, at 95 %; in SQL that Spark and other engines read alike.
SHARE = "(k / n + 1.9208e0 / n - 1.96e0 * sqrt((k / n * (1e0 - k / n) + 0.9604e0 / n) / n)) / (1e0 + 3.8416e0 / n)"
#: With copies_once, a text of which less than this share of the characters would stay is a copy with edits: it stays whole.
LEAST_KEPT = 0.5
#: Bytes of boilerplate digests, all hosts together, that may be broadcast; more are joined by shuffling.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """The host of a URL column; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][+.0-9a-z-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def share(n_docs: str, n_pages: str) -> str:
    """SHARE of columns that count the documents with a line and all documents of its host."""
    own = {"k": f"cast({n_docs} - 1 as double)", "n": f"cast(greatest({n_pages} - 1, 1) as double)"}
    return " ".join(re.sub(r"\b[kn]\b", lambda m: own[m[0]], w) for w in SHARE.split(" "))


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, copies_once: bool = False) -> DataFrame:
    """host, line_hash, n_docs, n_pages of all lines above the ratio; blank lines are none, null hosts are one host.

    Lines are counted once for each document, or with copies_once for each distinct text of the host, in partial sums
    before they are shuffled by host and line, so that a hot host is spread over all tasks; the documents themselves are
    counted beside them, as a line without a hash.
    """
    hashes = F.coalesce(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key)), F.array().cast("array<bigint>"))
    d = pick(docs, text=text_col, host=host_col)
    if copies_once:  # only digests of texts and lines are shuffled
        d = d.select("host", F.xxhash64("text").alias("text_hash"), F.length("text").alias("n"), hashes.alias("hashes"))
        d, hashes = d.groupBy("host", "text_hash", "n").agg(F.first("hashes").alias("hashes")), F.col("hashes")
    rows = d.select("host", F.explode(F.array_append(hashes, F.lit(None).cast("long"))).alias("line_hash"))
    counts = cut(rows.groupBy("host", "line_hash").agg(F.count("*").alias("n_docs")).where("n_docs > 1 OR line_hash IS NULL"))
    pages = counts.where("line_hash IS NULL").select("host", F.col("n_docs").alias("n_pages"))
    lines = counts.where("line_hash IS NOT NULL")
    joined = lines.join(F.broadcast(pages) if pages.count() <= 1 << 16 else pages, lines.host.eqNullSafe(pages.host))
    return joined.where(F.expr(share("n_docs", "n_pages")) > F.lit(ratio)).select(lines.host, "line_hash", "n_docs", "n_pages")


def dedup_lines(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, dropped_col: str | None = None, copies_once: bool = False) -> DataFrame:
    """docs with the boilerplate lines of their hosts dropped from the text, and the number of dropped lines as dropped_col if named.

    All other columns stay as they are. Lines end at \\n and are compared without surrounding spaces; blank lines are
    never boilerplate. Null texts stay null, a text of boilerplate only becomes empty, documents that contain a line
    several times lose it each time and count once, rows with a null host count as one host, an empty table stays one,
    very long texts are split like others. A document that is alone in its host loses nothing.
    With copies_once, equal texts of a host count once, and a text that would keep less than LEAST_KEPT of the
    characters of its lines stays as it is.
    """
    found = boilerplate(docs, text_col=text_col, host_col=host_col, ratio=ratio, copies_once=copies_once)
    # A host's lines above the ratio are at most its lines per document divided by the ratio: a bounded list.
    drop, host = fresh("drop", "host")
    lists = cut(found.groupBy("host").agg(F.sort_array(F.collect_set("line_hash")).alias(drop)).withColumnRenamed("host", host))
    small = (lists.agg(F.sum(F.size(drop) * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES
    joined = docs.join(F.broadcast(lists) if small else lists, F.col(f"`{host_col}`").eqNullSafe(F.col(host)), "left")
    lines, same = _lines(F.col(f"`{text_col}`")), F.col(drop).isNull() | F.col(f"`{text_col}`").isNull()
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(drop), _key(x)) | (F.trim(x) == ""))
    if copies_once:
        chars = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(F.trim(x)))
        # Over an array of one, so that the lines are looked up once.
        kept = F.get(F.transform(F.array(kept), lambda k: F.when(chars(k) < chars(lines) * F.lit(LEAST_KEPT), lines).otherwise(k)), F.lit(0))
    text = F.when(same, F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if dropped_col:
        columns.append(F.when(same, F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long").alias(dropped_col))
    return joined.select(*columns)
