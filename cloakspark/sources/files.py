"""Files of texts, JSON Lines and CSV: scanned to findings, scrubbed to files alike."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..errors import ValidationError
from ..operators.json_text import sanitize
from ..operators.text import scan as scan_column
from ..plans.spec import cached, compile_pipeline


def format_of(path: str) -> str:
    """By the ending, .gz apart: jsonl, csv (also tsv), else txt."""
    end = re.sub(r"\.gz$", "", path.lower()).rpartition(".")[2]
    return "jsonl" if end in ("jsonl", "ndjson") else "csv" if end in ("csv", "tsv") else "txt"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and file; gzip is read as it is named."""
    return spark.read.text(path).withColumn("file", F.input_file_name())


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """value: a whole file for each row, line ends kept."""
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.option("sep", sep).option("header", header).option("multiLine", True).option("escape", '"').csv(path)


def select_columns(header: list[str], wanted: list[str]) -> list[int]:
    """Places of columns by name (any case, trimmed, without byte order mark) or number from 1."""
    names = [h.lstrip("﻿").strip().lower() for h in header]
    out = []
    for w in wanted:
        if w.strip().lower() in names:
            out.append(names.index(w.strip().lower()))
        elif w.strip().isdigit() and 1 <= int(w) <= len(header):
            out.append(int(w) - 1)
        else:
            raise ValidationError("columns", f"there is no column {w!r}")
    return out


def parse_csv(text: str, sep: str = ","):
    """Records as ([(field, quoted)], line end): quotes, doubled quotes, and all three line ends."""
    fields, i, n = [], 0, len(text)
    while i < n or fields:
        if i < n and text[i] == '"':
            out, i = [], i + 1
            while i < n:
                j = text.find('"', i)
                j = n if j < 0 else j
                out.append(text[i:j])
                i = j + 1
                if i < n and text[i] == '"':
                    out.append('"')
                    i += 1
                else:
                    break
            rest = re.compile(f"[^{re.escape(sep)}\r\n]*").match(text, min(i, n))
            fields.append(("".join(out) + rest[0], True))
            i = rest.end()
        else:
            m = re.compile(f"[^{re.escape(sep)}\r\n]*").match(text, i)
            fields.append((m[0], False))
            i = m.end()
        if i < n and text[i] == sep:
            i += 1
            if i == n:
                fields.append(("", False))
            continue_record = i < n
            if continue_record:
                continue
        end = "\r\n" if text[i : i + 2] == "\r\n" else text[i : i + 1]
        yield fields, end
        fields, i = [], i + len(end)


def format_csv(fields, end: str, sep: str = ",") -> str:
    quote = lambda v, q: '"' + v.replace('"', '""') + '"' if q or any(c in v for c in (sep, '"', "\r", "\n")) else v
    return sep.join(quote(v, q) for v, q in fields) + end


def scrub_csv_text(text: str, transform, columns: list[str] | None = None, sep: str = ",", header: bool = True) -> str:
    """The same file, byte for byte but for the chosen fields' replacements."""
    out, own = [], None
    for i, (fields, end) in enumerate(parse_csv(text, sep)):
        if i == 0 and header:
            own = select_columns([f for f, _ in fields], columns) if columns else None
            out.append(format_csv(fields, end, sep))
            continue
        if i == 0 and columns:
            own = select_columns([""] * len(fields), columns)
        out.append(format_csv([(transform(v) if own is None or j in own else v, q) for j, (v, q) in enumerate(fields)], end, sep))
    return "".join(out)


def scrub(df: DataFrame, kind: str, spec: dict | None = None, **csv) -> DataFrame:
    """df (value: a whole text, a line of JSON Lines or a whole CSV file) with value scrubbed and tally, a map of counts."""
    compile_pipeline(spec)
    s = json.dumps(spec or {}, sort_keys=True)
    if kind == "jsonl":
        x = sanitize(F.col("value"), spec, fallback_to_text=True)
        blank = F.trim("value") == ""
        own = df.withColumn("__x", F.when(~blank, x)).withColumn("value", F.when(blank, F.col("value")).otherwise(F.col("__x.json")))
        pairs = F.coalesce(F.transform("__x.fields", lambda f: F.struct(f["category"].alias("c"), f["count"].alias("n"))), F.array().cast("array<struct<c:string,n:int>>"))
        names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["c"])))
        total = lambda c: F.aggregate(F.filter(pairs, lambda p: p["c"] == c), F.lit(0), lambda a, p: a + p["n"])
        return own.withColumn("tally", F.map_from_arrays(names, F.transform(names, total))).drop("__x")

    def run(t):
        if t is None:
            return None
        tally: dict[str, int] = {}

        def one(v: str) -> str:
            new, spans = cached(s).transform(v)
            for x in spans:
                tally[x[2]] = tally.get(x[2], 0) + 1
            return new

        new = scrub_csv_text(t, one, **csv) if kind == "csv" else one(t)
        return new, dict(sorted(tally.items()))

    r = F.udf(run, "struct<value:string,tally:map<string,int>>", useArrow=True)(F.col("value"))
    return df.withColumn("__r", r).withColumn("value", F.col("__r.value")).withColumn("tally", F.col("__r.tally")).drop("__r")


def scan(df: DataFrame, spec: dict | None = None) -> DataFrame:
    """df (value: a record) with spans; see operators.text for findings, totals and tallies."""
    return df.withColumn("spans", scan_column(F.col("value"), spec))


def found_any(df: DataFrame, spec: dict | None = None) -> bool:
    """Whether any record holds anything: the action behind failing a build."""
    return bool(scan(df, spec).where(F.size("spans") > 0).limit(1).count())


def write_lines(df: DataFrame, path: str, compressed: bool = False) -> None:
    df.select("value").write.mode("overwrite").option("compression", "gzip" if compressed else "none").text(path)


SPANS = S.SPANS
