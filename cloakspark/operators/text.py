"""Detection and transformation of text columns: one Arrow function reads a text once and does it all.

Configurations are checked when an operator is built. A text that can't be handled gives an error and no text, never
the original. Null texts give null results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType
from pyspark.util import PythonEvalType

from .. import schemas as S
from ..functions import legacy
from ..plans.spec import Legacy, cached, compile_pipeline

#: Texts that a worker holds as objects at once.
ROWS_AT_ONCE = 128


def _udf(f, kind: str):
    """Called non-deterministic so that a text is read once: else filters that follow, also those which an explode implies, are
    pushed below and call the function again."""
    return F.udf(f, kind, useArrow=True).asNondeterministic()


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """Values as Arrow has them; structs are tuples."""
    if pa.types.is_struct(kind):
        none = (None,) * kind.num_fields
        columns = zip(*[none if v is None else v for v in values]) if values else [()] * kind.num_fields
        return pa.StructArray.from_arrays([_array(list(c), f.type) for c, f in zip(columns, kind)], fields=list(kind), mask=pa.array([v is None for v in values], pa.bool_()))
    if pa.types.is_list(kind):
        ends = [0, *accumulate(len(v or ()) for v in values)]
        starts = [None if v is None else at for v, at in zip(values, ends)]
        return pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), _array([x for v in values for x in v or ()], kind.value_type), type=kind)
    return pa.array(values, kind)


def _sliced(f, kind: str):
    """As _udf, for long texts: however many rows Spark sends at once, only some texts and their results are held as objects,
    and results go back as they are made."""
    to = to_arrow_type(DataType.fromDDL(kind))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for at in range(0, len(part), ROWS_AT_ONCE):
                yield _array([f(t) for t in part.slice(at, ROWS_AT_ONCE).to_pylist()], to)
            if not len(part):
                yield _array([], to)

    return F.arrow_udf(run, kind, PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF).asNondeterministic()


def detect(text: Column, categories=None, *, aggressive: bool = False, detectors: dict | None = None, apart: bool = False) -> Column:
    """Array of (category, value, start, end, confidence), sorted and disjoint: the first generation's detection. With apart,
    only matches of one category are disjoint: counts of a category are then the same whatever others are looked for."""
    Legacy({"categories": list(categories)} if categories else {}, detectors)
    return _sliced(lambda t: None if t is None else legacy.detect(t, categories, detectors=detectors, aggressive=aggressive, apart=apart), S.MATCHES)(text)


def has_sensitive(text: Column, categories=None) -> Column:
    """Whether a text holds anything of the categories; stops at the first hit and knows no allow-list."""
    own = [legacy.DETECTORS[c] for c in (categories or legacy.CATEGORIES)]
    return _udf(lambda t: None if t is None else any(d(t) for d in own), "boolean")(text)


def anonymize(text: Column, options: dict | None = None, *, detectors: dict | None = None, validators: dict | None = None) -> Column:
    """Struct of text, matches and error, by the first generation's rules."""
    Legacy(options, detectors, validators)

    def run(t):
        if t is None:
            return None
        try:
            out, found = Legacy(options, detectors, validators).anonymize(t)
            return out, found, None
        except Exception as e:  # noqa: BLE001 - withheld, not passed on
            return None, None, type(e).__name__

    return _sliced(run, S.ANONYMIZED)(text)


def scan(text: Column, spec: dict | None = None) -> Column:
    """Array of spans (start, end, category, confidence, detector, residual); offsets only."""
    compile_pipeline(spec)
    s = json.dumps(spec or {}, sort_keys=True)
    return _udf(lambda t: None if t is None else cached(s).scan(t), S.SPANS)(text)


def test(text: Column, spec: dict | None = None) -> Column:
    compile_pipeline(spec)
    s = json.dumps(spec or {}, sort_keys=True)
    return _udf(lambda t: None if t is None else cached(s).test(t), "boolean")(text)


def transform(text: Column, spec: dict | None = None) -> Column:
    """Struct of text, spans with their places in it, and error."""
    compile_pipeline(spec)
    s = json.dumps(spec or {}, sort_keys=True)

    def run(t):
        if t is None:
            return None
        try:
            return (*cached(s).transform(t), None)
        except Exception as e:  # noqa: BLE001
            return None, None, type(e).__name__

    return _sliced(run, S.TRANSFORMED)(text)


def transform_distinct(df: DataFrame, text_col: str, spec: dict | None = None, out_col: str = "transformed") -> DataFrame:
    """df with transform(text), each distinct text handled once: for columns whose values repeat a lot."""
    own = df.select(F.col(text_col).alias("__t")).where("__t IS NOT NULL").distinct().withColumn(out_col, transform(F.col("__t"), spec))
    return df.join(own, F.col(text_col) == F.col("__t"), "left").drop("__t")


def span_text(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def exploded(df: DataFrame, spans_col: str, *keep: str) -> DataFrame:
    """One row for each span or match, its members as columns."""
    return df.select(*keep, F.explode(spans_col).alias("__s")).select(*keep, "__s.*")


def tally(df: DataFrame, spans_col: str, *by: str) -> DataFrame:
    """How many spans of each category, by the given columns."""
    return exploded(df, spans_col, *by).groupBy(*by, "category").agg(F.count("*").alias("n"))


def receipt_stats(df: DataFrame, spans_col: str) -> DataFrame:
    """stats (a map with sorted keys) and total over all rows."""
    t = tally(df, spans_col)
    return t.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("stats"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def findings(df: DataFrame, spans_col: str, *at: str) -> DataFrame:
    """line columns, category, count: what a scan reports of each record."""
    return tally(df, spans_col, *at).withColumnRenamed("n", "count")


def totals(df: DataFrame, spans_col: str) -> DataFrame:
    """records, records_with_pii."""
    return df.agg(F.count("*").alias("records"), F.count_if(F.size(spans_col) > 0).alias("records_with_pii"))


def register(spark: SparkSession) -> None:
    """SQL functions: cloak_detect(text), cloak_redact(text), cloak_has_sensitive(text), and the table function cloak_spans(text)."""
    from pyspark.sql.functions import udtf

    spark.udf.register("cloak_detect", _udf(lambda t: None if t is None else legacy.detect(t), S.MATCHES))
    spark.udf.register("cloak_redact", _udf(lambda t: None if t is None else cached("{}").transform(t)[0], "string"))
    spark.udf.register("cloak_has_sensitive", _udf(lambda t: None if t is None else any(d(t) for d in legacy.DETECTORS.values()), "boolean"))

    @udtf(returnType="start: int, end: int, category: string, confidence: double, detector: string, residual: boolean")
    class Spans:
        def eval(self, text: str):
            if text is not None:
                yield from cached("{}").scan(text)

    spark.udtf.register("cloak_spans", Spans)
