"""python -m cloakspark scan|scrub|list: files through Spark.

scan IN [--preset P] [--policy FILE] [--columns A,B] [--json] [--fail-on-found]
scrub IN OUT [--preset P] [--policy FILE] [--columns A,B] [--strategy S] [--gzip]
list categories|presets|regulations
Exit codes: 0 done, 1 something was found and that was to fail, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import CloakError
from .operators import text
from .plans import policy, presets
from .sources import files


def _spec(a: argparse.Namespace) -> dict:
    spec: dict = {}
    if a.policy:
        with open(a.policy, encoding="utf-8") as f:
            spec = policy.to_spec(policy.parse(json.load(f)))
    if a.preset:
        spec["preset"] = a.preset.split(",")
    if getattr(a, "strategy", None):
        spec["default_strategy"] = {"strategy": a.strategy}
    return spec


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("cloakspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "scrub"):
        s = sub.add_parser(name)
        s.add_argument("input")
        if name == "scrub":
            s.add_argument("output")
            s.add_argument("--strategy")
            s.add_argument("--gzip", action="store_true")
        s.add_argument("--format", choices=("txt", "jsonl", "csv"))
        s.add_argument("--preset")
        s.add_argument("--policy")
        s.add_argument("--columns")
        s.add_argument("--json", action="store_true")
        s.add_argument("--fail-on-found", action="store_true")
    sub.add_parser("list").add_argument("what", choices=("categories", "presets", "regulations"))
    try:
        a = p.parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    if a.command == "list":
        print("\n".join({"categories": list(presets.PREFIXES), "presets": list(presets.PRESETS), "regulations": list(presets.REGULATIONS)}[a.what]))
        return 0
    spark = SparkSession.builder.appName("cloakspark").getOrCreate()
    try:
        spec, kind = _spec(a), a.format or files.format_of(a.input)
        if a.command == "scrub":
            own = {"columns": a.columns.split(","), "sep": "\t" if ".tsv" in a.input else ","} if kind == "csv" and a.columns else {}
            df = files.read_lines(spark, a.input) if kind == "jsonl" else files.read_whole(spark, a.input)
            done = files.scrub(df, kind, spec, **own)
            files.write_lines(done, a.output, a.gzip)
            tally = done.select(F.explode("tally").alias("category", "n"))
        else:
            df = files.scan(files.read_lines(spark, a.input), spec)
            tally = text.tally(df, "spans")
        counts = {r["category"]: r["n"] for r in tally.groupBy("category").agg(F.sum("n").alias("n")).orderBy("category").collect()}
        print(json.dumps({"tally": counts, "total": sum(counts.values())}) if a.json else "\n".join(f"{c}\t{n}" for c, n in counts.items()))
        return int(a.fail_on_found and bool(counts))
    except (CloakError, OSError, ValueError) as e:
        print(f"cloakspark: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
