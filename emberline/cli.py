"""``python -m emberline.cli run|validate|list|test``."""

from __future__ import annotations

import argparse
import sys

from emberline.engine import Engine
from emberline.schema import host_schema
from emberline.sources import rules as R


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("emberline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="emberline")
    sub = p.add_subparsers(dest="what", required=True)
    for name, about in (("validate", "check the rules of a folder"), ("list", "list the rules of a folder"), ("run", "write the alerts of JSON events"), ("test", "show the alerts of JSON events")):
        s = sub.add_parser(name, help=about)
        s.add_argument("--rules", required=True)
        if name in ("run", "test"):
            s.add_argument("--events", required=True)
        if name == "run":
            s.add_argument("--out", required=True)
            s.add_argument("--mode", default="detect", choices=("inline", "detect", "offline"))
    a = p.parse_args(args)
    engine = Engine(host_schema(), mode=getattr(a, "mode", "detect"))
    if a.what == "list":
        for r in R.load_all(a.rules).rules:
            print(f"{r.rule_id}\t{r.severity}\t{'sequence' if r.is_sequence else 'event'}\t{r.name}")
        return 0
    failed = engine.load(a.rules)
    for path, why in failed.items():
        print(f"{path}: {why}", file=sys.stderr)
    if a.what == "validate":
        print(f"{len(engine.rules)} rules, {len(failed)} failed")
        return int(bool(failed))
    events = _session().read.schema(host_schema().struct()).json(a.events)
    alerts = engine.decisions(events)
    if a.what == "run":
        alerts.write.mode("append").json(a.out)
    else:
        alerts.select("ts", "rule_id", "severity", "entity_key", "action", "outcome").orderBy("ts").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
