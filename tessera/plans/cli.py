"""Command line: sources in, one JSON document out."""

from __future__ import annotations

import argparse
import json
import os
import sys

from tessera.plans.fusion import Result, dumped, envelope, read_manifest, run
from tessera.sources.profile import http_fetch


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(args: list[str] | None = None, spark=None) -> int:
    """0 if all went well; 1 on any error, unless --allow-partial and some candidate is left."""
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--csv", action="append", default=[])
    p.add_argument("--note", action="append", default=[])
    p.add_argument("--github", action="append", default=[])
    p.add_argument("--enrich-github", action="store_true")
    p.add_argument("--config")
    p.add_argument("--output")
    p.add_argument("--manifest")
    p.add_argument("--allow-partial", action="store_true")
    p.add_argument("--default-phone-region")
    a = p.parse_args(args)
    csv, notes, urls, refs, config = list(a.csv), list(a.note), list(a.github), {}, None
    try:
        if a.config:
            with open(a.config, encoding="utf-8") as f:
                config = json.load(f)
        if a.manifest:
            more_csv, more_notes, refs, more_urls = read_manifest(a.manifest)
            csv, notes, urls = csv + more_csv, notes + more_notes, urls + more_urls
    except (OSError, ValueError) as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 1
    result: Result = run(spark or session(), csv, notes, urls, refs, config, a.default_phone_region, fetch=http_fetch(os.environ.get("GITHUB_TOKEN") or None), enrich=a.enrich_github)
    for w in result.warnings:
        print(f"WARNING: {w}", file=sys.stderr)
    for e in result.errors:
        print(f"ERROR: {e}", file=sys.stderr)
    if result.errors and not a.allow_partial:
        return 1
    document = envelope(result, config is not None)
    text = dumped(document)
    if a.output:
        os.makedirs(os.path.dirname(os.path.abspath(a.output)), exist_ok=True)
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        sys.stdout.write(text)
    return int(bool(result.errors) and not document["candidates"])


if __name__ == "__main__":
    sys.exit(main())
