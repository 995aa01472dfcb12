"""Command line: ``python -m quillmeter.cli --sessions DIR --group model``; prices: ``python -m quillmeter.cli prices``."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from .options import parse_args
from .plans.usage import run
from .pricing.catalog import Catalog, built_in, observe, read_cache, to_iso, verify, write_cache
from .pricing.pages import parse_page
from .service import QueryService
from .sinks import to_csv, to_json, to_text
from .streaming.incremental import UsageIndex

USAGE = "usage: quillmeter [--sessions DIR]... [--from T] [--to T] [--last 7d | --today] [--group none|day|month|model|cwd|session] [--sort NAME] [--desc|--asc] [--limit N] [--dedupe-scope global|file] [--timezone TZ] [--use-cache [--cache-dir DIR]] [--json|--csv]"


def session() -> SparkSession:
    return SparkSession.builder.appName("quillmeter").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def prices(argv: list[str], out=sys.stdout) -> int:
    """``prices CACHE PAGE MODEL [--check] [--seed --effective-from DATE --source-url URL]``: take prices from a saved page."""
    cache, page, model, *rest = argv
    catalog: Catalog = read_cache(cache) or built_in()
    with open(page, encoding="utf-8") as f:
        found = parse_page(f.read(), model)
    now = int(time.time() * 1000)
    if "--seed" in rest:
        pick = lambda name: rest[rest.index(name) + 1] if name in rest else ""
        _, changed = verify(catalog, model, found, pick("--effective-from"), pick("--source-url"), now)
    else:
        changed = observe(catalog, model, found, now) is not None
    print("changed" if changed else "unchanged", file=out)
    if "--check" in rest:
        return int(changed)
    if changed:
        catalog.checked_at = to_iso(now)
        write_cache(cache, catalog)
    return 0


def main(argv: list[str] | None = None, out=None, err=None) -> int:
    argv, out, err = sys.argv[1:] if argv is None else argv, out or sys.stdout, err or sys.stderr
    if argv[:1] == ["prices"]:
        return prices(argv[1:], out)
    try:
        query = parse_args(argv)
    except ValueError as e:
        print(f"error: {e}", file=err)
        return 1
    if query.extra["help"]:
        print(USAGE, file=out)
        return 0
    spark = session()
    tell = lambda step: print(", ".join(f"{k} {v}" for k, v in step.items()), file=err, flush=True)
    if query.extra["use_cache"]:
        index = UsageIndex(spark, query.extra["cache"] or "quillmeter-index")
        index.refresh(list(query.roots), progress=tell)
        answer = QueryService(index).query(query)
    else:
        tell({"phase": "scan"})
        answer = run(spark, query)
    print(to_json(answer) if query.extra["json"] else to_csv(answer["rows"]) if query.extra["csv"] else to_text(answer), file=out)
    return 2 if answer["index"]["incomplete"] else 0


if __name__ == "__main__":
    sys.exit(main())
