"""Runs a named query: python -m lociwave NAME DIR [--out PATH]; without a name it lists them.

Or a whole run over a workspace: python -m lociwave RUN -w WORKSPACE [-c config.yaml,more.yaml].
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lociwave import flows
from lociwave.plans import catalog
from lociwave.sources.config import settings


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lociwave", description=__doc__)
    parser.add_argument("name", nargs="?", choices=sorted([*catalog.QUERIES, *flows.FLOWS]))
    parser.add_argument("folder", nargs="?", help="folder of the Parquet tables")
    parser.add_argument("--out", help="write Parquet there instead of showing rows")
    parser.add_argument("-w", "--workspace", default=".", help="folder of a run")
    parser.add_argument("-c", "--config", default="config.yaml", help="settings files of the workspace, separated by commas")
    chosen = parser.parse_args(arguments)
    if chosen.name in flows.FLOWS:
        spark = SparkSession.builder.appName(f"lociwave {chosen.name}").getOrCreate()
        flows.FLOWS[chosen.name](spark, settings(flows.loaded(chosen.workspace, chosen.config)), chosen.workspace)
        return
    if not chosen.name or not chosen.folder:
        for name, plan in sorted({**catalog.QUERIES, **flows.FLOWS}.items()):
            print(f"{name}: {(plan.__doc__ or '').strip().splitlines()[0] if plan.__doc__ else ''}")
        return
    found = catalog.QUERIES[chosen.name](SparkSession.builder.appName(f"lociwave {chosen.name}").getOrCreate(), chosen.folder)
    if chosen.out:
        found.write.parquet(chosen.out)
    else:
        found.show(50, truncate=False)


if __name__ == "__main__":
    main()
