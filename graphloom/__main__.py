"""Command line: python -m graphloom --schema NAME=FILE.exp [--base IRI] [--remove-duplicates] (--dir DIR [--to FOLDER] | IN OUT)."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from graphloom.plans.convert import convert
from graphloom.sources.express import load_catalog
from graphloom.sources.sinks import beside, write_turtle, write_turtle_folders


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description="Exchange files to typed triples in Turtle.")
    parser.add_argument("--schema", action="append", required=True, metavar="NAME=FILE", help="EXPRESS file of a schema, such as IFC4_ADD2_TC1=/schemas/IFC4_ADD2_TC1.exp; repeatable")
    parser.add_argument("--base", help="address that all resources begin with; default has a time stamp")
    parser.add_argument("--dir", help="convert all .ifc files below a folder, each to a .ttl file beside it")
    parser.add_argument("--to", help="with --dir: the executors write one .ttl file an input below this shared folder instead")
    parser.add_argument("--remove-duplicates", action="store_true", help="instances of equal text become one")
    parser.add_argument("paths", nargs="*", metavar="IN OUT")
    given = parser.parse_args(args)
    if bool(given.dir) == bool(given.paths) or given.paths and len(given.paths) != 2:
        parser.error("give --dir DIR or IN and OUT")
    if given.to and not given.dir:
        parser.error("--to needs --dir")
    base = given.base or f"http://example.org/resources{datetime.now():%Y%m%d_%H%M%S}/"
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    catalogs = {name: load_catalog(spark, path, name) for name, _, path in (x.partition("=") for x in given.schema)}
    source = given.dir or given.paths[0]
    conversion = convert(spark, source, catalogs, base, given.remove_duplicates, glob="*.ifc" if given.dir else None)
    if given.to:
        write_turtle_folders(conversion, given.to)
        print(given.to)
    else:
        for path in write_turtle(conversion, beside if given.dir else lambda _: given.paths[1]):
            print(path)
    bad = conversion.status.where("state != 'OK' or cutoff is not null").collect()
    for r in bad:
        print(f"{r['file']}: {r['state']}" + (f", unknown name at #{r['cutoff']}" if r["cutoff"] is not None else ""), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
