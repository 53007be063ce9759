"""Command line: choose a catalog, filter, and print elems, records or dump lines."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import render, times
from .operators import filters as flt
from .operators.records import in_order
from .sources import catalog, dumps, rislive

log = logging.getLogger("routeloom")
#: The options that add one filter value each.
SHORT = {"p": "project", "c": "collector", "R": "router", "t": "type", "T": "resourcetype", "j": "peer", "J": "not_peer", "a": "origin", "k": "prefix", "y": "community", "A": "aspath"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="routeloom", description=__doc__)
    p.add_argument("-d", "--data-interface", default=catalog.DEFAULT, choices=sorted(catalog.INTERFACES))
    p.add_argument("-o", "--data-interface-option", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("-f", "--filter", default="")
    p.add_argument("-w", "--interval", action="append", default=[], metavar="BEGIN[,END]")
    p.add_argument("-P", "--rib-period", type=int)
    for short, kind in SHORT.items():
        p.add_argument(f"-{short}", dest=kind, action="append", default=[], metavar=kind.upper())
    p.add_argument("-n", "--rec-limit", type=int)
    p.add_argument("-r", "--records", action="store_true", help="print records")
    group = p.add_mutually_exclusive_group()
    group.add_argument("-e", "--elems", action="store_true", help="print elems (default)")
    group.add_argument("-m", "--dump", action="store_true", help="print elems as dump lines")
    p.add_argument("--output", help="write text files here, in no order, rather than print")
    return p


def filters_of(args: argparse.Namespace) -> flt.Filters:
    f = flt.parse(args.filter) if args.filter else flt.Filters()
    for kind in SHORT.values():
        for value in getattr(args, kind):
            f = f.add(kind, value)
    for text in args.interval:
        f = f.between(*times.parse_interval(text))
    return replace(f, rib_period=args.rib_period)


def lines(spark: SparkSession, args: argparse.Namespace) -> list[DataFrame]:
    """The asked-for lines, with the sort keys of the merged stream."""
    f = filters_of(args)
    options = dict(x.split("=", 1) for x in args.data_interface_option)
    resources = catalog.load(spark, args.data_interface, f, **{k.replace("-", "_"): v for k, v in options.items()})
    live = resources.where("format = 'ris-live'").select("url").collect()
    if live:
        text = spark.read.text([r.url for r in live]).withColumn("resource_id", F.lit("live")).withColumn("seq", F.monotonically_increasing_id())
        found = rislive.lines_to_records(text, "singlefile")
        elems = flt.apply(dumps.dress(rislive.records_to_elems(found)), f).withColumn("resource_id", F.lit("live")).withColumn("seq", F.lit(0))
        found = found.where(flt.all_of(flt.record_conditions(f))).withColumn("resource_id", F.lit("live")).withColumn("seq", F.lit(0))
    else:
        found, elems = dumps.records(resources, f), dumps.elems(resources, f)
    if args.rec_limit is not None:
        found = in_order(found).limit(args.rec_limit)
        elems = elems.join(found.select("resource_id", "seq"), ["resource_id", "seq"], "left_semi")
    keys = ["time_sec", "rec_type", "resource_id", "seq"]
    out = [found.select(*keys, F.lit(-1).alias("elem_idx"), render.record_line().alias("line"))] if args.records else []
    if args.elems or args.dump or not args.records:
        line = render.dump_line() if args.dump else render.elem_line()
        out.append(elems.select(*keys, "elem_idx", line.alias("line")))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO)
    try:
        spark = spark or SparkSession.builder.appName("routeloom").getOrCreate()
        parts = lines(spark, args)
    except (flt.FilterError, ValueError) as e:
        log.error("%s", e)
        return 2
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if args.output:
        whole.select("line").write.text(args.output)
        return 0
    ordered = in_order(whole.withColumn("seq", F.struct("seq", "elem_idx")))
    for row in ordered.select("line").toLocalIterator():
        print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
