"""Command line: `python -m gridloom.cli compare|flowgate|to-rawx ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gridloom.config import FLOWGATE_HOPS, INCLUDE_AREAS
from gridloom.operators import flowgate
from gridloom.operators.compare import Comparison
from gridloom.sources import models, mon, rawx, sinks


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridloom")
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare", help="diff of two models, as CSV")
    c.add_argument("one")
    c.add_argument("two")
    c.add_argument("out")
    c.add_argument("--areas", type=int, nargs="*", default=list(INCLUDE_AREAS))
    f = sub.add_parser("flowgate", help="key facilities around flowgates, as CSV")
    f.add_argument("mon")
    f.add_argument("model")
    f.add_argument("out")
    f.add_argument("--sc")
    f.add_argument("--areas", type=int, nargs="*")
    f.add_argument("--hops", type=int, default=FLOWGATE_HOPS)
    r = sub.add_parser("to-rawx", help="a RAW case as RAWX")
    r.add_argument("model")
    r.add_argument("out")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if a.command == "compare":
        one, two = (models.load(spark, p).filter_by_area(a.areas) for p in (a.one, a.two))
        found = Comparison(one, two)
        sinks.comparison_csv(found.tables(), found.graph(), a.out, {"model1": a.one, "model2": a.two})
    elif a.command == "flowgate":
        found = flowgate.key_facilities(mon.read(spark, a.mon), models.load(spark, a.model), sc=a.sc, areas=a.areas, hops=a.hops)
        for name, df in found.items():
            sinks.write_csv(df, f"{a.out}/{name}")
    else:
        network = models.load(spark, a.model)
        rawx.write(network.sections, a.out, network.general)


if __name__ == "__main__":
    main()
