"""python -m chronolake: query a lake, see what it holds, list the parsers, append files."""

import argparse

from chronolake.lake import Lake
from chronolake.plans import pages
from chronolake.session import session
from chronolake.sources import PARSERS
from chronolake.streaming import ingest


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="chronolake", description=__doc__)
    out.add_argument("--master", help="where Spark runs; by default what spark-submit or the configuration says")
    tasks = out.add_subparsers(dest="task", required=True)
    query = tasks.add_parser("query", help="run one SELECT: raw, or as of an instant")
    query.add_argument("lake")
    query.add_argument("sql")
    query.add_argument("--as-of", help="a day or an instant with a zone; only what was known then is seen")
    query.add_argument("-d", "--dataset", action="append", default=[], help="a dataset that the query reads (with --as-of)")
    query.add_argument("--rows", type=int, default=50, help="rows to show")
    status = tasks.add_parser("status", help="rows, files, span and age of every dataset")
    status.add_argument("lake")
    tasks.add_parser("fetchers", help="the parsers by name")
    load = tasks.add_parser("ingest", help="append Parquet files of a dataset that have not been read yet")
    load.add_argument("lake")
    load.add_argument("files")
    load.add_argument("dataset")
    load.add_argument("asset_class")
    load.add_argument("--checkpoint", required=True, help="a shared folder that remembers which files were read")
    return out


def main(argv=None, spark=None) -> int:
    """The exit status; tables go to standard output.  spark: a session to use instead of a new one."""
    args = parser().parse_args(argv)
    if args.task == "fetchers":
        print("\n".join(sorted(PARSERS)))
        return 0
    if args.task == "query" and bool(args.as_of) != bool(args.dataset):
        parser().error("--as-of and --dataset go together")
    spark = spark or session(args.master)
    lake = Lake(spark, args.lake)
    if args.task == "query":
        rows = lake.as_of(args.as_of).sql(args.sql, args.dataset) if args.as_of else lake.sql(args.sql)
        rows.show(args.rows, truncate=False)
    elif args.task == "status":
        stats = lake.stats()
        stats.withColumn("freshness", pages.freshness()).orderBy("dataset", "source", "asset_class").show(1000, truncate=False)
    else:
        done = ingest.ingest(ingest.incoming(spark, args.files, args.dataset), args.lake, args.asset_class, args.checkpoint)
        done.awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
