"""Run batch stages:  python -m hubloom STAGE --store FOLDER [--raw FOLDER]

Stages: prepare, forecast, routing, optimise, figures, whatif, load, or all (the first
five in order).
"""

from __future__ import annotations

import argparse

from hubloom.config import RETAIL_NETWORK, STAR_NETWORK
from hubloom.plans import stages
from hubloom.session import build_session
from hubloom.sources.raw import MALFORMED, read_raw_csv, read_raw_parquet
from hubloom.sources.star import add_distance_freight, read_star_tables

CHAIN = ["prepare", "forecast", "routing", "optimise", "figures"]
READERS = {"csv": read_raw_csv, "parquet": read_raw_parquet, "star": read_star_tables}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hubloom", description=__doc__)
    parser.add_argument("stage", choices=[*CHAIN, "whatif", "load", "all"])
    parser.add_argument("--store", required=True, help="folder of the stage tables")
    parser.add_argument("--store-format", choices=["parquet", "csv"], default="parquet")
    parser.add_argument("--raw", help="folder of the raw tables (prepare)")
    parser.add_argument("--raw-format", choices=sorted(READERS), default="csv")
    parser.add_argument("--malformed", choices=MALFORMED, default="error",
                        help="what becomes of malformed CSV rows; rejected ones are stored as rejected_rows")
    parser.add_argument("--capacity-headroom", type=float, nargs="+", default=[1.5])
    parser.add_argument("--holding-cost", type=float, nargs="+", default=[1.0])
    parser.add_argument("--jdbc-url", help="database of the reporting tables (load)")
    args = parser.parse_args(argv)

    spark = build_session("hubloom-" + args.stage)
    star = args.raw_format == "star"
    config = STAR_NETWORK if star else RETAIL_NETWORK
    store = stages.Store(spark, args.store, args.store_format)
    if args.stage in ("prepare", "all") and not args.raw:
        parser.error("prepare needs --raw")
    if args.stage == "load":
        if not args.jdbc_url:
            parser.error("load needs --jdbc-url")
        stages.load_reporting(store, args.jdbc_url)
        return

    options = {"malformed": args.malformed} if args.raw_format == "csv" else {}
    run = {
        "prepare": lambda: stages.prepare(READERS[args.raw_format](spark, args.raw, **options), store, config,
                                          add_distance_freight if star else None),
        "forecast": lambda: stages.fit_forecast(store, config),
        "routing": lambda: stages.fit_flows(store, config),
        "optimise": lambda: stages.optimise(store, config),
        "figures": lambda: stages.write_figure_tables(store, config),
        "whatif": lambda: stages.whatif(store, config, args.capacity_headroom, args.holding_cost),
    }
    for stage in CHAIN if args.stage == "all" else [args.stage]:
        print(f"-- {stage}")
        run[stage]().show(50, truncate=False)


if __name__ == "__main__":
    main()
