"""Run registered views from the command line.

    python -m warung --list
    python -m warung kpi_cards /root/testdata/sf0.01
    python -m warung top_products_units /root/testdata/sf0.01
    python -m warung trend_monthly /data/retail --out /shared/reports/trend
    python -m warung --page sales /data/retail --start 1996-01-01 --end 1997-12-31 \
        --category "ECONOMY ring" --status Complete --grain Mingguan
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m warung")
    p.add_argument("key", nargs="?", help="registered view, e.g. kpi_cards")
    p.add_argument("root", nargs="?", default="/root/testdata/sf0.01",
                   help="folder holding the source tables (one parquet data set each)")
    p.add_argument("--list", action="store_true", help="list the registered views")
    p.add_argument("--out", help="write the whole result as parquet here instead of printing")
    p.add_argument("--master", default=None, help="Spark master (the launcher's by default)")
    p.add_argument("--page", choices=["sales", "visitors", "products", "graph", "forecast"],
                   help="show every view of one dashboard page instead of one key")
    p.add_argument("--start", help="first day of the date filter")
    p.add_argument("--end", help="last day of the date filter")
    p.add_argument("--category", action="append", default=[], help="category filter (repeatable)")
    p.add_argument("--status", action="append", default=[], help="status filter (repeatable)")
    p.add_argument("--grain", default="Bulanan", help="trend grain: Harian, Mingguan or Bulanan")
    args = p.parse_args(argv)

    if args.page:
        return _page(args)

    from warung.plans import catalog
    if args.list or not args.key:
        for k, q in catalog.REGISTRY.items():
            first = (q.doc.splitlines() or [""])[0]
            print(f"{k:28s} {'sql ' if q.sql else 'rows'}  {first}")
        return 0
    if args.key not in catalog.REGISTRY:
        print(f"unknown view {args.key!r}; see --list", file=sys.stderr)
        return 2

    from warung.session import get_session
    spark = get_session(args.master)
    df = catalog.REGISTRY[args.key].run(spark, args.root)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        _print(df, args.key)
    return 0


PRINTED = 1000


def _print(df, name: str) -> None:
    """Print a view whole; one too long for a terminal has to be written."""
    rows = df.limit(PRINTED + 1).collect()
    if len(rows) > PRINTED:
        raise SystemExit(f"{name} has more than {PRINTED} rows; write it with --out")
    print("\t".join(df.columns))
    for r in rows:
        print("\t".join("" if v is None else str(v) for v in r))


def _page(args) -> int:
    from warung.plans import catalog, pages
    from warung.session import get_session
    spark = get_session(args.master)
    marts = catalog._marts(spark, args.key or args.root)
    sel = dict(start=args.start, end=args.end, categories=args.category, statuses=args.status)
    if args.page == "sales":
        views = pages.sales_page(marts, grain=args.grain, **sel)
    elif args.page == "visitors":
        views = pages.visitors_page(marts, **sel)
    elif args.page == "products":
        views = pages.products_page(marts, **sel)
    elif args.page == "graph":
        views = pages.graph_page(marts["category_pairs"])
    else:
        views = pages.forecast_page(catalog._forecast_tables(spark, args.key or args.root))
    for name, df in views.items():
        print(f"== {name}")
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
        else:
            _print(df, name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
