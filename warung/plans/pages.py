"""The dashboard's five pages as parameterized compositions of operators.

Each page function takes the marts (see ``marts.load_mart``) and the
sidebar selection, and returns every view of the page as a DataFrame
(nothing is computed until the caller acts on one).  Graph and forecast
pages ignore the sidebar, as the dashboard does: pair counts depend on whole
baskets, and the forecast is trained once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from warung.fixed_values import DEFAULT_GRAIN, DEFAULT_METRIC, GRAINS
from warung.operators import filters, forecast, graph, products, sales, visitors
from warung.operators.filters import DateLike


class EmptySelection(ValueError):
    """the filtered sales are empty; the page stops with a warning."""


def _view(marts, start, end, categories, statuses, check_empty=True):
    v = filters.filter_all(marts, start, end, categories, statuses)
    if check_empty and not filters.has_rows(v["sales"]):
        raise EmptySelection("no sales under this selection; widen one of the filters")
    return v


def sales_page(marts: dict[str, DataFrame], start: DateLike = None, end: DateLike = None,
               categories: Sequence[str] = (), statuses: Sequence[str] = (),
               grain: str = DEFAULT_GRAIN) -> dict[str, DataFrame]:
    """KPI cards, trend at the chosen grain (Harian / Mingguan / Bulanan),
    orders by status and the category table."""
    v = _view(marts, start, end, categories, statuses)
    kpi = sales.kpi_cards(v["rollup"], v["orders"], v["products"])
    tr = sales.trend(v["rollup"], GRAINS.get(grain, grain))
    return {"kpi": kpi, "cards": sales.report_labels(kpi), "trend": tr,
            "trend_long": sales.trend_long(tr), "trend_end": sales.trend_end_labels(tr),
            "status": sales.orders_by_status(v["orders"]),
            "categories": sales.category_table(v["rollup"], v["products"])}


def visitors_page(marts: dict[str, DataFrame], start: DateLike = None, end: DateLike = None,
                  categories: Sequence[str] = (), statuses: Sequence[str] = ()
                  ) -> dict[str, DataFrame]:
    """Funnel and sessions by source; only the date range applies to events."""
    v = _view(marts, start, end, categories, statuses)
    return {"funnel": visitors.funnel(v["events"]),
            "sources": visitors.sessions_by_source(v["events"])}


def products_page(marts: dict[str, DataFrame], start: DateLike = None, end: DateLike = None,
                  categories: Sequence[str] = (), statuses: Sequence[str] = ()
                  ) -> dict[str, DataFrame]:
    """Top products and brands by units and profit, and the rank-tie table."""
    v = _view(marts, start, end, categories, statuses)
    dim = marts["dim_products"]
    out = {}
    for m in ("units", "profit"):
        out[f"top_products_{m}"] = products.top_products(v["sales"], dim, m)
        out[f"top_brands_{m}"] = products.top_brands(v["sales"], dim, m)
    out["rank_ties"] = products.rank_ties(v["sales"])
    return out


def graph_page(pairs: DataFrame) -> dict[str, DataFrame]:
    """Counts and density, top pairs, the matrix in volume order, nodes, edges."""
    return {"volume": graph.category_volume(pairs), "density": graph.graph_density(pairs),
            "top_pairs": graph.top_pairs(pairs), "matrix": graph.co_purchase_matrix(pairs),
            "nodes": graph.graph_nodes(pairs), "edges": graph.graph_edges(pairs)}


def forecast_page(tables: dict[str, DataFrame], metric: str = DEFAULT_METRIC, suffix: str = "_b"
                  ) -> dict[str, DataFrame]:
    """Champion card, training meta, predicted vs actual, the two-run
    comparison for one metric, the score table and the feature impact.
    ``suffix`` names the second run's columns in ``skor`` (``_sklearn`` in
    tables scored by that library)."""
    skor, dampak, prediksi = tables["skor"], tables["dampak"], tables["prediksi"]
    card = forecast.model_card(skor)
    if "model" in dampak.columns:
        shown = forecast.champion_for_impact(skor, dampak).first()
    else:  # a table of the champion's impacts only
        shown = None
    champion = None if "model" in prediksi.columns else (card.select("model").first() or [None])[0]
    return {"card": card, "meta": tables["meta"],
            "predicted": forecast.predicted_vs_actual(prediksi, champion),
            "compare": forecast.compare_engines(skor, metric, suffix),
            "scores": forecast.score_table(skor),
            "impact": forecast.feature_impact_top(dampak, shown["model"] if shown else None)}
