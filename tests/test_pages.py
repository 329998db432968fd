import pytest

from warung.plans import pages
from warung.sources import marts as M

SRC = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def marts(spark):
    m = M.build_marts(spark, SRC)
    m["category_pairs"] = M.build_graph(spark, SRC)
    return m


def test_sales_page_with_selection(spark, marts):
    p = pages.sales_page(marts, "1996-01-01", "1997-12-31", ["ECONOMY ring"], ["Complete"], "Mingguan")
    kpi = p["kpi"].first()
    assert kpi.gross_sales > 0 and p["cards"].count() == 5
    weeks = [r.tanggal for r in p["trend"].collect()]
    assert all(w.weekday() == 0 for w in weeks)
    assert sum(r.gross_sales for r in p["trend"].collect()) == pytest.approx(kpi.gross_sales)
    assert {r.status for r in p["status"].collect()} <= {"Complete"}


def test_empty_selection_stops(spark, marts):
    with pytest.raises(pages.EmptySelection):
        pages.sales_page(marts, "1990-01-01", "1990-12-31")


def test_other_pages(spark, marts):
    assert pages.visitors_page(marts)["funnel"].count() == 4
    prod = pages.products_page(marts)
    assert prod["top_products_units"].count() == 10
    g = pages.graph_page(marts["category_pairs"])
    assert g["density"].first().n_pairs == marts["category_pairs"].count()


def test_forecast_page_from_tables_without_model_columns(spark):
    import datetime as dt

    from warung.operators import forecast as FC
    skor = FC.pick_champion(spark.createDataFrame(
        [("Linear", 0.0, 0.9, 100.0, 1e4, 0.05, 0.89, 101.0, 1.0e4, 0.051),
         ("Naive", None, 0.5, 200.0, 4e4, 0.2, None, None, None, None)],
        "model string, reg_param double, r2 double, rmse double, mse double, mape double, "
        "r2_b double, rmse_b double, mse_b double, mape_b double"))
    tables = {
        "skor": skor,
        "prediksi": spark.createDataFrame([(dt.datetime(2024, 1, 1), 10.0, 9.0)],
                                          "week timestamp_ntz, aktual double, prediksi double"),
        "dampak": spark.createDataFrame([("lag_1", -3.0), ("t", 2.0)], "fitur string, dampak double"),
        "meta": spark.createDataFrame([(10, 5, dt.datetime(2024, 1, 1))],
                                      "n_latih int, n_uji int, batas timestamp_ntz"),
    }
    page = pages.forecast_page(tables, "MAPE")
    assert page["card"].first().model == "Linear"
    assert {r.series for r in page["predicted"].collect()} == {"Laba sebenarnya", "Tebakan Linear"}
    assert [r.fitur for r in page["impact"].collect()] == ["lag_1", "t"]
    assert page["compare"].count() == 2 and page["scores"].count() == 2
