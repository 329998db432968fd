"""Fixed values the results depend on.

FIXED VALUES — these must equal the dashboard being reproduced, so they are
kept here, together, in their natural order.
"""

# FIXED VALUES: order status domain, in display order.
STATUS_ORDER = ["Complete", "Shipped", "Processing", "Cancelled", "Returned"]

# FIXED VALUES: traffic source domain, in display order.
TRAFFIC_SOURCES = ["Email", "Adwords", "YouTube", "Facebook", "Organic"]

# FIXED VALUES: funnel stages, their names, and the three funnel rows
# (purchase and cancel share the last row).
FUNNEL_STAGES = ["product", "cart", "purchase", "cancel"]
STAGE_NAMES = {"product": "Lihat produk", "cart": "Masuk keranjang",
               "purchase": "Purchase", "cancel": "Cancel"}
FUNNEL_ROWS = ["Lihat produk", "Masuk keranjang", "Akhir kunjungan"]

# FIXED VALUES: ranking sizes and the label width.
TOP_N = 10
TOP_PAIRS = 15
TOP_IMPACT = 10
LABEL_WIDTH = 38

# FIXED VALUES: time grains (daily, weekly on Mondays, monthly on the first).
GRAINS = {"Harian": "day", "Mingguan": "week", "Bulanan": "month"}
DEFAULT_GRAIN = "Bulanan"

# FIXED VALUES: score metrics — column, display scale, higher-is-better.
METRICS = {
    "R²": ("r2", 1, True),
    "RMSE": ("rmse", 1, False),
    "MAPE": ("mape", 100, False),
}
DEFAULT_METRIC = "RMSE"

# FIXED VALUES: ranking names of the rank-tie table.
RANKINGS = ["unit terjual", "profit"]

# Mart table names; the rollup is ours, the others equal the dashboard's (FIXED VALUES).
ROLLUP_TABLE = "sales_rollup"
# exact product sets by month, as bitmaps (see ``marts.build_product_bits``)
PRODUCT_BITS_TABLE = "sales_products"
MART_TABLES = ["fact_sales", "fact_orders", "fact_events", "dim_products", ROLLUP_TABLE, PRODUCT_BITS_TABLE]
FACTS_WITH_DATE = ["fact_sales", "fact_orders", "fact_events"]
GRAPH_TABLE = "category_pairs"
FORECAST_TABLES = ["skor", "prediksi", "dampak", "meta"]

# FIXED VALUES: names of the two trend series.
TREND_SERIES = {"gross_sales": "Gross sales", "profit": "Profit"}

# FIXED VALUES: series names of the forecast page.
SERIES_ACTUAL = "Laba sebenarnya"
SERIES_PREDICTED_PREFIX = "Tebakan "

# FIXED VALUES: texts after or between numbers and names.
SESSIONS_SUFFIX = " Sesi"
CO_PURCHASE_SUFFIX = " co-purchase"
ORDER_SUFFIX = " order"
PAIR_JOINER = "  +  "

# nodes a side of a drawn tile of the co-purchase matrix (ours)
TILE_SIZE = 64

# FIXED VALUES: KPI card titles, in display order.
KPI_CARDS = ["Gross Sales", "Profit", "Order", "Cancel Rate", "Produk Terjual"]
