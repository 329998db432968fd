"""Plain-SQL definitions of the marts, for the DuckDB cross-check.

Each mart is one common table expression over the source tables, written
independently of the Spark code but to the same mapping (see
``warung.sources.marts``).  ``with_marts`` prefixes a query with the CTEs it
names, in dependency order.
"""

from __future__ import annotations

CATEGORY = "CASE WHEN p.p_partkey IS NOT NULL THEN concat_ws(' ', p.p_type, split_part(p.p_name, ' ', -1)) END"

STATUS = """CASE WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'F' THEN 'Returned'
                 WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'P' THEN 'Cancelled'
                 WHEN o.o_orderstatus = 'F' THEN 'Complete'
                 WHEN o.o_orderstatus = 'O' THEN 'Shipped'
                 WHEN o.o_orderstatus = 'P' THEN 'Processing' END"""

CTES = {
    "fact_sales": f"""fact_sales AS (
  SELECT CAST(CAST(o.o_orderdate AS DATE) AS TIMESTAMP) AS tanggal,
         {CATEGORY} AS category,
         {STATUS} AS status,
         l.l_partkey AS product_id,
         CAST(SUM(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS items,
         SUM(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS gross_sales,
         SUM(CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(12,2)))
                  - CAST(CAST(l.l_quantity AS BIGINT) AS DECIMAL(12,2)) * CAST(p.p_retailprice AS DECIMAL(12,2))
                  AS DECIMAL(18,4))) AS profit
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2, 3, 4)""",
    "fact_orders": f"""fact_orders AS (
  SELECT CAST(CAST(o.o_orderdate AS DATE) AS TIMESTAMP) AS tanggal, {STATUS} AS status,
         COUNT(*) AS orders
  FROM orders o GROUP BY 1, 2)""",
    "fact_events": """fact_events AS (
  SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS tanggal,
         CASE event_type WHEN 'view' THEN 'product' WHEN 'click' THEN 'cart'
                         WHEN 'error' THEN 'cancel' ELSE event_type END AS event_type,
         (['Email', 'Adwords', 'YouTube', 'Facebook', 'Organic'])[CAST(((user_id % 5) + 5) % 5 AS INTEGER) + 1]
           AS traffic_source,
         COUNT(DISTINCT user_id) AS sessions
  FROM events GROUP BY 1, 2, 3)""",
    "dim_products": f"""dim_products AS (
  SELECT p.p_partkey AS product_id, p.p_name AS product_name, p.p_brand AS brand,
         {CATEGORY} AS category
  FROM part p)""",
    "order_categories": f"""order_categories AS (
  SELECT DISTINCT l.l_orderkey AS order_key, {CATEGORY} AS category
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""",
    "category_pairs": """category_pairs AS (
  SELECT a.category AS kat1, b.category AS kat2, COUNT(*) AS n
  FROM order_categories a JOIN order_categories b
    ON a.order_key = b.order_key AND a.category < b.category
  GROUP BY 1, 2)""",
    "bounds": """bounds AS (SELECT MIN(tanggal) AS lo, MAX(tanggal) AS hi FROM fact_sales)""",
}

DEPENDS = {"category_pairs": ["order_categories"], "bounds": ["fact_sales"]}


def with_marts(names: list[str], body: str, extra: list[str] | None = None) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [CTES[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" + body
