"""warung — retail dashboard analytics as Spark DataFrame jobs.

Subpackages:

* ``sources``   — source-table readers and the mart builders / materializer
* ``functions`` — Column functions (time buckets, missing values, text)
* ``operators`` — filters and the page operators (sales, visitors, products,
  graph, forecast), each ``DataFrame -> DataFrame``
* ``plans``     — the query registry (with its DuckDB cross-check SQL) and the
  parameterized dashboard pages
* ``streaming`` — incremental build of the visitor mart

Start with ``warung.plans.catalog.REGISTRY`` or ``warung.plans.pages``.
"""

__version__ = "0.1.0"
