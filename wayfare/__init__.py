"""wayfare: Spark-native public-transport analytics.

Ticket-level and trip-level fact tables are cleaned and enriched with
DataFrame expressions, filtered by composable predicates and reduced to
KPIs, rankings, calendar trends and statistics.  Every operator is a lazy
``DataFrame -> DataFrame`` function built on ``pyspark.sql.functions``; no
Python UDF runs in any plan.
"""

__version__ = "0.1.0"
