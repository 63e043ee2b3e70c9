"""clickwise — Spark-native click-stream analytics.

Raw click requests (batch tables or streams) are enriched, anonymised and
de-duplicated, aggregated in tumbling event-time windows, stored as a
versioned minute log with latest-wins reads, rolled up by hour and day and
answered as advertiser reports.  Everything is DataFrame / Spark SQL /
Structured Streaming; no custom Catalyst rules and no Python UDFs in the core.
"""

__version__ = "0.1.0"
