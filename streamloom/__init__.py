"""Change-stream analytics on Spark: changelogs, transactions, backfills and reports as DataFrame operators."""
