"""Market-tape and trade-ledger analytics on Spark."""
