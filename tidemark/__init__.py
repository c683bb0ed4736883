"""Storage-trend analytics on Spark: plain DataFrame -> DataFrame operators."""
