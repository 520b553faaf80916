"""quern: inverted indexes as DataFrames, built, compressed and queried with Spark."""
