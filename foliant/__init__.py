"""Analytics over a corpus of long filings, on Spark DataFrames."""
