"""Analytics over typed, confidence-weighted property graphs, declared as Spark DataFrames."""
