"""Analytics over corpora of semi-structured documents, as Spark DataFrames."""
