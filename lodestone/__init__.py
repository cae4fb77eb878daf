"""Lodestone: a versioned evidence index over a corpus, built from Spark DataFrames."""
