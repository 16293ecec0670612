"""weftline: evidence tables, matrices, graphs and record hygiene on Spark DataFrames."""
