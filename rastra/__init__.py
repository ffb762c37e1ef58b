"""rastra: gridded and tabular geodata as Spark DataFrames."""
