"""Knowledge-hypergraph retrieval and tabular decision support on Spark DataFrames."""
