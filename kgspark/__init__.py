"""kgspark: curation, graph and corpus analytics operators on Spark DataFrames."""
