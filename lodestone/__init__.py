"""Document preparation, retrieval, evaluation and trace analytics as Spark DataFrames."""
