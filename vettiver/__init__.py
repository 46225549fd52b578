"""vettiver: hybrid retrieval and grounded-answer analytics written for Spark DataFrames."""
