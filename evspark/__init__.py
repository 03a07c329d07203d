"""evspark: correlate, order, score, tag and search evidence records with Spark DataFrames."""
