"""Text-pair duplicate detection on Spark DataFrames."""
