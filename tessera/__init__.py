"""Document segmentation, translation memory and corpus preparation on Spark DataFrames."""
