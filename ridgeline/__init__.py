"""Cross-sectional panel analytics and corpus preparation on Spark DataFrames."""
