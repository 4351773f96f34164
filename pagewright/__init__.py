"""Web-page content analytics on Spark DataFrames."""
