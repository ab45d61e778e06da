"""Content-moderation and corpus operators as Spark DataFrames."""
