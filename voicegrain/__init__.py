"""Profile, prompt and reply-table operators for Spark DataFrames."""
