"""govlake: governed, trustworthy data jobs written as Spark DataFrame, SQL and Structured Streaming code."""
