"""Analytics for agent-tool security data as Spark DataFrame, SQL and Structured Streaming jobs."""
