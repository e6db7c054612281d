"""Document analytics on Spark: extraction gates, redaction, timelines, facts, ranking and sessions."""
