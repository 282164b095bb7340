"""sessionweave: a Spark-first engine for behavioural event-sequence analytics."""
