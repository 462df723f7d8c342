"""docaudit: rule-based auditing of document corpora as Spark DataFrame transforms."""
