"""Aggregate queries over joins, answered from summaries by join key; built from Spark's own operators only."""
