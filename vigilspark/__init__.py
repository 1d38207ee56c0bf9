"""Behavioural log analytics and corpus preparation as Spark jobs."""
