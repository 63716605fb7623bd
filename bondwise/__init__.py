"""Bondwise: site-graph census and ensemble analytics as Spark jobs."""
