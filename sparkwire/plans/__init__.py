"""Whole queries: the batch flows, and the queries over the driver's tables with their SQL."""
