"""Composed plans, driver-table views and the query catalogue."""
