"""Micro-batch ingestion with carried state, online drift and sessions."""
