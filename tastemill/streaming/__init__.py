"""Structured Streaming ingests."""
