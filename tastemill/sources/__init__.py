"""Readers, sinks and the canonical tables."""
