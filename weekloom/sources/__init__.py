"""Readers that land raw files in the common schemas, and the sinks."""
