"""Compositions of operators: ingest to master, master to features, features to scores."""
