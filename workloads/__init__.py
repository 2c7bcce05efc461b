"""Registered queries over the TPC-H-like tables and their DuckDB counterparts.

Orders of a nation's customers stand for cases of a district, line items by ship date for the
weather, customers of a nation for its population. Supplier panels (line items by supplier)
exercise a domain of entities that grows with the data.
"""

from workloads import descriptive, feature, forecasts, landed, learned, preparation, scoring

MODULES = (landed, preparation, descriptive, feature, forecasts, scoring, learned)


def all_queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
