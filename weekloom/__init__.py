"""weekloom: weekly entity-by-time panels, features and forecast scoring on Spark."""

from weekloom.keys import Keys

__all__ = ["Keys"]
