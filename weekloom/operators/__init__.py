"""Panel operators. Each takes DataFrames and returns a DataFrame; none runs an action."""
