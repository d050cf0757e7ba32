"""Column expressions: pure functions from Column to Column, built-ins only."""
