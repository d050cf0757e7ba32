"""Registered queries: each operator bound to the given tables, with equivalent SQL where SQL can say it."""
