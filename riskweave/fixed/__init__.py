"""Word lists, lookup tables, constants and patterns that results depend on."""
