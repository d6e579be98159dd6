"""The driver's queries: each operator on the given tables, and its SQL twin."""
