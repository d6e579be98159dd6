"""Column-level building blocks: rule packs, text expressions, numeric helpers."""
