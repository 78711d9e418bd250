"""Column expressions: value semantics, sort keys, vectors, clocks, topics."""
