"""Column expressions: null-safe arithmetic, labels and the map projection."""
