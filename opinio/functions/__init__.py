"""Column expressions: text, dates, vectors, hashing and fixed value lists."""
