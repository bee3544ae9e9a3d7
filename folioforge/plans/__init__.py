"""Storage of intermediate tables and whole query plans."""
