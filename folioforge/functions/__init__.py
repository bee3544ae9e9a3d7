"""Column functions and Arrow functions on text, names and identifiers."""
