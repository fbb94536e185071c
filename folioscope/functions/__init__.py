"""Column expressions: text cleaning, key derivation, payload parsing."""
