"""Column expressions: text rules, box arithmetic, canonical hashing, JSON decoding."""
