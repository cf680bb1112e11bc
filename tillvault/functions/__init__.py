"""Column expressions: keys, German formats, lookups, calendar parts."""
