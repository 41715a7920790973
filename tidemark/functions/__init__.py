"""Column expressions: normalisers, validation rules, calendar parts."""
