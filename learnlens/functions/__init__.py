"""Column expressions (levels, risk, rounding, weeks, keyword, formats)."""
