"""Stage operators: DataFrame(s) -> DataFrame(s)."""
