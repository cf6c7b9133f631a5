"""DataFrame -> DataFrame operators. Every operator takes its column names as
parameters with card-table defaults, so the same code runs on any table."""
