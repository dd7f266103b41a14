"""Set-level operators: joins, aggregations, windows, statistics, checks."""
