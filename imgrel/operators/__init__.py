"""Set-level work: validation, pixel tables, caches, limits, metrics."""
