"""The catalogue of queries and the flagship plan."""
