"""Column builders: months, buckets and score transforms."""
