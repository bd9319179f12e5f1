"""Column expressions: decay weights, slice numbers and buckets."""
