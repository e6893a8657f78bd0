"""End-to-end plans and the query registry over the driver tables."""
