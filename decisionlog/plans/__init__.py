"""End-to-end jobs, and the queries that bind the operators to the benchmark tables."""
