"""Structured Streaming jobs over growing logs."""
