"""Operators for text-corpus pipelines. Nothing outside this subpackage imports it."""
