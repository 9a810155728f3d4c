"""Readers and writers for logs, contracts, trials, cells and reports."""
