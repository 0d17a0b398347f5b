"""Readers of stored tables and payloads."""
