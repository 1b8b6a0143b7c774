"""Readers of stored tables, file listings and indexes."""
