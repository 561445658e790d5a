"""Readers, writers and keyed table storage."""
