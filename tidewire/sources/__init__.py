"""Readers: feeds, JSON payloads, tables."""
