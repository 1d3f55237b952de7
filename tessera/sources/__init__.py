"""Landed payloads of data vendors as tables."""
