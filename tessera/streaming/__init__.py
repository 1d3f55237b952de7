"""Streams of orders and portfolio values."""
