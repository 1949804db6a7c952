"""Stored tables and what changes them."""
