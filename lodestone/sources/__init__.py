"""Readers of landed records."""
