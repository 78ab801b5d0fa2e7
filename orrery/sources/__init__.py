"""Readers of exports, feeds and third-party responses."""
