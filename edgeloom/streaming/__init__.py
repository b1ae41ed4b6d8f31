"""Edges that arrive as a stream."""
