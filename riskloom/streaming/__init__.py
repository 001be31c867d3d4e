"""Stateless operators applied to a streaming DataFrame."""
