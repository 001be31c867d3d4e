"""Readers, canonical schemas, fixtures, manifests and table hand-off."""
