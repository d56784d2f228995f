"""Readers, raw-to-canonical projections and the binding of the supplied tables."""
