"""Relational operators over canonical notices and the tables derived from them."""
