"""Column helpers: derived measures, text folding, scoring rules."""
