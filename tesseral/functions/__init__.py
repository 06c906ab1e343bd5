"""The condition and expression language."""
