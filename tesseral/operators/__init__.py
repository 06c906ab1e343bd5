"""Row, selection, mutation and array operators."""
