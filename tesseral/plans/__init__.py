"""Plan introspection and the registry of queries."""
