"""DataFrame operators, one module an area; nothing here collects a table."""
