"""Rule data, views on the sample tables, and the registry of queries."""
