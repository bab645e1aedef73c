"""End-to-end queries composed from the operators, and the query registry."""
