"""Names, types and the choice of access paths."""
