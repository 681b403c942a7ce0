"""Column functions: calendar arithmetic and time differences."""
