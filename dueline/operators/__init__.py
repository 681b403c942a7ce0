"""Event-log operators: features, filters, labels, cuts, encoding, splits."""
