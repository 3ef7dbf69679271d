"""streaming of the field-matching engine."""
