"""sources of the field-matching engine."""
