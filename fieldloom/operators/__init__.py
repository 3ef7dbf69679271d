"""operators of the field-matching engine."""
