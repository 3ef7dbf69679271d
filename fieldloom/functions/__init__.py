"""functions of the field-matching engine."""
