"""plans of the field-matching engine."""
