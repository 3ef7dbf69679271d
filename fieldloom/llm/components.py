"""Connected components, which the core has."""

from ..operators.components import components  # noqa: F401
