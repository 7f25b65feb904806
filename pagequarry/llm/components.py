"""Connected components, as in ``pagequarry.operators.components``."""

from pagequarry.operators.components import components  # noqa: F401
