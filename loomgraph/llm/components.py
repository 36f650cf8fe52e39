"""Connected components, which the graph operators have too."""

from ..operators.connected import components  # noqa: F401
