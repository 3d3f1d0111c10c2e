"""Connected components, as the rest of the library has them."""

from oppflow.operators.graph import Forest, components

__all__ = ["Forest", "components"]
