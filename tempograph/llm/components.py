"""Connected components, from the graph library."""

from ..operators.connectivity import connected_components

__all__ = ["connected_components"]
