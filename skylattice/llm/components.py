"""Connected components and joins with groups for the operators of this subpackage: the library's own."""

from skylattice.operators.graph import connected_components, with_groups

__all__ = ["connected_components", "with_groups"]
