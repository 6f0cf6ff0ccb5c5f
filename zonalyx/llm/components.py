"""Connected components, as everywhere in the library."""

from zonalyx.operators.components import MAX_ROUNDS, components

__all__ = ["MAX_ROUNDS", "components"]
