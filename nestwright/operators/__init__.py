"""DataFrame forms of the list functions, for lists too long for an expression within one row."""

from nestwright.operators.exploded import explode_combinations, similarity_of_long_lists

__all__ = ["explode_combinations", "similarity_of_long_lists"]
