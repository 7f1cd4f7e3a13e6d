"""Connected components, as the rest of the library finds them."""

from ..operators.rounds import components

__all__ = ["components"]
