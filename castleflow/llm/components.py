"""Connected components of the links between documents."""

from castleflow.operators.stars import components

__all__ = ["components"]
