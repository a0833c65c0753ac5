"""Memory of Python workers, as the corpus operators import it."""

from lodestone.workers import frugal, give_back

__all__ = ["frugal", "give_back"]
