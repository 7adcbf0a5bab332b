"""Connected components: the library's general operator."""

from __future__ import annotations

from ledgerspark.operators.components import components, rounds

__all__ = ["components", "rounds"]
