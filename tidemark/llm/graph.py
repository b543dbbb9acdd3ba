"""Connected components, their tables among those that the operators delete when done."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.llm.common import remove, written_at
from tidemark.operators import graph


def component_roots(edges: DataFrame) -> DataFrame:
    """As ``tidemark.operators.graph.component_roots``."""
    return graph.component_roots(edges, written_at, remove)
