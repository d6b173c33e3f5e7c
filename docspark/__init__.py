"""docspark: a PySpark-native engine for typed, quality-gated document collections."""

from docspark.plans.parse import parse, parse_batch, parse_contents, render_markdown
from docspark.schema import ELEMENT_TYPES, EnrichmentConfig, record_types

__all__ = ["ELEMENT_TYPES", "EnrichmentConfig", "parse", "parse_batch", "parse_contents", "record_types", "render_markdown"]
