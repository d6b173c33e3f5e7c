"""The data model: element types, configuration, and the schemas of the engine's tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

SCHEMA_VERSION = "1.0"

# The members of the element type.
ELEMENT_TYPES = (
    "text", "heading", "list_item", "image", "table", "equation", "caption", "header", "footer", "page_number", "unknown",
)
FURNITURE = ("header", "footer", "page_number")
TEXT_TYPES = ("text", "heading", "list_item")

# Block type to element type, layout label to element type, element type to benchmark type.
BLOCK_TYPES = {
    "text": "text", "title": "heading", "list": "list_item", "list_item": "list_item", "table": "table",
    "interline_equation": "equation", "equation": "equation", "image": "image", "figure": "image",
    "figure_caption": "caption", "table_caption": "caption", "header": "header", "footer": "footer",
    "page_number": "page_number",
}
LABEL_TYPES = {"paragraph": "text", "section_header": "heading", "formula": "equation", "list_item": "list_item"}
BENCH_TYPES = {"text": "paragraph", "unknown": "paragraph", "image": "figure"} | {
    t: t for t in ELEMENT_TYPES if t not in ("text", "unknown", "image")
}

# Accepted file suffixes.
BASE_SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "webp")
DOCLING_SUFFIXES = ("docx", "doc", "html", "htm", "xhtml")

ELEMENT = (
    "struct<element_id:string,type:string,text:string,description:string,bbox:array<double>,page_idx:int,"
    "is_enriched:boolean,image_bytes:binary>"
)
PAGE = "struct<page_idx:int,quality_decision:string,element_count:int,vlm_used:boolean>"
WARNING = "struct<page_idx:int,code:string,message:string>"
CONFIG = (
    "struct<enabled:boolean,image:boolean,table:boolean,equation:boolean,context_window:int,max_context_tokens:int,"
    "vlm_backend:string,parser:string,do_ocr:boolean,table_mode:string,do_table_structure:boolean,docling_artifacts_path:string>"
)
OUTPUT = (
    f"schema_version string, file_path string, file_sha256 string, page_count int, pages array<{PAGE}>, "
    f"elements array<{ELEMENT}>, warnings array<{WARNING}>, enrichment_config {CONFIG}"
)


@dataclass(frozen=True)
class EnrichmentConfig:
    """Options of a parse.  Values out of bounds raise ``ValueError`` when the object is made."""

    enabled: bool = False
    image: bool = True
    table: bool = True
    equation: bool = True
    context_window: int = 3
    max_context_tokens: int = 512
    vlm_backend: str = "openai_compatible"
    parser: str = "mineru"
    do_ocr: bool = True
    table_mode: str = "fast"
    do_table_structure: bool = True
    docling_artifacts_path: str | None = None

    def __post_init__(self) -> None:
        for name, low, high in (("context_window", 0, 20), ("max_context_tokens", 64, 4096)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
                raise ValueError(f"{name} must be an integer in [{low}, {high}], not {value!r}")
        for name, allowed in (
            ("vlm_backend", ("openai_compatible", "bedrock")), ("parser", ("mineru", "docling")), ("table_mode", ("fast", "accurate")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")

    @property
    def suffixes(self) -> tuple[str, ...]:
        """File suffixes that this configuration accepts (lower case, no dot)."""
        return BASE_SUFFIXES + (DOCLING_SUFFIXES if self.parser == "docling" else ())

    @property
    def modalities(self) -> tuple[str, ...]:
        return tuple(m for m in ("image", "table", "equation") if getattr(self, m)) if self.enabled else ()

    def fingerprint(self) -> str:
        """What tells cached results of one configuration from another's."""
        return ";".join(f"{f.name}={getattr(self, f.name)!r}" for f in fields(self))

    def as_column(self):
        from pyspark.sql import functions as F

        return F.struct(*[F.lit(getattr(self, f.name)).alias(f.name) for f in fields(self)]).cast(CONFIG)


def record_types() -> dict[str, str]:
    """DDL of the record types, by the names of the public API."""
    return {"ElementRecord": ELEMENT, "PageRecord": PAGE, "WarningRecord": WARNING, "ParserOutput": f"struct<{OUTPUT}>"}
