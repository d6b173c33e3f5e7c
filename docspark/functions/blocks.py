"""Fields of layout blocks, which are VARIANT values of any shape."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.schema import BLOCK_TYPES, LABEL_TYPES


def _looked_up(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*values.items())])
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit(""))), F.lit("unknown"))


def block_type(raw: Column) -> Column:
    """The element type of a block's ``type``; unknown for any other value, null too.  Case matters."""
    return _looked_up(BLOCK_TYPES, raw)


def label_type(label: Column) -> Column:
    """The element type of a layout label."""
    return _looked_up(LABEL_TYPES, label)


def field(block: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(block, f"$.{name}", kind)


def kind_of(block: Column, name: str | None = None) -> Column:
    """STRING, BIGINT, DECIMAL(..), BOOLEAN, OBJECT<..>, ARRAY<..> or VOID; null where the field is missing."""
    return F.schema_of_variant(field(block, name, "variant") if name else block)


def is_object(block: Column) -> Column:
    return F.coalesce(kind_of(block).startswith("OBJECT"), F.lit(False))


def truthy_text(block: Column, name: str) -> Column:
    """A field as text, null where Python calls it false (missing, null, empty, zero, false)."""
    kind, text = kind_of(block, name), field(block, name)
    number = F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")
    return (
        F.when(kind == "BOOLEAN", F.when(text == "true", "True"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(number != 0, text))
        .when(kind.rlike("^(OBJECT|ARRAY)"), F.when(~text.isin("{}", "[]"), text))
        .otherwise(F.nullif(text, F.lit("")))
    )


def first_text(block: Column, *names: str) -> Column:
    """The first of the fields that is not false, as text; empty if none."""
    return F.coalesce(*[truthy_text(block, n) for n in names], F.lit(""))


def aliased(block: Column, name: str) -> Column:
    """``image_caption`` or ``image_footnote``: the short alias wins over the full name."""
    return F.coalesce(field(block, name.replace("image_", "img_"), "variant"), field(block, name, "variant"))


def bbox(block: Column, name: str = "bbox") -> Column:
    """An array field as doubles; empty where it is no array.  A member that is no number stays null."""
    kind = kind_of(block, name)
    return F.when(kind.startswith("ARRAY"), field(block, name, "array<double>")).otherwise(F.array().cast("array<double>"))


def bbox_is_bad(box: Column) -> Column:
    return F.coalesce(F.exists(box, lambda x: x.isNull()), F.lit(True))
