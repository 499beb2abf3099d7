"""Text as markup writes it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named characters.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
_ENTITY = r"&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|" + "|".join(NAMED) + ");"


def _character(code: Column) -> Column:
    """The character of a code point; of what is none, the replacement character."""
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(real, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")


def _decoded(entity: Column) -> Column:
    name = F.substring(entity, F.lit(2), F.length(entity) - 2)
    value = F.when(name.startswith("#x") | name.startswith("#X"), F.conv(F.substring(name, 3, 8), 16, 10)).when(
        name.startswith("#"), F.substring(name, 2, 9)
    )
    named = F.element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), name)
    return F.when(value.isNotNull(), _character(value.cast("bigint"))).otherwise(named)


def decode_entities(text: Column) -> Column:
    """Named and numeric characters decoded, once and from left to right."""
    pieces, found = F.split(text, _ENTITY, -1), F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    joined = F.array_join(F.zip_with(pieces, found, lambda p, e: F.concat(p, F.coalesce(_decoded(e), F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)
