"""Binary content: media types and embedded pictures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import let

# Media types by suffix.
MIME_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff",
    "webp": "image/webp", "gif": "image/gif", "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml",
}
MAX_PICTURE = 10 * 1024 * 1024


# Media types by the bytes (in hexadecimal) at places of the head.
SIGNATURES = (
    ("image/jpeg", ((0, "FFD8FF"),)), ("image/png", ((0, "89504E470D0A1A0A"),)), ("image/gif", ((0, "474946383761"),)),
    ("image/gif", ((0, "474946383961"),)), ("image/webp", ((0, "52494646"), (8, "57454250"))),
)


def media_type(content: Column) -> Column:
    """The media type that the first bytes tell; image/png if they tell none."""
    head = F.hex(F.substring(content, 1, 16))
    told = F.lit("image/png")
    for kind, marks in reversed(SIGNATURES):
        fits = [F.substring(head, 2 * at + 1, len(digits)) == digits for at, digits in marks]
        told = F.when(fits[0] if len(fits) == 1 else fits[0] & fits[1], kind).otherwise(told)
    return told


def decoded_picture(uri: Column) -> Column:
    """struct(bytes, too_large) of a data URI (what follows the first comma, or all of it).

    Stray characters are skipped; wrong padding gives null.  Over 10 MiB the bytes are null and ``too_large`` is true.
    """
    comma = F.instr(uri, ",")
    payload = F.regexp_replace(F.when(comma > 0, F.substring(uri, comma + 1, F.length(uri))).otherwise(uri), "[^A-Za-z0-9+/=]", "")
    decoded = let(payload, lambda p: F.when(F.length(p) % 4 == 0, F.try_to_binary(p, F.lit("base64"))))

    def told(raw: Column) -> Column:
        large = F.coalesce(F.octet_length(raw) > MAX_PICTURE, F.lit(False))
        return F.struct(F.when(~large, raw).alias("bytes"), large.alias("too_large"))

    return let(decoded, told)


def mime_type(path: Column) -> Column:
    """The media type that a path's suffix tells."""
    ending = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ending), F.lit("application/octet-stream"))


def number(digits: Column, little: bool = False) -> Column:
    """The whole number in hexadecimal digits of up to seven bytes, least byte first if ``little``; null if there are none."""
    if little:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(2)), F.lit(2)), lambda i: F.substring(digits, i, F.lit(2)))
        digits = F.array_join(F.reverse(pairs), "")
    return F.when(F.length(digits) > 0, F.conv(digits, 16, 10).cast("long"))


def _sized(width: Column, height: Column) -> Column:
    pair = F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))
    return let(pair, lambda p: F.when((p["width"] > 0) & (p["height"] > 0), p))


def _webp_size(h: Column) -> Column:
    """From the digits of the first 32 bytes."""
    at = lambda place, size, little=True: number(F.substring(h, 2 * place + 1, 2 * size), little)
    chunk = F.substring(h, 25, 8)
    return (
        F.when(chunk == "56503858", _sized(at(24, 3) + 1, at(27, 3) + 1))
        .when((chunk == "5650384C") & (F.substring(h, 41, 2) == "2F"), let(at(21, 4), lambda b: _sized(b.bitwiseAND(0x3FFF) + 1, F.shiftright(b, 14).bitwiseAND(0x3FFF) + 1)))
        .when((chunk == "56503820") & (F.substring(h, 47, 6) == "9D012A"), _sized(at(26, 2).bitwiseAND(0x3FFF), at(28, 2).bitwiseAND(0x3FFF)))
    )


def _jpeg_walk(content: Column, steps: Column) -> Column:
    """Segment by segment to the frame header: struct(at, done, size) after at most ``steps``."""
    none = F.lit(None).cast("struct<width:bigint,height:bigint>")
    state_of = lambda at, done, size: F.struct(at.cast("int").alias("at"), F.lit(done).alias("done"), size.alias("size"))

    def step(state: Column, _: Column) -> Column:
        def seen(h: Column) -> Column:
            marker, length = F.substring(h, 3, 2), F.coalesce(number(F.substring(h, 5, 4)), F.lit(0).cast("long"))
            return (
                F.when((F.substring(h, 1, 2) != "FF") | marker.isin("", "00", "D9", "DA"), state_of(state["at"], True, none))
                .when(marker == "FF", state_of(state["at"] + 1, False, none))  # a fill byte
                .when(marker.rlike("^(D[0-8]|01)$"), state_of(state["at"] + 2, False, none))  # a marker alone
                .when(marker.rlike("^C[0-35-79-BD-F]$"), state_of(state["at"], True, _sized(number(F.substring(h, 15, 4)), number(F.substring(h, 11, 4)))))
                .when(length < 2, state_of(state["at"], True, none))
                .otherwise(state_of(state["at"] + length + 2, False, none))
            )

        return F.when(state["done"], state).otherwise(let(F.hex(F.substring(content, state["at"] + 1, F.lit(9))), seen))

    return F.aggregate(F.sequence(F.lit(1), steps), state_of(F.lit(2), False, none), step)


def _jpeg_size(content: Column) -> Column:
    # nearly all frame headers come within some segments; beyond, the rest is walked as far as there may be any
    every = lambda: _jpeg_walk(content, F.greatest(F.lit(1), F.octet_length(content)))["size"]
    return let(_jpeg_walk(content, F.lit(32)), lambda soon: F.when(soon["done"], soon["size"]).otherwise(every()))


def _tiff_size(content: Column, little: bool) -> Column:
    """The width and length entries of the first directory."""
    short, wide, high = ("0300", "0001", "0101") if little else ("0003", "0100", "0101")

    def value(entries: Column, tag: str) -> Column:
        found = F.get(F.filter(entries, lambda e: F.substring(e, 1, 4) == tag), F.lit(0))
        return let(found, lambda e: number(F.when(F.substring(e, 5, 4) == short, F.substring(e, 17, 4)).otherwise(F.substring(e, 17, 8)), little))

    def directory(at: Column) -> Column:
        count = F.coalesce(number(F.hex(F.substring(content, at + 1, F.lit(2))), little), F.lit(0).cast("long")).cast("int")
        digits = let(count, lambda n: F.hex(F.substring(content, at + 3, 12 * n)))
        entries = let(digits, lambda h: F.transform(F.sequence(F.lit(0), F.floor(F.length(h) / 24).cast("int")), lambda i: F.substring(h, 24 * i + 1, F.lit(24))))
        return let(entries, lambda e: _sized(value(e, wide), value(e, high)))

    return let(number(F.hex(F.substring(content, 5, 4)), little).cast("int"), lambda at: F.when(at.isNotNull(), directory(at)))


def picture_size(content: Column) -> Column:
    """struct(width, height) in pixels, as the header of a PNG, GIF, WebP, JPEG or TIFF file tells it; null if none does.

    Column expressions over the bytes: a picture is not decoded, and no Python is needed.
    """

    def told(h: Column) -> Column:
        at = lambda place, size, little: number(F.substring(h, 2 * place + 1, 2 * size), little)
        return (
            F.when(h.startswith("89504E470D0A1A0A"), F.when((F.substring(h, 25, 8) == "49484452") & (F.length(h) >= 48), _sized(at(16, 4, False), at(20, 4, False))))
            .when(h.rlike("^474946383[79]61"), F.when(F.length(h) >= 20, _sized(at(6, 2, True), at(8, 2, True))))
            .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), _webp_size(h))
            .when(h.startswith("FFD8FF"), _jpeg_size(content))
            .when(h.startswith("49492A00"), _tiff_size(content, True))
            .when(h.startswith("4D4D002A"), _tiff_size(content, False))
        )

    return let(F.hex(F.substring(content, 1, 32)), told)
