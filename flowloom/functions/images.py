"""Byte images: five packets of 80 header and 240 payload bytes as 40 x 40."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.stats import bound
from flowloom.profiles import IMAGE_HEADER, IMAGE_PACKETS, IMAGE_PAYLOAD, IMAGE_SIDE

ZERO = b"\x00"
BLOCK = IMAGE_HEADER + IMAGE_PAYLOAD
PATCH = 2


def _fit_bytes(data: Column, size: int) -> Column:
    return F.rpad(F.substring(data, 1, size), size, F.lit(ZERO))


def _fit_hex(text: Column, size: int) -> Column:
    return F.rpad(text, 2 * size, "0")


def packet_block(ip_header: Column, l4_header: Column, payload: Column) -> Column:
    """320 bytes: both headers in the first 80, payload in the rest, zero-padded."""
    return F.concat(
        _fit_bytes(F.concat(ip_header, l4_header), IMAGE_HEADER), _fit_bytes(payload, IMAGE_PAYLOAD)
    )


def packet_block_hex(header_hex: Column, payload_hex: Column) -> Column:
    return F.concat(_fit_hex(header_hex, IMAGE_HEADER), _fit_hex(payload_hex, IMAGE_PAYLOAD))


def stripped_block_hex(ip_hex: Column, payload_hex: Column) -> Column:
    """Block from the hex of a whole IP packet, with the payload text cut out.

    The removal is a text replace, so a payload that also occurs across header
    bytes removes those too. Kept for compatibility; `packet_block_hex` is exact.
    """
    header = F.when(payload_hex == "", ip_hex).otherwise(F.replace(ip_hex, payload_hex, F.lit("")))
    return packet_block_hex(header, payload_hex)


def frame_block_hex(packet_hex: Column) -> Column:
    """320 bytes of hex from one undivided packet text."""
    return _fit_hex(packet_hex, BLOCK)


def image_from_blocks(blocks: Column, size: int = BLOCK) -> Column:
    """Up to five ordered binary blocks as one image; missing ones are zero."""
    empty = F.lit(ZERO * size)
    return F.concat(*[F.coalesce(F.get(blocks, i), empty) for i in range(IMAGE_PACKETS)])


def image_from_blocks_hex(blocks: Column, size: int = BLOCK) -> Column:
    empty = F.lit("00" * size)
    return F.concat(*[F.coalesce(F.get(blocks, i), empty) for i in range(IMAGE_PACKETS)])


def pixels(image: Column) -> Column:
    """Byte values of a binary image, row-major.

    In ISO-8859-1 every byte is the character with the same number, so the image is
    decoded once and its characters are numbered.
    """
    characters = F.split(F.decode(image, "ISO-8859-1"), "")
    return F.when(F.octet_length(image) == 0, F.array().cast("array<int>")).otherwise(F.transform(characters, F.ascii))


def scaled_pixels(image: Column) -> Column:
    return F.transform(pixels(image), lambda v: v / F.lit(255.0))


def _patch_count() -> int:
    return (IMAGE_SIDE // PATCH) ** 2


def patches(image: Column) -> Column:
    """400 binary patches of 2 x 2 bytes, left to right, top to bottom.

    The eight rows of a packet hold whole patch rows, so row-major patch order is
    also packet-major order.
    """
    per_row = IMAGE_SIDE // PATCH

    def patch(data: Column, i: Column) -> Column:
        top = F.floor(i / per_row) * (PATCH * IMAGE_SIDE) + (i % per_row) * PATCH
        start = (top + 1).cast("int")
        return F.concat(
            F.substring(data, start, F.lit(PATCH)),
            F.substring(data, start + IMAGE_SIDE, F.lit(PATCH)),
        )

    places = F.sequence(F.lit(0), F.lit(_patch_count() - 1))
    return bound(image, lambda data: F.transform(places, lambda i: patch(data, i)))


def image_from_patches(patch_array: Column) -> Column:
    """Inverse of `patches`."""
    per_row = IMAGE_SIDE // PATCH

    def row(grid: Column, r: Column) -> Column:
        cells = F.slice(grid, (F.floor(r / PATCH) * per_row + 1).cast("int"), F.lit(per_row))
        start = ((r % PATCH) * PATCH + 1).cast("int")
        return F.array_join(
            F.transform(cells, lambda c: F.hex(F.substring(c, start, F.lit(PATCH)))), ""
        )

    rows = F.sequence(F.lit(0), F.lit(IMAGE_SIDE - 1))
    text = bound(
        patch_array, lambda grid: F.array_join(F.transform(rows, lambda r: row(grid, r)), "")
    )
    return F.unhex(text)


def kept_patches(mask_ratio: float) -> int:
    """Patches left visible: the floor of a floating product, so 39 at ratio 0.9."""
    return int(_patch_count() * (1 - mask_ratio))


def shuffled_patch_ids(sample_id: Column, seed: int) -> Column:
    """Patch positions in a reproducible random order (one sort inside the row)."""

    def keyed(prefix: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(_patch_count() - 1))
        return F.transform(
            places,
            lambda i: F.struct(
                F.md5(F.concat_ws(":", prefix, i.cast("string"))).alias("k"), i.alias("v")
            ),
        )

    prefix = F.concat_ws(":", F.lit(str(seed)), sample_id.cast("string"))
    return F.transform(F.sort_array(bound(prefix, keyed)), lambda s: s["v"])


def restore_order(shuffled: Column) -> Column:
    """Position of every patch inside the shuffled order."""
    placed = F.transform(shuffled, lambda p, r: F.struct(p.alias("p"), r.alias("v")))
    return F.transform(F.sort_array(placed), lambda s: s["v"])


def patch_mask(restore: Column, mask_ratio: float) -> Column:
    """0 for a visible patch, 1 for a masked one."""
    keep = kept_patches(mask_ratio)
    return F.transform(restore, lambda r: F.when(r < keep, F.lit(0)).otherwise(F.lit(1)))


def visible_patches(patch_array: Column, shuffled: Column, mask_ratio: float) -> Column:
    keep = kept_patches(mask_ratio)
    return bound(
        patch_array,
        lambda grid: F.transform(F.slice(shuffled, 1, keep), lambda i: F.get(grid, i)),
    )
