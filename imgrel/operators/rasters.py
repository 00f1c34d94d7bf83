"""Rasters as one row an image: ``(image_id, width, height, data)`` with RGBA bytes in ``data``.

A transform works on one image in a task, so nothing is shuffled: images pass
through Arrow batches, and numpy does the arithmetic on the bytes.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import output_size, watermark_fits
from ..functions.media import u
from .rules import crop_error

#: The most pixels of a decoded image, of an output, and of a watermark.
MAX_DECODED, MAX_OUTPUT, MAX_WATERMARK = 100_000_000, 67_108_864, 4_000_000
SCHEMA = {"width": ("int", pa.int32()), "height": ("int", pa.int32()), "data": ("binary", pa.binary())}
CONTENT = {"content": ("binary", pa.binary())}
ERROR = {"error": ("string", pa.string())}
#: Bytes of pixels or files, and rows, in one Arrow batch that goes out.
BATCH_BYTES, BATCH_ROWS = 1 << 26, 500


def _each_row(df: DataFrame, sent: list[str | Column], kept: list[str], one: Callable[[dict], tuple], made: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """The columns ``kept`` of ``df`` and those that ``one`` makes of each row of the columns ``sent``.

    One row at a time becomes Python values, and what is made leaves in small
    batches, so a task's memory does not follow the rows of a batch that comes in.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{c}` {sql}" for c, (sql, _) in made.items()])
    kinds = [kind for _, kind in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, start, out, held = batch.select(kept), 0, [], 0
            for k, values in enumerate(zip(*batch.columns)):
                out.append(one({name: value.as_py() for name, value in zip(batch.schema.names, values)}))
                held += sum(len(x) for x in out[-1] if isinstance(x, bytes))
                if held > BATCH_BYTES or len(out) == BATCH_ROWS or k == batch.num_rows - 1:
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)]
                    yield pa.RecordBatch.from_arrays([*rest.slice(start, len(out)).columns, *columns], [*kept, *made])
                    start, out, held = k + 1, [], 0

    return df.select(*sent).mapInArrow(run, schema)


def _others(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def _quoted(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def _pixels(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 4)


def map_images(df: DataFrame, step: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """``df`` with each image through ``step(pixels, row)``; pixels are ``(height, width, 4)`` bytes.

    ``row`` holds the other columns, which pass through; an image that is null
    stays so.
    """
    others = _others(df, *SCHEMA)

    def one(row: dict) -> tuple:
        pixels = None if row["data"] is None else step(_pixels(row), {c: row[c] for c in others})
        return (None, None, None) if pixels is None else (pixels.shape[1], pixels.shape[0], pixels.tobytes())

    return _each_row(df, [*_quoted(others), *SCHEMA], others, one, SCHEMA)


def from_vectors(df: DataFrame, width: int) -> DataFrame:
    """``vec_id, embedding`` as images: red is the value, green its complement, blue seven times it, dark ones half transparent."""

    def pixel(e: Column) -> Column:
        v = F.least(F.greatest(F.floor((e.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255))
        return F.hex(v * (1 << 24) + (255 - v) * (1 << 16) + v * 7 % 256 * 256 + F.when(v < 30, 128).otherwise(255))

    text = F.array_join(F.transform("embedding", lambda e: F.lpad(pixel(e), 8, "0")), "")
    return df.select(
        F.col("vec_id").alias("image_id"), F.lit(width).alias("width"), F.floor(F.size("embedding") / width).cast("int").alias("height"),
        F.unhex(text).alias("data"),
    )


def oriented(pixels: np.ndarray, tag: int) -> np.ndarray:
    """By an EXIF orientation of 2 to 8; any other leaves the image.  5 and 7 flip left to right, then turn by 90 and 270 degrees clockwise."""
    turns = {3: 2, 5: 3, 6: 3, 7: 1, 8: 1}.get(tag, 0)
    pixels = pixels[:, ::-1] if tag in (2, 5, 7) else pixels[::-1] if tag == 4 else pixels
    return np.ascontiguousarray(np.rot90(pixels, turns))


def rotated(pixels: np.ndarray, degrees: int) -> np.ndarray:
    """Clockwise by a multiple of 90."""
    return np.ascontiguousarray(np.rot90(pixels, -degrees // 90))


def cropped(pixels: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return pixels[y : y + h, x : x + w]


def lanczos(x: np.ndarray, a: int = 3) -> np.ndarray:
    return np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)


@lru_cache(maxsize=256)
def resize_matrix(source: int, target: int, a: int = 3) -> np.ndarray:
    """``(target, source)`` weights along one axis; each row sums to 1."""
    ratio = source / target
    scale = max(1.0, ratio)
    centre = (np.arange(target) + 0.5)[:, None] * ratio
    weights = lanczos((np.arange(source)[None] + 0.5 - centre) / scale, a)
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=256)
def blur_matrix(size: int, sigma: float) -> np.ndarray:
    """Gaussian weights along one axis, cut off at two sigma and the edge."""
    away = np.arange(size)[None] - np.arange(size)[:, None]
    weights = np.where(np.abs(away) <= max(1, math.ceil(2 * sigma)), np.exp(-np.square(away) / (2 * sigma * sigma)), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def _weighted(pixels: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sums along both axes, halves rounded up and clamped to bytes."""
    out = np.einsum("ty,yxc->txc", rows, np.einsum("sx,yxc->ysc", columns, pixels.astype(np.float64), optimize=True), optimize=True)
    return np.clip(np.floor(np.round(out, 6) + 0.5), 0, 255).astype(np.uint8)


def resized(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """Lanczos; an image that has the size stays as it is."""
    height, width = pixels.shape[:2]
    return pixels if (w, h) == (width, height) else _weighted(pixels, resize_matrix(height, h), resize_matrix(width, w))


def blurred(pixels: np.ndarray, sigma: float) -> np.ndarray:
    height, width = pixels.shape[:2]
    return _weighted(pixels, blur_matrix(height, sigma), blur_matrix(width, sigma))


def sharpened(pixels: np.ndarray, sigma: float, threshold: int = 1) -> np.ndarray:
    """Add what a blur takes away where that is more than the threshold."""
    old, soft = pixels.astype(np.int16), blurred(pixels, sigma).astype(np.int16)
    return np.where(np.abs(old - soft) > threshold, np.clip(2 * old - soft, 0, 255), old).astype(np.uint8)


def place(outer: tuple[int, int], inner: tuple[int, int], position: str, margin: int = 0) -> tuple[int, int]:
    """Offset of content of a size in a container; a margin counts on the sides that the position names."""

    def along(free: int, low: str, high: str) -> int:
        free = max(free, 0)
        return margin if low in position.split("-") else max(free - margin, 0) if high in position.split("-") else free // 2

    return along(outer[0] - inner[0], "left", "right"), along(outer[1] - inner[1], "top", "bottom")


def over(base: np.ndarray, top: np.ndarray, x: int, y: int) -> np.ndarray:
    """``top`` over ``base``, alpha included; parts outside are cut off.  Colours are weighted by alpha and rounded down."""
    out = base.copy()
    part = out[y : y + top.shape[0], x : x + top.shape[1]].astype(np.float64)
    top = top[: part.shape[0], : part.shape[1]].astype(np.float64)
    a, b = top[..., 3:] / 255, part[..., 3:] / 255
    alpha = a + b * (1 - a)
    colour = np.divide(top[..., :3] * a + part[..., :3] * b * (1 - a), alpha, out=np.zeros_like(part[..., :3]), where=alpha > 0)
    mixed = np.concatenate([colour, alpha * 255], axis=2)
    out[y : y + part.shape[0], x : x + part.shape[1]] = np.floor(np.round(mixed, 6)).astype(np.uint8)
    return out


def padded(pixels: np.ndarray, w: int, h: int, position: str, background: tuple[int, int, int, int]) -> np.ndarray:
    """The image over a box of the background."""
    box = np.broadcast_to(np.array(background, np.uint8), (h, w, 4))
    return over(box, pixels, *place((w, h), pixels.shape[1::-1], position))


def fitted(pixels: np.ndarray, w: int, h: int, fit: str, position: str, background: tuple[int, int, int, int]) -> np.ndarray:
    """``fill`` stretches; ``contain`` and ``inside`` pad, the latter without enlarging; ``cover`` cuts off what exceeds."""
    half_up = lambda x: max(1, math.floor(x + 0.5))
    height, width = pixels.shape[:2]
    if fit == "fill":
        return resized(pixels, w, h)
    if fit == "cover":
        ratio = max(w / width, h / height)
        big = resized(pixels, max(1, math.ceil(width * ratio)), max(1, math.ceil(height * ratio)))
        return cropped(big, *place(big.shape[1::-1], (w, h), position), w, h)
    if fit == "contain" or width > w or height > h:
        ratio = min(w / width, h / height)
        pixels = resized(pixels, half_up(width * ratio), half_up(height * ratio))
    return padded(pixels, w, h, position, background)


def marked(pixels: np.ndarray, mark: np.ndarray, position: str, opacity: int, margin: int) -> np.ndarray:
    """A watermark over an image, its alpha times the opacity in hundredths, rounded down."""
    mark = mark.copy()
    mark[..., 3] = mark[..., 3].astype(np.int64) * opacity // 100
    return over(pixels, mark, *place(pixels.shape[1::-1], mark.shape[1::-1], position, margin))


def is_transparent(data: Column) -> Column:
    """Whether a pixel's alpha is not full."""
    alphas = F.transform(F.sequence(F.lit(4), F.octet_length(data), F.lit(4)), lambda k: F.hex(F.substr(data, k, F.lit(1))))
    return F.when(F.octet_length(data) > 0, F.exists(alphas, lambda a: a != "FF")).when(data.isNotNull(), False)


# --- files -------------------------------------------------------------------------------------------------------

#: Fixed value: the signature of a PNG.
PNG = b"\x89PNG\r\n\x1a\n"
FILTERS = ("none", "sub", "up", "average", "paeth")


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    left, up, corner = (x.astype(np.int16) for x in (left, up, corner))
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def _filtered(rows: np.ndarray, kind: int, step: int) -> np.ndarray:
    """Rows of bytes with one row filter, its number before each row."""
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:], up[1:] = rows[:, :-step], rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, step:] = rows[:-1, :-step]
    guess = (0, left, up, (left.astype(np.int16) + up) // 2, _paeth(left, up, corner) if kind == 4 else 0)[kind]
    out = np.full((len(rows), rows.shape[1] + 1), kind, np.uint8)
    out[:, 1:] = (rows.astype(np.int16) - guess).astype(np.uint8)
    return out


def png_bytes(pixels: np.ndarray, level: int = 6, kind: int = 0) -> bytes:
    """An 8-bit PNG, without alpha if the image is opaque."""
    channels = 3 if (pixels[..., 3] == 255).all() else 4
    rows = pixels[..., :channels].reshape(len(pixels), -1)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2 if channels == 3 else 6, 0, 0, 0)
    packed = zlib.compress(_filtered(rows, kind, channels).tobytes(), level)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


class Refused(ValueError):
    """A file that is not broken, but not read: ``kind`` says why."""

    def __init__(self, kind: str, text: str):
        super().__init__(text)
        self.kind = kind


def _allowed(width: int, height: int) -> None:
    if width * height > MAX_DECODED:
        raise Refused("LimitExceeded", f"decoded image has {width * height} pixels, limit is {MAX_DECODED}")


def png_pixels(content: bytes) -> np.ndarray:
    """Pixels of an 8-bit PNG without interlacing or colour key; raises Refused for other ones, ValueError for a broken one.

    The header's size is held against the limit before anything is inflated,
    and no more is inflated than the pixels that it names.
    """
    at, head, packed, palette, alphas = 8, None, [], None, b""
    while at + 12 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alphas = body
        elif kind == b"IDAT":
            packed.append(body)
        at += size + 12
    if not head or head[3] not in (0, 2, 3, 4, 6) or not head[0] or not head[1]:
        raise ValueError("no PNG header")
    _allowed(head[0], head[1])
    if head[2] != 8 or head[6] or (alphas and head[3] in (0, 2)):
        raise Refused("CapabilityMissing", "not an 8-bit PNG without interlacing and colour key")
    w, h, step = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = zlib.decompressobj().decompress(b"".join(packed), h * (w * step + 1))
    except zlib.error as error:
        raise ValueError(str(error)) from error
    if len(raw) < h * (w * step + 1):
        raise ValueError("too few bytes of pixels")
    lines = np.frombuffer(raw, np.uint8, h * (w * step + 1)).reshape(h, -1)
    rows, above = np.zeros((h, w, step), np.uint8), np.zeros((w, step), np.uint8)
    for y, line in enumerate(lines):
        above = rows[y] = _unfiltered(line[1:].reshape(w, step), int(line[0]), above)
    opaque = np.full((h, w, 1), 255, np.uint8)
    if head[3] == 3:
        full = np.zeros((256, 4), np.uint8)
        full[: len(palette), :3], full[:, 3] = palette, 255
        full[: len(alphas), 3] = np.frombuffer(alphas, np.uint8)
        return full[rows[..., 0]]
    if head[3] in (0, 4):
        return np.concatenate([np.repeat(rows[..., :1], 3, axis=2), rows[..., 1:] if step == 2 else opaque], axis=2)
    return np.concatenate([rows, opaque], axis=2) if step == 3 else rows


def _unfiltered(line: np.ndarray, kind: int, above: np.ndarray) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + above
    if kind > 4:
        raise ValueError("unknown row filter")
    out = np.zeros_like(line)
    left = corner = np.zeros(line.shape[1], np.uint8)
    for x in range(len(line)):
        guess = (left.astype(np.int16) + above[x]) // 2 if kind == 3 else _paeth(left, above[x], corner)
        left, corner = (line[x].astype(np.int16) + guess).astype(np.uint8), above[x]
        out[x] = left
    return out


def bmp_bytes(pixels: np.ndarray) -> bytes:
    """A bitmap of 24 bits a pixel, or 32 if one is not opaque; rows from the bottom up."""
    depth = 24 if (pixels[..., 3] == 255).all() else 32
    swapped = pixels[::-1][..., [2, 1, 0, 3]][..., : depth // 8].reshape(len(pixels), -1)
    body = np.pad(swapped, ((0, 0), (0, -swapped.shape[1] % 4))).tobytes()
    head = struct.pack("<IiiHHIIiiII", 40, pixels.shape[1], pixels.shape[0], 1, depth, 0, len(body), 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + head + body


def bmp_pixels(content: bytes) -> np.ndarray:
    """Pixels of an uncompressed bitmap of 24 or 32 bits; raises ValueError for another or a broken one."""
    if len(content) < 54:
        raise ValueError("too short")
    (first,) = struct.unpack("<I", content[10:14])
    w, h, _, depth, packing = struct.unpack("<iiHHI", content[18:34])
    line = (abs(w) * depth // 8 + 3) // 4 * 4
    _allowed(abs(w), abs(h))
    if depth not in (24, 32) or packing not in (0, 3) or w <= 0 or len(content) < first + line * abs(h):
        raise ValueError("not an uncompressed bitmap of 24 or 32 bits")
    rows = np.frombuffer(content, np.uint8, line * abs(h), first).reshape(abs(h), line)[:, : w * depth // 8].reshape(abs(h), w, -1)
    rows = rows[::-1] if h > 0 else rows
    alpha = rows[..., 3:] if depth == 32 else np.full((abs(h), w, 1), 255, np.uint8)
    return np.concatenate([rows[..., 2::-1], alpha], axis=2)


DECODERS = {"png": png_pixels, "bmp": bmp_pixels}
ENCODERS = {"png": png_bytes, "bmp": bmp_bytes}


def _read(content: bytes | None, media: str | None) -> tuple[np.ndarray | None, str | None]:
    """The pixels of a file, or why there are none."""
    reader = DECODERS.get(media)
    if reader is None:
        return None, "CapabilityMissing"
    try:
        return reader(bytes(content or b"")), None
    except Refused as refused:
        return None, refused.kind
    except (ValueError, TypeError, struct.error):
        return None, "DecodeFailed"


def decode(df: DataFrame, content: str = "content", media: str = "media_type") -> DataFrame:
    """``df`` with width, height, data and ``error`` in place of the content.

    PNG and BMP are read; other types and kinds of them give
    ``CapabilityMissing``, images over the limit ``LimitExceeded``, broken
    files ``DecodeFailed``, and no pixels.
    """
    others = _others(df, content, *SCHEMA, "error")

    def one(row: dict) -> tuple:
        pixels, error = _read(row[content], row[media])
        return (None, None, None, error) if error else (pixels.shape[1], pixels.shape[0], np.ascontiguousarray(pixels).tobytes(), None)

    return _each_row(df, _quoted([*others, content]), others, one, SCHEMA | ERROR)


def encode(df: DataFrame, media: str = "output") -> DataFrame:
    """``df`` with the content of a file in place of the pixels; null for a type without an encoder."""
    others = _others(df, *SCHEMA)

    def one(row: dict) -> tuple:
        writer = ENCODERS.get(row[media])
        return (None if writer is None or row["data"] is None else writer(_pixels(row)),)

    return _each_row(df, [*_quoted(others), *SCHEMA], others, one, CONTENT)


def png_candidates(df: DataFrame, tried: list[tuple[int, int]]) -> DataFrame:
    """``df`` with the smallest PNG of each image over ``(level, filter)`` pairs: its length, its place in the list, and the content.

    The first of equal lengths counts.
    """
    others = _others(df, *SCHEMA)
    numbers = {c: ("long", pa.int64()) for c in ("bytes", "baseline", "priority")}

    def one(row: dict) -> tuple:
        made = [png_bytes(_pixels(row), level, kind) for level, kind in tried]
        best = min(range(len(made)), key=lambda k: (len(made[k]), k))
        return len(made[best]), len(made[0]), best, made[best]

    return _each_row(df, [*_quoted(others), *SCHEMA], others, one, numbers | CONTENT)


def declared(content: Column) -> Column:
    """``(width, height)`` that the header of a PNG or BMP names; null for other types, which have no pixels here."""
    png, bmp = F.hex(F.substring(content, 1, 8)) == F.lit(PNG.hex().upper()), F.hex(F.substring(content, 1, 2)) == "424D"
    high = u(content, 22, 4, little=True)
    return F.struct(
        F.when(png, u(content, 16, 4)).when(bmp, u(content, 18, 4, little=True)).alias("width"),
        F.when(png, u(content, 20, 4)).when(bmp, F.when(high >= 1 << 31, (1 << 32) - high).otherwise(high)).alias("height"),
    )


def refused(requests: DataFrame) -> Column:
    """Why a request is not carried out, from its files' headers alone: ``LimitExceeded``, ``InvalidOptions`` or null.

    In order: the pixels of the image, the crop in the turned image, the
    pixels of the output, then the watermark's size and place on it.  What a
    header does not tell is not judged here.
    """
    facts = declared(F.col("content"))

    def judged(facts: Column) -> Column:
        turned = F.coalesce(F.col("orientation").between(5, 8), F.lit(False)) != F.coalesce(F.pmod("rotate", F.lit(180)) == 90, F.lit(False))
        w, h = (F.when(turned, facts[a]).otherwise(facts[b]) for a, b in (("height", "width"), ("width", "height")))
        x, y, cw, ch = (F.get("crop", k).cast("long") for k in range(4))
        outside = crop_error(x, y, cw, ch, w, h).isNotNull() | (F.least(x, y, cw, ch) < 0)
        cut_w, cut_h = F.coalesce(cw, w), F.coalesce(ch, h)
        out_w, out_h = output_size(cut_w, cut_h, F.col("w").cast("long"), F.col("h").cast("long"))
        error = (
            F.when(facts["width"] * facts["height"] > MAX_DECODED, "LimitExceeded").when(outside, "InvalidOptions")
            .when(out_w * out_h > MAX_OUTPUT, "LimitExceeded")
        )
        if "mark" not in requests.columns:
            return error
        mark = declared(F.col("mark"))
        fits = watermark_fits(out_w, out_h, mark["width"], mark["height"], F.col("position"), F.col("margin").cast("long"))
        return error.when(~fits, "InvalidOptions").when(mark["width"] * mark["height"] > MAX_WATERMARK, "LimitExceeded")

    return F.element_at(F.transform(F.array(facts), judged), 1)


def transform(requests: DataFrame) -> DataFrame:
    """The whole pipeline from file bytes to file bytes.

    ``requests`` has image_id, content, media_type, orientation, rotate, crop
    (an array of x, y, w, h or null), w, h, fit, position, background (an array
    of four), blur, sharpen, opacity and output.  The order is orientation,
    rotation, crop, resize, blur, sharpen, watermark.  The watermark is the
    file in ``mark`` (with mark_type and margin) where there are such columns
    and it is not null; without them the image's own top left quarter, where
    an opacity is given.  Limits are checked by the headers before a pixel is
    read.  Returns image_id, width, height, error and content.  A file is
    read, worked on and written in one pass, so a task has one Python worker.
    """
    own_mark = "mark" not in requests.columns

    def step(pixels: np.ndarray, mark: np.ndarray | None, row: dict) -> np.ndarray:
        pixels = rotated(oriented(pixels, row["orientation"]), row["rotate"])
        if row["crop"]:
            pixels = cropped(pixels, *row["crop"])
        w, h = row["w"], row["h"]
        if w and h:
            pixels = fitted(pixels, w, h, row["fit"], row["position"], tuple(row["background"]))
        elif w or h:
            height, width = pixels.shape[:2]
            ratio = w / width if w else h / height
            pixels = resized(pixels, w or max(1, math.floor(width * ratio + 0.5)), h or max(1, math.floor(height * ratio + 0.5)))
        pixels = blurred(pixels, row["blur"]) if row["blur"] else pixels
        pixels = sharpened(pixels, row["sharpen"]) if row["sharpen"] else pixels
        if own_mark:
            mark = pixels[: len(pixels) // 2, : pixels.shape[1] // 2]
            return marked(pixels, mark, row["position"], row["opacity"], 1) if row["opacity"] else pixels
        return pixels if mark is None else marked(pixels, mark, row["position"], row["opacity"], row["margin"])

    def one(row: dict) -> tuple:
        error, mark, pixels = row["refused_"], None, None
        if not (error or own_mark or row["mark"] is None):
            mark, error = _read(row["mark"], row["mark_type"])
        if not error:
            pixels, error = _read(row["content"], row["media_type"])
        if error:
            return None, None, error, None
        pixels, writer = np.ascontiguousarray(step(pixels, mark, row)), ENCODERS.get(row["output"])
        return pixels.shape[1], pixels.shape[0], None, writer(pixels) if writer else None

    asked = requests.withColumn("refused_", refused(requests))
    for file in ("content", *([] if own_mark else ["mark"])):
        asked = asked.withColumn(file, F.when(F.col("refused_").isNull(), F.col(file)))
    made = {c: SCHEMA[c] for c in ("width", "height")} | ERROR | CONTENT
    # a column of the same name as one that is made does not pass through
    return _each_row(asked, _quoted(_others(asked, *SCHEMA, "error")), ["image_id"], one, made)
