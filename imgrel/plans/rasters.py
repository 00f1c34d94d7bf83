"""Queries over rasters: each vector is an image of 16 x 4 with alpha, or a grey one of 8 x 8 as a table of pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import pixels, rasters
from ..sources.views import view

SIDE = 8
W, H = 16, 4
POSITIONS = ("center", "top", "right", "bottom", "left", "top-left", "top-right", "bottom-left", "bottom-right")
BACKGROUND = (10, 200, 30, 100)
_PX = """WITH e AS (SELECT vec_id AS image_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
px AS (SELECT image_id, i // 8 AS y, i % 8 AS x, least(greatest(floor((v + 0.5::DOUBLE) * 255), 0), 255)::BIGINT AS v FROM e)"""
# one row for each channel of each pixel
_C = f"""WITH e AS (SELECT vec_id AS image_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
g AS (SELECT image_id, i // {W} AS y, i % {W} AS x, least(greatest(floor((v + 0.5::DOUBLE) * 255), 0), 255)::BIGINT AS v FROM e),
c AS (SELECT image_id, y, x, c, CASE c WHEN 0 THEN v WHEN 1 THEN 255 - v WHEN 2 THEN v * 7 % 256 ELSE CASE WHEN v < 30 THEN 128 ELSE 255 END END AS v
  FROM g, range(4) AS r(c))"""


def _out(of: str, *, w: str, h: str) -> str:
    """The head of the last SELECT: pixels of ``of`` as one text an image."""
    return f""" SELECT image_id, ({w})::INTEGER AS width, ({h})::INTEGER AS height,
  string_agg(lpad(hex(v::BIGINT), 2, '0'), '' ORDER BY y, x, c) AS data FROM {of} GROUP BY image_id"""


def _px(spark, sf):
    return pixels.from_vectors(view(spark, sf, "embeddings"), SIDE)


def _images(spark, sf):
    return rasters.from_vectors(view(spark, sf, "embeddings"), W)


def _shown(df):
    return df.select("image_id", "width", "height", F.hex("data").alias("data"))


def _each(spark, sf, step):
    return _shown(rasters.map_images(_images(spark, sf), step))


def _position(row) -> str:
    return POSITIONS[row["image_id"] % 9]


def _offsets(free_x: str, free_y: str, margin: int = 0) -> tuple[str, str]:
    """SQL for the place of content by ``image_id % 9``, from what is left free on each axis."""
    x = f"CASE WHEN image_id % 9 IN (4, 5, 7) THEN {margin} WHEN image_id % 9 IN (2, 6, 8) THEN {free_x} - {margin} ELSE ({free_x}) // 2 END"
    y = f"CASE WHEN image_id % 9 IN (1, 5, 6) THEN {margin} WHEN image_id % 9 IN (3, 7, 8) THEN {free_y} - {margin} ELSE ({free_y}) // 2 END"
    return x, y


def t1_orient(spark, sf):
    return _each(spark, sf, lambda p, row: rasters.oriented(p, row["image_id"] % 10))


T1 = _C + f""", o AS (SELECT image_id, c, v, CASE image_id % 10 WHEN 2 THEN {W - 1} - x WHEN 3 THEN {W - 1} - x WHEN 5 THEN {H - 1} - y WHEN 6 THEN {H - 1} - y WHEN 7 THEN y WHEN 8 THEN y ELSE x END AS x,
  CASE image_id % 10 WHEN 3 THEN {H - 1} - y WHEN 4 THEN {H - 1} - y WHEN 5 THEN {W - 1} - x WHEN 6 THEN x WHEN 7 THEN x WHEN 8 THEN {W - 1} - x ELSE y END AS y FROM c)""" + _out(
    "o", w=f"CASE WHEN image_id % 10 BETWEEN 5 AND 8 THEN {H} ELSE {W} END", h=f"CASE WHEN image_id % 10 BETWEEN 5 AND 8 THEN {W} ELSE {H} END")


def t2_rotate(spark, sf):
    return _each(spark, sf, lambda p, row: rasters.rotated(p, row["image_id"] % 4 * 90))


T2 = _C + f""", o AS (SELECT image_id, c, v, CASE image_id % 4 WHEN 1 THEN {H - 1} - y WHEN 2 THEN {W - 1} - x WHEN 3 THEN y ELSE x END AS x,
  CASE image_id % 4 WHEN 1 THEN x WHEN 2 THEN {H - 1} - y WHEN 3 THEN {W - 1} - x ELSE y END AS y FROM c)""" + _out(
    "o", w=f"CASE WHEN image_id % 2 = 1 THEN {H} ELSE {W} END", h=f"CASE WHEN image_id % 2 = 1 THEN {W} ELSE {H} END")


def t3_crop(spark, sf):
    return _each(spark, sf, lambda p, row: rasters.cropped(p, row["image_id"] % 5, row["image_id"] % 2, 10, 3))


T3 = _C + """, o AS (SELECT * FROM c WHERE x BETWEEN image_id % 5 AND image_id % 5 + 9 AND y BETWEEN image_id % 2 AND image_id % 2 + 2)""" + _out("o", w="10", h="3")


def _rounded(v: str) -> str:
    return f"least(greatest(floor(round({v}, 6) + 0.5::DOUBLE), 0), 255)"


def _weights(name: str, source: int, target: int) -> str:
    """Lanczos weights of one axis, from the formula."""
    x = f"((s + 0.5::DOUBLE - (t + 0.5::DOUBLE) * {source} / {target}) / greatest(1, {source}::DOUBLE / {target}))"
    kernel = f"CASE WHEN abs({x}) >= 3 THEN 0 WHEN {x} = 0 THEN 1 ELSE 3 * sin(pi() * {x}) * sin(pi() * {x} / 3) / (pi() * pi() * {x} * {x}) END"
    return f"{name} AS (SELECT t, s, k / sum(k) OVER (PARTITION BY t) AS k FROM (SELECT t, s, ({kernel})::DOUBLE AS k FROM range({target}) AS a(t), range({source}) AS b(s)))"


def _resized(of: str, name: str, size: tuple[int, int], target: tuple[int, int]) -> str:
    """CTEs that end in ``name``: the pixels of ``of`` at another size."""
    return f""", {_weights(name + '_x', size[0], target[0])}, {_weights(name + '_y', size[1], target[1])},
{name}_h AS (SELECT image_id, y, t AS x, c, sum(v * k) AS v FROM {of} JOIN {name}_x ON x = s GROUP BY ALL),
{name} AS (SELECT image_id, t AS y, x, c, {_rounded('sum(v * k)')} AS v FROM {name}_h JOIN {name}_y ON y = s GROUP BY image_id, t, x, c)"""


def _blended(base: str, top: str) -> str:
    """CTE ``o``: ``top`` over ``base``, both with a row for each channel; where ``top`` has no pixel ``base`` stays."""
    wide = lambda t: f"(SELECT image_id, y, x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b, max(v) FILTER (c = 3) / 255::DOUBLE AS a FROM {t} GROUP BY image_id, y, x)"
    mix = lambda n: f"CASE WHEN alpha = 0 THEN 0 ELSE (ft.{n} * ft.a + fb.{n} * fb.a * (1 - ft.a)) / alpha END"
    return f""", m AS (SELECT fb.image_id, fb.y, fb.x, ft.a + fb.a * (1 - ft.a) AS alpha, fb.r AS r0, fb.g AS g0, fb.b AS b0, fb.a AS a0, {mix('r')} AS r, {mix('g')} AS g, {mix('b')} AS b
  FROM {wide(base)} fb LEFT JOIN {wide(top)} ft ON fb.image_id = ft.image_id AND fb.y = ft.y AND fb.x = ft.x),
o AS (SELECT image_id, y, x, c, floor(round(CASE WHEN alpha IS NULL THEN CASE c WHEN 0 THEN r0 WHEN 1 THEN g0 WHEN 2 THEN b0 ELSE a0 * 255 END
  ELSE CASE c WHEN 0 THEN r WHEN 1 THEN g WHEN 2 THEN b ELSE alpha * 255 END END, 6)) AS v FROM m, range(4) AS q(c))"""


def _box(w: int, h: int) -> str:
    values = ", ".join(f"({k}, {v})" for k, v in enumerate(BACKGROUND))
    return f"(SELECT image_id, y, x, c, v FROM (SELECT DISTINCT image_id FROM c) i, range({h}) AS a(y), range({w}) AS b(x), (VALUES {values}) AS z(c, v))"


def _moved(of: str, outer: tuple[int, int], inner: tuple[int, int], margin: int = 0) -> str:
    x, y = _offsets(str(outer[0] - inner[0]), str(outer[1] - inner[1]), margin)
    return f"(SELECT image_id, y + {y} AS y, x + {x} AS x, c, v FROM {of})"


def t5_resize(spark, sf):
    """Ten pixels wide, the height by the ratio."""
    return _each(spark, sf, lambda p, _: rasters.resized(p, 10, 3))


T5 = _C + _resized("c", "z", (W, H), (10, 3)) + _out("z", w="10", h="3")


def _fit(spark, sf, w, h, fit):
    return _each(spark, sf, lambda p, row: rasters.fitted(p, w, h, fit, _position(row), BACKGROUND))


def t6_fill(spark, sf):
    return _fit(spark, sf, 7, 9, "fill")


T6 = _C + _resized("c", "z", (W, H), (7, 9)) + _out("z", w="7", h="9")


def t7_contain(spark, sf):
    """Larger than the source: 24 x 6 in a box of 24 x 10."""
    return _fit(spark, sf, 24, 10, "contain")


T7 = _C + _resized("c", "z", (W, H), (24, 6)) + _blended(_box(24, 10), _moved("z", (24, 10), (24, 6))) + _out("o", w="24", h="10")


def t8_inside(spark, sf):
    """As it is in a larger box for every other image, else smaller: 8 x 2 in a box of 8 x 7."""
    return _each(spark, sf, lambda p, row: rasters.fitted(p, 20 if row["image_id"] % 2 else 8, 7, "inside", _position(row), BACKGROUND))


_T8_SMALL = _resized("c", "z", (W, H), (8, 2)) + _blended(_box(8, 7), _moved("z", (8, 7), (8, 2)))
T8 = (
    "SELECT * FROM (" + _C + _T8_SMALL + _out("o", w="8", h="7") + ") WHERE image_id % 2 = 0 UNION ALL SELECT * FROM ("
    + _C + _blended(_box(20, 7), _moved("c", (20, 7), (W, H))) + _out("o", w="20", h="7") + ") WHERE image_id % 2 = 1"
)


def t9_cover(spark, sf):
    """20 x 5 is what covers a box of 6 x 5."""
    return _fit(spark, sf, 6, 5, "cover")


_X9, _ = _offsets("14", "0")
T9 = _C + _resized("c", "z", (W, H), (20, 5)) + f""", o AS (SELECT image_id, y, x - {_X9} AS x, c, v FROM z WHERE x - {_X9} BETWEEN 0 AND 5)""" + _out("o", w="6", h="5")


def t10_pad(spark, sf):
    return _each(spark, sf, lambda p, row: rasters.padded(p, 19, 9, _position(row), BACKGROUND))


T10 = _C + _blended(_box(19, 9), _moved("c", (19, 9), (W, H))) + _out("o", w="19", h="9")


def t12_blur(spark, sf):
    return _each(spark, sf, lambda p, _: rasters.blurred(p, 1.5))


def _blurred(name: str, sigma: float, reach: int) -> str:
    axis = lambda n, size: (
        f"{name}_{n} AS (SELECT t, s, k / sum(k) OVER (PARTITION BY t) AS k FROM (SELECT t, s, exp(-((s - t) * (s - t)) / {2 * sigma * sigma}::DOUBLE) AS k "
        f"FROM range({size}) AS a(t), range({size}) AS b(s) WHERE abs(s - t) <= {reach}))")
    return f""", {axis('x', W)}, {axis('y', H)}, {name}_h AS (SELECT image_id, y, t AS x, c, sum(v * k) AS v FROM c JOIN {name}_x ON x = s GROUP BY ALL),
{name} AS (SELECT image_id, t AS y, x, c, {_rounded('sum(v * k)')} AS v FROM {name}_h JOIN {name}_y ON y = s GROUP BY image_id, t, x, c)"""


T12 = _C + _blurred("z", 1.5, 3) + _out("z", w=str(W), h=str(H))


def t13_unsharp(spark, sf):
    return _each(spark, sf, lambda p, _: rasters.sharpened(p, 1.0))


T13 = _C + _blurred("z", 1.0, 2) + """, o AS (SELECT c.image_id, c.y, c.x, c.c, CASE WHEN abs(c.v - z.v) > 1 THEN least(greatest(2 * c.v - z.v, 0), 255) ELSE c.v END AS v
  FROM c JOIN z ON c.image_id = z.image_id AND c.y = z.y AND c.x = z.x AND c.c = z.c)""" + _out("o", w=str(W), h=str(H))


def t14_watermark(spark, sf):
    """A mark of 3 x 2 pixels at each position, with half its alpha and a margin of one pixel."""
    mark = np.array([[[i * 40 + 20, 255 - i * 30, i * 11, i * 30 + 61] for i in range(y * 3, y * 3 + 3)] for y in range(2)], np.uint8)
    return _each(spark, sf, lambda p, row: rasters.marked(p, mark, _position(row), 50, 1))


T14 = _C + """, mark AS (SELECT image_id, i // 3 AS y, i % 3 AS x, c, CASE c WHEN 0 THEN i * 40 + 20 WHEN 1 THEN 255 - i * 30 WHEN 2 THEN i * 11 ELSE (i * 30 + 61) * 50 // 100 END AS v
  FROM (SELECT DISTINCT image_id FROM c) d, range(6) AS r(i), range(4) AS q(c))""" + _blended("c", _moved("mark", (W, H), (3, 2), 1)) + _out("o", w=str(W), h=str(H))


def t16_transparency(spark, sf):
    return _images(spark, sf).select("image_id", rasters.is_transparent(F.col("data")).alias("transparent"))


T16 = _C + " SELECT image_id, bool_or(c = 3 AND v < 255) AS transparent FROM c GROUP BY image_id"


def t17_output_alpha(spark, sf):
    """What an output says of its alpha, and how many channels are written: opaque images lose theirs, and JPEG has none."""
    kind = F.when(F.col("image_id") % 3 == 0, "jpeg").when(F.col("image_id") % 3 == 1, "png").otherwise("bmp")
    images = _images(spark, sf).select("image_id", kind.alias("output"), rasters.is_transparent(F.col("data")).alias("alpha"))
    alpha = F.when(F.col("output") == "jpeg", False).otherwise(F.col("alpha"))
    return images.groupBy("output", alpha.alias("has_alpha"), F.when(alpha, 4).otherwise(3).cast("long").alias("channels")).agg(F.count(F.lit(1)).alias("n"))


T17 = _C + """, t AS (SELECT image_id, bool_or(c = 3 AND v < 255) AS alpha FROM c GROUP BY image_id)
SELECT ['jpeg', 'png', 'bmp'][image_id % 3 + 1] AS output, alpha AND image_id % 3 > 0 AS has_alpha, (3 + (alpha AND image_id % 3 > 0)::INT)::BIGINT AS channels, count(*) AS n FROM t GROUP BY ALL"""


def e2_round_trip(spark, sf):
    """Each image as a file of its output type and back: the pixels stay; types without a codec say so."""
    kind = F.element_at(F.array(*map(F.lit, ("png", "bmp", "webp"))), (F.col("image_id") % 3 + 1).cast("int"))
    files = rasters.encode(_images(spark, sf).withColumn("media_type", kind), "media_type")
    return rasters.decode(files).select("image_id", "media_type", "width", "height", "error", F.hex("data").alias("data"))


E2 = "SELECT image_id, ['png', 'bmp', 'webp'][image_id % 3 + 1] AS media_type, CASE WHEN image_id % 3 < 2 THEN width END AS width, CASE WHEN image_id % 3 < 2 THEN height END AS height, CASE WHEN image_id % 3 = 2 THEN 'CapabilityMissing' END AS error, CASE WHEN image_id % 3 < 2 THEN data END AS data FROM (" + _C + _out("c", w=str(W), h=str(H)) + ")"

#: Levels and row filters that are tried, the baseline first.
STRATEGIES = [(6, 4), (9, 4), (9, 1), (9, 2), (9, 3), (9, 0)]


def e4_png(spark, sf):
    """The smallest of several PNG encodings, which is no larger than the first and holds the same pixels."""
    best = rasters.png_candidates(_images(spark, sf), STRATEGIES)
    kept = best.select("image_id", (F.col("bytes") <= F.col("baseline")).alias("no_larger"), F.lit("png").alias("media_type"), "content")
    return rasters.decode(kept).select("image_id", "no_larger", F.hex("data").alias("data"))


E4_PNG = "SELECT image_id, true AS no_larger, data FROM (" + _C + _out("c", w=str(W), h=str(H)) + ")"


def _requests(spark, sf):
    """PNG and BMP files with what is asked of them; every eleventh file is cut off."""
    kind = F.when(F.col("image_id") % 2 == 0, "png").otherwise("bmp")
    files = rasters.encode(_images(spark, sf).withColumn("media_type", kind), "media_type")
    content = F.when(F.col("image_id") % 11 == 0, F.substr("content", F.lit(1), F.lit(60))).otherwise(F.col("content"))
    return files.select(
        "image_id", "media_type", content.alias("content"), F.lit(4).alias("orientation"), F.lit(90).alias("rotate"), F.array(*map(F.lit, (1, 2, 3, 10))).alias("crop"),
        F.lit(6).alias("w"), F.lit(5).alias("h"), F.lit("fill").alias("fit"), F.lit("center").alias("position"), F.array(*map(F.lit, BACKGROUND)).alias("background"),
        F.lit(None).cast("double").alias("blur"), F.lit(None).cast("double").alias("sharpen"), F.lit(None).cast("int").alias("opacity"),
        F.when(F.col("image_id") % 3 == 0, "png").otherwise("bmp").alias("output"),
    )


def t18_pipeline(spark, sf):
    """File bytes to file bytes; the pixels of the files that come out are read back."""
    done = rasters.transform(_requests(spark, sf)).select(
        "image_id", F.col("error").alias("failed"), "content", F.when(F.col("image_id") % 3 == 0, "png").otherwise("bmp").alias("media_type"))
    # what failed has no content and so no pixels
    return rasters.decode(done).select("image_id", F.col("failed").alias("error"), F.hex("data").alias("data"))


T18 = (
    "SELECT image_id, CASE WHEN image_id % 11 = 0 THEN 'DecodeFailed' END AS error, CASE WHEN image_id % 11 > 0 THEN data END AS data FROM ("
    + _C + f""", f AS (SELECT image_id, y AS x, x AS y, c, v FROM c), k AS (SELECT image_id, x - 1 AS x, y - 2 AS y, c, v FROM f WHERE x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 11)"""
    + _resized("k", "z", (3, 10), (6, 5)) + _out("z", w="6", h="5") + ")"
)


def t18_limits(spark, sf):
    """The pipeline where crops, outputs and watermarks may be out of bounds; a watermark is a file of its own."""
    kind, images = F.col("image_id") % 8, _images(spark, sf)
    files = rasters.encode(images.withColumn("media_type", F.lit("png")), "media_type")
    mark = rasters.encode(images.withColumn("media_type", F.lit("bmp")), "media_type").select("image_id", F.col("content").alias("mark_file"))
    size = lambda *pairs: F.element_at(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(F.lit(v) for _, v in pairs))), kind.cast("int"))
    asked = files.join(mark, "image_id").select(
        "image_id", "content", F.when(kind == 7, "jpeg").otherwise("png").alias("media_type"), F.when(kind == 2, 6).otherwise(1).alias("orientation"), F.lit(0).alias("rotate"),
        F.when(kind == 1, F.array(*map(F.lit, (0, 0, W + 1, H)))).when(kind == 2, F.array(*map(F.lit, (0, 0, H, W)))).alias("crop"),
        size((0, 30), (3, 8193), (4, 20_000), (5, 12), (6, W)).alias("w"), size((0, 20), (3, 8192), (5, 12), (6, H)).alias("h"),
        F.lit("fill").alias("fit"), F.lit("top-left").alias("position"), F.array(*map(F.lit, BACKGROUND)).alias("background"),
        F.lit(None).cast("double").alias("blur"), F.lit(None).cast("double").alias("sharpen"), F.lit(50).alias("opacity"),
        F.when(kind.isin(0, 5, 6), F.col("mark_file")).alias("mark"), F.lit("bmp").alias("mark_type"), F.when(kind == 0, 2).otherwise(0).alias("margin"), F.lit("png").alias("output"),
    )
    done = rasters.transform(asked)
    return done.select("image_id", "error", "width", "height", F.col("content").isNotNull().alias("made"))


T18_LIMITS = f"""SELECT vec_id AS image_id, CASE vec_id % 8 WHEN 1 THEN 'InvalidOptions' WHEN 3 THEN 'LimitExceeded' WHEN 4 THEN 'LimitExceeded'
  WHEN 5 THEN 'InvalidOptions' WHEN 7 THEN 'CapabilityMissing' END AS error,
  (CASE vec_id % 8 WHEN 0 THEN 30 WHEN 2 THEN {H} WHEN 6 THEN {W} END)::INTEGER AS width,
  (CASE vec_id % 8 WHEN 0 THEN 20 WHEN 2 THEN {W} WHEN 6 THEN {H} END)::INTEGER AS height, vec_id % 8 IN (0, 2, 6) AS made FROM embeddings"""


def q_metrics(spark, sf):
    """Each image against a coarser copy of itself; every seventh against an equal one."""
    coarse = F.when(F.col("image_id") % 7 == 0, F.col("v")).otherwise(F.floor(F.col("v") / 16) * 16 + F.col("x") % 3)
    return pixels.quality(_px(spark, sf).select("image_id", F.col("v").alias("a"), coarse.alias("b")))


Q = _PX + """, p AS (SELECT image_id, v::DOUBLE AS a, (CASE WHEN image_id % 7 = 0 THEN v ELSE v // 16 * 16 + x % 3 END)::DOUBLE AS b FROM px),
s AS (SELECT image_id, avg((a - b) * (a - b)) * 0.75::DOUBLE AS mse, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cov FROM p GROUP BY image_id)
SELECT image_id, CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE round(10 * log10(65025 / mse), 6) END AS psnr, round(least(greatest((2 * ma * mb + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE)
  / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE)), 0), 1), 6) AS ssim FROM s"""


def e4_smallest(spark, sf):
    """Of five encodings of each image the one with the fewest bytes; sizes follow the number of grey levels left."""
    levels = [F.struct(F.lit(k).cast("long").alias("priority"), F.floor(F.col("v") / (1 << k)).alias("level")) for k in range(5)]
    tried = _px(spark, sf).select("image_id", F.explode(F.array(*levels)).alias("t")).groupBy("image_id", "t.priority").agg(
        (F.count_distinct("t.level") + F.col("t.priority") * 7).alias("bytes"))
    return pixels.smallest(tried, "image_id").select("image_id", "priority", "bytes")


E4 = _PX + """, t AS (SELECT image_id, k AS priority, count(DISTINCT v // (1 << k)) + k * 7 AS bytes FROM px, range(5) AS r(k) GROUP BY image_id, k)
SELECT DISTINCT ON (image_id) image_id, priority, bytes FROM t ORDER BY image_id, bytes, priority"""


def e7_target(spark, sf):
    """The smallest quality whose quantised copy keeps the mean squared error within a bound, else the largest tried."""
    px = _px(spark, sf)
    steps = F.array(*(F.struct(F.lit(q).alias("quality"), F.lit(s).alias("step")) for q, s in ((10, 64), (40, 32), (70, 16), (90, 8), (100, 1))))
    tried = px.select("image_id", "v", F.explode(steps).alias("s")).select("image_id", "v", "s.quality", "s.step")
    error = F.avg(F.pow((F.col("v") - F.floor(F.col("v") / F.col("step")) * F.col("step")).cast("double"), 2))
    scored = tried.groupBy("image_id", "quality").agg(error.alias("mse"))
    return scored.groupBy("image_id").agg(F.coalesce(F.min(F.when(F.col("mse") <= 90, F.col("quality"))), F.lit(100)).cast("long").alias("quality"))


E7 = _PX + """, s AS (SELECT image_id, q, avg(((v - v // st * st) * (v - v // st * st))::DOUBLE) AS mse FROM px, (VALUES (10, 64), (40, 32), (70, 16), (90, 8), (100, 1)) AS t(q, st) GROUP BY ALL)
SELECT image_id, coalesce(min(q) FILTER (mse <= 90), 100)::BIGINT AS quality FROM s GROUP BY image_id"""

QUERIES = {
    "t1_orient": (t1_orient, T1), "t2_rotate": (t2_rotate, T2), "t3_crop": (t3_crop, T3), "t5_resize": (t5_resize, T5), "t6_fill": (t6_fill, T6),
    "t7_contain": (t7_contain, T7), "t8_inside": (t8_inside, T8), "t9_cover": (t9_cover, T9), "t10_pad": (t10_pad, T10),
    "t12_blur": (t12_blur, T12), "t13_unsharp": (t13_unsharp, T13), "t14_watermark": (t14_watermark, T14), "t16_transparency": (t16_transparency, T16),
    "t17_output_alpha": (t17_output_alpha, T17), "t18_pipeline": (t18_pipeline, T18), "t18_limits": (t18_limits, T18_LIMITS), "e2_round_trip": (e2_round_trip, E2), "e4_png": (e4_png, E4_PNG),
    "q_metrics": (q_metrics, Q), "e4_smallest": (e4_smallest, E4), "e7_target": (e7_target, E7),
}
