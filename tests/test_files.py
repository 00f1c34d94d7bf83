"""Image files of a folder, from bytes to bytes."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from imgrel.functions.media import sniff
from imgrel.operators import encode, rasters
from imgrel.plans import rasters as plans
from imgrel.sources import files


def test_files_are_read_and_transformed(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {f"{name}.{kind}": rng.integers(0, 256, (h, w, 4), dtype=np.uint8) for name, kind, w, h in (("a", "png", 9, 4), ("b", "bmp", 3, 8), ("sub/c", "png", 1, 1))}
    (tmp_path / "sub").mkdir()
    for name, pixels in images.items():
        (tmp_path / name).write_bytes(rasters.ENCODERS[name[-3:]](pixels))
    (tmp_path / "big.png").write_bytes(bytes(2000))
    (tmp_path / "x.tmp.1").write_bytes(b"x")
    found = files.images(spark, str(tmp_path), max_bytes=1999).withColumn("media_type", sniff(F.col("content")))
    decoded = rasters.decode(found.where("media_type IS NOT NULL"))
    rows = {r.path.split(tmp_path.name + "/")[1]: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 4) for r in decoded.collect()}
    assert rows.keys() == images.keys() and all((rows[k] == v).all() for k, v in images.items())
    assert {r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path)).collect()} == {"a.png", "b.bmp", "c.png", "big.png"}
    out = rasters.encode(rasters.map_images(decoded, lambda p, _: rasters.fitted(p, 6, 6, "contain", "top", (0, 0, 0, 0))).withColumn("output", F.lit("png")))
    assert all(rasters.png_pixels(r.content).shape == (6, 6, 4) for r in out.collect())


def test_presets_are_read(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"name": "thumb", "width": 120}\n{"name": "hero", "format": "avif", "height": 3}\n')
    found = {r.name: (r.width, r.height, r.format) for r in files.presets(spark, str(tmp_path)).collect()}
    assert found == {"thumb": (120, None, None), "hero": (None, 3, "avif")}


def test_xmp_in_a_png_has_its_checksum(spark):
    content = rasters.png_bytes(np.zeros((2, 2, 4), np.uint8))
    row = spark.createDataFrame([(content, "<x/>")], "content binary, xmp string").select(encode.png_xmp(F.col("content"), F.col("xmp")).alias("c")).first()
    at = bytes(row.c).index(b"iTXt")
    body = bytes(row.c)[at : at + 4 + 22 + 4]
    assert bytes(row.c)[at - 4 : at] == (26).to_bytes(4) and body.endswith(b"<x/>") and bytes(row.c)[at + 30 : at + 34] == zlib.crc32(body).to_bytes(4)


def test_transform_keeps_the_order_of_steps(spark):
    pixels = np.random.default_rng(2).integers(0, 256, (6, 10, 4), dtype=np.uint8)
    row = (1, rasters.png_bytes(pixels), "png", 6, 90, [1, 1, 8, 4], 5, None, None, "center", [0, 0, 0, 255], 0.7, 1.0, 50, "bmp")
    schema = ("image_id long, content binary, media_type string, orientation int, rotate int, crop array<int>, w int, h int, fit string, position string, "
              "background array<int>, blur double, sharpen double, opacity int, output string")
    found = rasters.transform(spark.createDataFrame([row, (2, b"x", *row[2:])], schema)).orderBy("image_id").collect()
    want = rasters.cropped(rasters.rotated(rasters.oriented(pixels, 6), 90), 1, 1, 8, 4)
    want = rasters.sharpened(rasters.blurred(rasters.resized(want, 5, 3), 0.7), 1.0)
    want = rasters.marked(want, want[:1, :2], "center", 50, 1)
    assert (rasters.bmp_pixels(found[0].content) == want).all() and (found[0].width, found[0].height) == (5, 3)
    assert found[1].error == "DecodeFailed" and found[1].content is None


def test_files_that_are_not_read_say_why(spark):
    """Kinds of PNG without a reader, images over the limit, and files that inflate to more than they declare."""
    chunk = lambda name, body: len(body).to_bytes(4) + name + body + zlib.crc32(name + body).to_bytes(4)
    png = lambda w, h, depth, colour, interlace, data, *more: (
        rasters.PNG + chunk(b"IHDR", w.to_bytes(4) + h.to_bytes(4) + bytes([depth, colour, 0, 0, interlace])) + b"".join(more) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")
    )
    key = chunk(b"tRNS", bytes(6))
    files = [
        (png(2, 1, 8, 2, 0, bytes(7)), None), (png(2, 1, 8, 2, 0, bytes(7), key), "CapabilityMissing"), (png(2, 1, 8, 0, 0, bytes(3), chunk(b"tRNS", bytes(2))), "CapabilityMissing"),
        (png(2, 1, 16, 2, 0, bytes(13)), "CapabilityMissing"), (png(9, 1, 1, 0, 0, bytes(3)), "CapabilityMissing"), (png(2, 1, 8, 2, 1, bytes(7)), "CapabilityMissing"),
        (png(20_000, 20_000, 8, 2, 0, bytes(9)), "LimitExceeded"), (png(2, 1, 8, 2, 0, bytes(50_000_000)), None), (png(2, 2, 8, 2, 0, bytes(7)), "DecodeFailed"),
        (png(0, 1, 8, 2, 0, b""), "DecodeFailed"), (b"", "DecodeFailed"),
    ]
    df = spark.createDataFrame([(k, c, "png") for k, (c, _) in enumerate(files)], "id int, content binary, media_type string")
    found = {r.id: (r.error, r.width) for r in rasters.decode(df).collect()}
    assert [found[k][0] for k in range(len(files))] == [e for _, e in files] and found[7][1] == 2


def test_a_request_takes_one_python_worker(spark, sf_dir):
    """From file to file in one pass, and the whole query without a second run for what failed."""
    passes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    made = lambda k: (k, rasters.png_bytes(np.full((2, 3, 4), k % 251, np.uint8)), "png", 1, 0, None, None, None, None, "top-left", [0, 0, 0, 0], None, None, 100)
    schema = ("image_id long, content binary, media_type string, orientation int, rotate int, crop array<int>, w int, h int, fit string, position string, "
              "background array<int>, blur double, sharpen double, opacity int, mark binary, mark_type string, margin int, output string")
    mark = rasters.bmp_bytes(np.full((1, 1, 4), 255, np.uint8))
    rows = [(*made(k), *((mark, "bmp") if k % 3 == 0 else (b"x", "bmp") if k % 3 == 1 else (None, None)), 0, "gif" if k % 2 else "png") for k in range(1, 1101)]
    done = rasters.transform(spark.createDataFrame(rows, schema).coalesce(1))
    assert passes(done) == 1 and passes(plans.t18_pipeline(spark, sf_dir)) == 3
    found = {r.image_id: r for r in done.collect()}
    assert len(found) == 1100
    for k, r in found.items():
        assert (r.error, r.width, r.height) == (("DecodeFailed", None, None) if k % 3 == 1 else (None, 3, 2)) and (r.content is not None) == (k % 3 != 1 and k % 2 == 0)
        if r.content is not None:
            corner, rest = rasters.png_pixels(r.content)[0, 0], rasters.png_pixels(r.content)[0, 1]
            assert rest.tolist() == [k % 251] * 4 and (corner.tolist() == [255] * 4) == (k % 3 == 0 or k % 251 == 255)
