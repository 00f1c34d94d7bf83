"""Presets that change, break and come back between micro-batches."""

from imgrel.streaming.presets import Presets, merged_stream

REQUEST = "id long, preset string, width long, height long, format string"


def test_a_bad_file_keeps_the_presets_before(spark, tmp_path):
    file, source, out = tmp_path / "presets.json", str(tmp_path / "in"), str(tmp_path / "out")
    good = '{"name": "thumb", "width": 120, "height": 80}\n{"name": "hero", "format": "avif"}\n'
    versions = [None, good, '{"name": "thumb", "wid', '{"name": "thumb"}\n{"name": "thumb"}\n', '{"width": 3}\n', '{"name": "thumb", "width": 7}\n']
    for k, text in enumerate(versions):
        if text is not None:
            file.write_text(text)
        spark.createDataFrame([(k, "thumb", None, None, "png"), (k + 100, "hero", 5, None, None)], REQUEST).write.mode("append").parquet(source)
        presets = Presets(spark, str(file), str(tmp_path / "state"))  # as after a restart
        query = merged_stream(spark.readStream.schema(REQUEST).parquet(source), presets, out)
        assert query.awaitTermination(90)
    rows = {r.id: r for r in spark.read.parquet(out).collect()}
    assert len(rows) == 2 * len(versions)
    assert [rows[k].width for k in range(6)] == [None, 120, 120, 120, 120, 7]
    assert [rows[k + 100].format for k in range(6)] == [None, "avif", "avif", "avif", "avif", None] and rows[101].width == 5 and rows[1].format == "png"
    assert rows[0].preset_version is None and len({r.preset_version for r in rows.values()}) == 3
