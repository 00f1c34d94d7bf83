"""Closed JSON payloads: types, ranges, unknown names."""

import pytest

from imgrel.functions import svg
from imgrel.operators import payloads

CASES = [
    (None, "invalid JSON"), ("", "invalid JSON"), ("null", "invalid JSON"), ("1", "invalid JSON"), ("{} x", "invalid JSON"), ('{},"c":{}', "invalid JSON"), ("{}} {", "invalid JSON"), ("{}][{}", "invalid JSON"), ("{}", None), ('{"width":null}', None),
    ('{"width":4294967295}', None), ('{"width":4294967296}', "invalid value for `width`"), ('{"width":-1}', "invalid value for `width`"), ('{"width":1.5}', "invalid value for `width`"),
    ('{"height":99999999999999999999999}', "invalid value for `height`"), ('{"blur":3,"sharpen":0.5}', None), ('{"blur":"3"}', "invalid value for `blur`"), ('{"fit":1}', "invalid value for `fit`"),
    ('{"crop":{"x":1}}', "invalid value for `crop`"), ('{"Width":1}', "unknown field `Width`"), ('{"rotate":0,"crop":"0,0,1,1"}', None), ('{"rotate":70000}', "invalid value for `rotate`"),
    ('{"rotate":91,"crop":"x"}', "rotate: unsupported rotation `91`"), ('{"optimize":"max"}', "optimize: unsupported optimize mode `max`"), ('{"format":"jpg"}', None),
]


@pytest.mark.parametrize("browser", [False, True])
def test_payloads(spark, browser):
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(CASES)], "id int, body string, error string").drop("error")
    found = {r.id: (r.error, r.options) for r in payloads.options(df, "body", browser).collect()}
    for k, (text, error) in enumerate(CASES):
        if not (browser and text and "rotate" in text and "crop" in text):
            assert found[k][0] == (error.replace(": unsupported", " is invalid: unsupported") if browser and error else error), text
            assert (found[k][1] is None) == (error is not None)
    assert found[24][1].format == "jpeg" and found[8][1].strip_metadata and found[8][1].auto_orient and found[15][1].blur == 3.0
    if browser:
        assert found[22][0].startswith("crop is invalid: ")


def test_browser_flags(spark):
    df = spark.createDataFrame([('{"keepMetadata":true}',), ('{"keepMetadata":true,"preserveExif":true}',), ('{"preserveExif":true}',), ('{"stripMetadata":true}',)], "body string")
    rows = {r.body: r for r in payloads.options(df, "body", True).collect()}
    assert [rows[b].error for b in df.toPandas()["body"]] == [None, "keepMetadata and preserveExif cannot both be true", None, "unknown field `stripMetadata`"]
    assert not rows['{"keepMetadata":true}'].options.strip_metadata and rows['{"preserveExif":true}'].options.preserve_exif


def test_long_sheets_are_read_once():
    text = "a{b:url(#x)}" * 200_000
    assert svg.css_text(text) == text  # copying the rest at each url( would take minutes
    assert svg.css_text("url(http://a(b)c) url(#ok) url(x") == "url() url(#ok) url()"
