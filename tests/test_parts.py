"""Parts of files and bodies against plain loops."""

import random
import re

from pyspark.sql import functions as F

from imgrel.functions import tables
from imgrel.operators import avif


def box(kind, body=b"", size=None, wide=False):
    if wide:
        return (1).to_bytes(4) + kind + (16 + len(body)).to_bytes(8) + body
    return (8 + len(body) if size is None else size).to_bytes(4) + kind + body


FTYP = box(b"ftyp", b"avif\0\0\0\0")
ISPE = lambda w, h: box(b"ispe", bytes(4) + w.to_bytes(4) + h.to_bytes(4))
AUX = box(b"auxC", bytes(4) + avif.ALPHA.encode() + b"\0")


def slow(content):
    """The tree read by recursion: ``(width, height, alpha, error)``."""
    if len(content or b"") < 16:
        return None, None, None, "avif file is too short"
    brands = [content[8:12], *(content[k : k + 4] for k in range(16, len(content) - 3, 4))]
    if content[4:8] != b"ftyp" or not {b"avif", b"avis"} & set(brands[:1] + brands[1 : 1 + (int.from_bytes(content[:4]) - 16) // 4]):
        return None, None, None, "avif file is missing a compatible AVIF brand"
    seen = {"size": None, "meta": False, "alpha": False}

    def read(part):
        at = 0
        while at + 8 <= len(part):
            n, kind, head = int.from_bytes(part[at : at + 4]), part[at + 4 : at + 8], 8
            n = len(part) if n == 0 else n
            if n == 1:
                if at + 16 > len(part):
                    raise ValueError("extended mp4 box header is truncated")
                n, head = int.from_bytes(part[at + 8 : at + 16]), 16
            if n < head:
                raise ValueError("mp4 box size is smaller than its header")
            if at + n > len(part):
                raise ValueError("mp4 box exceeds file length")
            body = part[at + head : at + n]
            seen["meta"] |= kind in (b"meta", b"iref", b"iprp", b"ipco", b"ispe", b"auxC", b"auxl")
            if kind in (b"meta", b"iref"):
                if len(body) < 4:
                    raise ValueError(kind.decode() + " box is too short")
                read(body[4:])
            elif kind in (b"iprp", b"ipco"):
                read(body)
            elif kind == b"ispe":
                if len(body) < 12:
                    raise ValueError("avif ispe box is too short")
                seen["size"] = seen["size"] or (int.from_bytes(body[4:8]), int.from_bytes(body[8:12]))
            elif kind == b"auxC":
                if len(body) < 5:
                    raise ValueError("avif auxC box is too short")
                seen["alpha"] |= body[4:] == avif.ALPHA.encode() + b"\0"
            elif kind == b"auxl":
                seen["alpha"] = True
            at += n
        if at != len(part):
            raise ValueError("avif box payload has trailing bytes")

    try:
        read(content)
    except ValueError as error:
        return None, None, None, str(error)
    return *(seen["size"] or (None, None)), seen["alpha"] if seen["meta"] else None, None


def tree(rng, depth=0):
    kinds = [lambda: ISPE(rng.randint(1, 9999), rng.randint(1, 9999)), lambda: AUX, lambda: box(b"auxl", b"xx"), lambda: box(b"mdat", rng.randbytes(rng.randint(0, 9)), wide=rng.random() < 0.3)]
    if depth < 4:
        kinds += [lambda: box(rng.choice([b"iprp", b"ipco"]), tree(rng, depth + 1)), lambda: box(rng.choice([b"meta", b"iref"]), bytes(4) + tree(rng, depth + 1), wide=rng.random() < 0.2)] * 2
    return b"".join(rng.choice(kinds)() for _ in range(rng.randint(0, 3)))


def test_avif_trees_are_recursion(spark):
    rng = random.Random(6)
    files = [FTYP + tree(rng) for _ in range(120)]
    broken = []
    for f in files[:60]:
        cut = bytearray(f + rng.randbytes(rng.choice([0, 0, 3])))
        if rng.random() < 0.7 and len(cut) > 20:
            cut[rng.randrange(16, len(cut))] = rng.choice([0, 1, 255])
        broken.append(bytes(cut[: rng.randint(16, len(cut))] if rng.random() < 0.4 else cut))
    files += broken + [b"", None, FTYP, FTYP[:12], box(b"ftyp", b"mif1\0\0\0\0"), FTYP + box(b"meta", b"ab"), FTYP + box(b"ispe", bytes(8)), FTYP + box(b"auxC", b"1"), FTYP + box(b"mdat", size=0)]
    df = spark.createDataFrame(list(enumerate(files)), "id long, content binary")
    found = {r.id: (r.width, r.height, r.has_alpha, r.error) for r in avif.headers(df).collect()}
    assert found == {k: slow(f) for k, f in enumerate(files)}
    assert len({v[3] for v in found.values()}) > 5 and sum(v[0] is not None for v in found.values()) > 20
    assert avif.headers(df.where(F.lit(False))).count() == 0


def test_parts_of_odd_values(spark):
    tables.register(spark)
    rows = lambda sql: [tuple(r) for r in spark.sql(sql).collect()]
    assert rows("SELECT * FROM jpeg_segments(CAST(NULL AS BINARY))") == [] == rows("SELECT * FROM webp_chunks(X'')")
    assert rows("SELECT marker, at, length FROM jpeg_segments(X'FFD8FFFFFFE000020102')") == [(0xE0, 4, 2)]
    assert rows("SELECT marker, length FROM jpeg_segments(X'FFD8FF01FFD0FFFE0003AAFFD9FFE00002')") == [(1, None), (0xD0, None), (0xFE, 3), (0xD9, None)]
    assert rows("SELECT kind, length FROM webp_chunks(X'524946460000000057454250414243440100000058004546474802000000AA')") == [("ABCD", 1)]
    body = b"--b\r\nContent-Disposition: form-data; name=\"file\"\r\n\r\n" + bytes(range(256)) + b"\r\n--b--"
    df = spark.createDataFrame([(body,), (b"--b--\r\n",), (b"--b--x",), (b"--bx\r\n--b--",), (b"x",), (None,), (b"--b\r\nno end",)], "body binary")
    df.createOrReplaceTempView("bodies")
    found = spark.sql("SELECT b.body, p.* FROM bodies b, LATERAL multipart_parts(b.body, 'b') p").collect()
    assert [(r.name, bytes(r.content)) for r in found if r.content is not None] == [("file", bytes(range(256)))]
    errors = sorted(re.sub("multipart ", "", r.error) for r in found if r.error)
    assert errors == sorted([
        "closing boundary has unexpected trailing data", "boundary must be followed by CRLF", "body does not start with the declared boundary",
        "body does not start with the declared boundary", "boundary sequence is malformed",
    ])
