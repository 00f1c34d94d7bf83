"""The registered queries, and each stage of the pipeline, against brute force on whole small tables."""

import hashlib
import re
import zlib
from datetime import date, timedelta

import numpy as np
import xxhash
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from imgrel.llm import bpe, pii

QUERIES = __spark_entry__.queries()


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_op6_is_the_library(spark, sf_dir):
    library, texts = Tokenizer.from_file(bpe.default_path()), texts_of(spark, sf_dir)
    rows = QUERIES["op6_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_op7_is_brute_force(spark, sf_dir):
    fps = {i: slow_fingerprint(t) for i, t in texts_of(spark, sf_dir).items()}
    root = {i: i for i in fps}
    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, sf_dir).collect()}
    assert found == {i: (f"{fps[i]:016x}", root[i]) for i in fps}


def test_op8_packs_every_id_once(spark, sf_dir):
    library, texts = Tokenizer.from_file(bpe.default_path()), texts_of(spark, sf_dir)
    rows = QUERIES["op8_packing"](spark, sf_dir).toPandas()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    for doc_id, own in rows.groupby("doc_id"):
        own, at = own.sort_values("start"), 0
        for r in own.itertuples():
            piece = ids[doc_id][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids[doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc_id])
    assert set(rows["doc_id"]) == set(ids)
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
    sizes = rows.groupby("sequence_id")["length"].sum()
    assert sizes.max() <= 2048 and 1 - sizes.sum() / (2048 * len(sizes)) < 0.05


# op2 again in plain Python: kinds in order at each place of the text, then the network of each kind.
WORD = "A-Za-z0-9"
KINDS = [
    ("email", rf"(?<![{WORD}._%+-])[{WORD}._%+-]+@[{WORD}-]+(?:\.[{WORD}-]+)+"),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"),
    ("date", r"(?<![\d./-])(?:\d{4}([-/.])\d\d?\1\d\d?|\d\d?([-/.])\d\d?\2\d{4})(?!\d|[./-]\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d\d-\d{4}(?!\d|-\d)"),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)"),
    ("phone", r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|(?<![\d.-])\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4})(?!\d)"),
    ("iban", pii.IBAN),
]
FINDERS = [(kind, re.compile(pattern, re.A)) for kind, pattern in KINDS]


def stream(*parts):
    return "|".join(map(str, parts)).encode()


def shifted(text, digest):
    out = ""
    for k, c in enumerate(text):
        by = int(digest[4 * k : 4 * k + 4], 16)
        first, n = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (0, 0)
        out += chr((ord(c) - first + by) % n + first) if n else c
    return out


def text_network(value, kind, key):
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(8):
        a, b = b, shifted(a, hashlib.sha512(stream(key, kind, i, len(value), b)).hexdigest())
    return a + b


def number_network(n, bounds, kind, key):
    a, b = divmod(n, bounds[1])
    for i in range(8):
        h = int(hashlib.sha256(stream(key, kind, i, a if i % 2 else b)).hexdigest()[:15], 16)
        a, b = (a, (b + h) % bounds[1]) if i % 2 else ((a + h) % bounds[0], b)
    return a * bounds[1] + b


def refilled(form, signs, pattern="[0-9]"):
    signs = iter(signs)
    return re.sub(pattern, lambda m: next(signs), form)


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 * (int(d) > 4)) for k, d in enumerate(digits[::-1])) % 10


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def slow_pseudonym(kind, match, key):
    digits = re.sub("[^0-9]", "", match)
    if kind == "email":
        local, domain = match.rsplit("@", 1)
        blocks = [local[k : k + 64] for k in range(0, len(local), 64)]
        return "".join(text_network(b, "email" + (str(k) if k else ""), key) for k, b in enumerate(blocks)) + "@" + domain
    if kind == "ipv4":
        parts = [int(x) for x in match.split(".")]
        if max(parts) > 255:
            return match
        n = number_network(int.from_bytes(bytes(parts)), (1 << 16, 1 << 16), "ipv4", key)
        return ".".join(map(str, n.to_bytes(4)))
    if kind == "date":
        sign = re.search("[-/.]", match).group()
        first, second, third = match.split(sign)
        order = "ymd" if len(first) == 4 else "mdy" if int(second) > 12 else "dmy"
        value = dict(zip(order, (first, second, third)))
        try:
            n = (date(int(value["y"]), int(value["m"]), int(value["d"])) - date(1800, 1, 1)).days
        except ValueError:
            return match
        if not 0 <= n < 146_097:
            return match
        new = date(1800, 1, 1) + timedelta(number_network(n, (189, 773), "date", key))
        now = {"y": f"{new.year:04d}", "m": str(new.month), "d": str(new.day)}
        return sign.join(now[k].rjust(len(value[k]), "0") for k in order)
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return match
        areas = [x for x in range(1, 900) if x != 666]
        n = number_network((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, (898, 99 * 9999), "ssn", key)
        n, serial = divmod(n, 9999)
        area, group = divmod(n, 99)
        return refilled(match, f"{areas[area]:03d}{group + 1:02d}{serial + 1:04d}")
    if kind == "card":
        if luhn(digits):
            return match
        body = text_network(digits[:-1], "card", key)
        return refilled(match, body + str(-luhn(body + "0") % 10))
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return match
        return refilled(match, digits[:-10] + text_network(digits[-10:], "phone", key))
    signs = match.replace(" ", "")
    if mod97(signs[4:] + signs[:4]) != 1:
        return match
    body = text_network(signs[4:], "iban", key)
    return refilled(match, f"{signs[:2]}{98 - mod97(body + signs[:2] + '00'):02d}{body}", "[A-Z0-9]")


def slow_pseudonyms(text, key):
    out, at, n = "", 0, 0
    while at < len(text):
        places = [(m.start(), k, kind, m) for k, (kind, find) in enumerate(FINDERS) if (m := find.search(text, at))]
        if not places:
            break
        start, _, kind, m = min(places, key=lambda p: p[:2])
        new = slow_pseudonym(kind, m.group(), key)
        out, at, n = out + text[at:start] + new, m.end(), n + (new != m.group())
    return out + text[at:], n


EDGES = [
    "a@" + "b." * 5000 + "com", "a@b..c", "x@b.c..d", "y@m.de.", "u" * 300 + "@h.org z@h.org", "q@-.- @a.b a@b a@@b.c", "a." * 3000 + "@x.y",
    "1.2.3.4 256.1.1.1 1.2.3.4.5 x1.2.3.4", "2020-02-29 29.2.2020 2/29/2020 13/13/2020 1799-12-31 2199-12-31 2200-01-01 2020-2-3", "123-45-6789 665-01-0001 667-99-9999 899-01-0001 000-12-3456 666-12-3456",
    "4041894974608795 4041 8949 7460 8795 4041-8949-7460-8796 378282246310005", "+1 (988) 555-2485 988-555-2485 (988) 555-2485 +49 30 1234567", "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 IN",
    "12-" * 3000, "+1" * 3000, "AB12 " * 3000, "." * 20_000, "9" * 20_000,
]


def test_op2_is_brute_force(spark, sf_dir):
    spark.conf.set(pii.SETTING, "the test's key")
    try:
        texts = texts_of(spark, sf_dir)
        found = {r.doc_id: (r.text, r.n_pseudonyms) for r in QUERIES["op2_pii"](spark, sf_dir).collect()}
        assert found == {i: (None, 0) if t is None else slow_pseudonyms(t, "the test's key") for i, t in texts.items()}
        assert sum(n for _, n in found.values()) > 5
        df = spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string")
        for r in pii.pseudonymize(df, "k").collect():
            assert (r.text, r.n_pseudonyms) == slow_pseudonyms(EDGES[r.doc_id], "k"), EDGES[r.doc_id][:80]
    finally:
        spark.conf.unset(pii.SETTING)


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in every column, large and repeated ids, clashing names, and an empty table, through each stage in turn."""
    big = (1 << 62) + 977
    long_text = "Some words that end in a full stop, as sentences do. " * 12
    rows = [(big, long_text + "One."), (None, long_text + "Two!"), (big, long_text + "One."), (big, "Another text, under the same id, which has to stay as it is."),
            (big + 1, None), (None, None), (None, ""), (3, " \n "), (4, "Write to jo@example.org or call 988-555-2485, thank you."), (None, "Write to jo@example.org or call 988-555-2485, thank you.")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, key_0 int, score double, n_pseudonyms int"
    docs = spark.createDataFrame([(i, t, None, None, None, "x", None, None, 3) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        out = stage(spark, docs, sf_dir)
        assert empty.count() == 0
        kept = [(r.doc_id, r.text) for r in out.collect()] if name != "packing" else out.collect()
        if name == "packing":
            assert {r.doc_id for r in kept} == {i for i, _ in rows}
            continue
        assert out.columns == docs.columns
        if name in ("quality", "pii"):
            assert len(kept) == len(rows) if name == "pii" else set(kept) <= set(rows)
            assert {i for i, _ in kept} <= {big, big + 1, None, 3, 4}
        else:
            assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
            assert rows[3] in kept and rows[8] in kept and rows[9] not in kept
            assert sum(not (t or "").strip() for _, t in kept) == 1
            assert (rows[1] in kept) == (name == "exact_dedup")
