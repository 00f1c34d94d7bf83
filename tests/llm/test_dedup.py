"""Exact, near and line dedup, and vectors, against brute force and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from imgrel.llm import exact, lines, simhash, vectors
from imgrel.llm.shared import components, merge_labels

SPACE = r"[\x20\x09-\x0D]"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three"), (6, "ONE two  three"), (7, "x" * 200_000), (8, "a b c d e f g"),
    (9, "a b c d e f g"), (9, "a b c d e f g"), (None, "lone"), (12, "é à ü ö ß"), (13, "one\x0btwo\x0cthree"),
]


def docs(spark, rows):
    # names that the operators use themselves must not disturb them
    return spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, fp string, label int, kept boolean")


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(99, k) for k in range(50)],
    [(5, 5), (7, 3), (3, 7), (3, 9)], [(k, (k * 7) % 40) for k in range(40)],
])
def test_components(spark, edges):
    found = components(spark.createDataFrame(edges, "a long, b long"))
    edges = [(a, b) for a, b in edges if a != b]
    assert {r.node: r.component for r in found.collect()} == groups_of(edges, {n for e in edges for n in e})


def test_merge_labels():
    rng = np.random.default_rng(3)
    for _ in range(30):
        i, j = rng.integers(0, 40, (2, 25))
        labels = np.arange(40)
        merge_labels(labels, i, j)
        want = groups_of(zip(i.tolist(), j.tolist()), range(40))
        assert labels.tolist() == [want[k] for k in range(40)]


def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_of_odd_rows(spark):
    found = simhash.simhash_groups(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    want = {t: slow_fingerprint(t) for _, t in ODD}
    ids = {}
    for i, t in ODD:
        ids.setdefault(want[t], []).append(i)
    for r in found:
        assert r.fp % (1 << 64) in ids
    by_id = {r.doc_id: r.component_id for r in found}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[9] == 8 and by_id[13] == by_id[5] == by_id[6] == 5
    assert by_id[None] is None
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def test_simhash_links_all_within_four_bits(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for fp in list(fps)[:150]:
        for _ in range(3):
            near = fp
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                near ^= 1 << bit
            fps.add(near)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    fps = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 4]
    want = groups_of(pairs, fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    # plain cells, pairs of blocks, cells split by other segments, and parts of these dealt into blocks
    for block, hot in ((2048, 2048), (16, 9999), (8, 8), (3, 0)):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, block=block, hot=hot).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in edges)
        assert groups_of(edges, fps) == want


def test_keep_one_of_each_near_group(spark):
    text = " ".join(f"w{k}" for k in range(300))
    df = docs(spark, [(1, text), (2, text), (3, "something else entirely here"), (4, text + " end")])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert {3} < {r.doc_id for r in kept.collect()} and 2 not in {r.doc_id for r in kept.collect()}


def test_keep_one_judges_rows_not_ids(spark):
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "quite another text that nothing else is like"), (None, "a b c d e"), (None, "a lone text without an id, long enough"),
            (7, None), (None, ""), (8, "the same row twice in the table"), (8, "the same row twice in the table")]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[4], (7, None), rows[7]], key=str)
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_exact_dedup_of_odd_rows(spark):
    found = exact.deduplicate(docs(spark, ODD), exact.DigestIndex(spark)).collect()
    assert len(found) == len(ODD)
    by_digest = {}
    for r in found:
        by_digest.setdefault(bytes(r.digest), []).append(r)
    for i, t in ODD:
        assert hashlib.sha256(re.sub(SPACE, "", t or "").encode()).digest() in by_digest
    assert all(sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)} for rows in by_digest.values())
    kept = {r.doc_id for r in found if r.kept}
    assert 3 in kept and 1 not in kept and 2 not in kept  # most code points stay
    assert 8 in kept and 5 in kept and 13 not in kept and None in kept
    assert exact.deduplicate(docs(spark, []), exact.DigestIndex(spark)).count() == 0


def test_second_batch_is_held_against_the_index(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first = exact.keep_first(docs(spark, [(1, "a b"), (2, "ab"), (3, "c"), (3, "c")]), index).collect()
    assert sorted(r.doc_id for r in first) == [1, 3]
    again = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    second = exact.keep_first(docs(spark, [(7, "a\tb"), (8, "d")]), again)
    assert [r.doc_id for r in second.collect()] == [8]
    assert second.columns == ["doc_id", "text", "fp", "label", "kept"]
    assert again.table().count() == 3


def test_a_batch_may_be_given_again(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    rows = docs(spark, [(1, "a b"), (2, "ab"), (None, "c"), (None, "c"), (3, None), (3, ""), (3, "q")])
    first = sorted(map(str, exact.keep_first(rows, index, "monday").collect()))
    assert len(first) == 4 and sorted(map(str, exact.keep_first(rows, index, "monday").collect())) == first
    assert index.table().count() == 4
    # a job that was lost after half of its batch had been appended
    other = docs(spark, [(9, "x"), (10, "y"), (11, "c")])
    exact.deduplicate(other.where("doc_id = 9"), index, "tuesday")
    assert sorted(r.doc_id for r in exact.keep_first(other, index, "tuesday").collect()) == [9, 10]
    assert exact.keep_first(rows, index, "wednesday").count() == 0
    index.compact()
    again = exact.DigestIndex(spark, str(tmp_path / "index"))
    assert again.buckets == 4 and again.table().count() == 6 and len(again.table().inputFiles()) <= 4
    assert sorted(map(str, exact.keep_first(rows, again, "monday").collect())) == first
    assert exact.keep_first(other, again, "thursday").count() == 0


def slow_passages(rows):
    """Kept lines by (doc_id, text): all runs of two lines of text in the order of places, by comparing them."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, lines_hash(r[1])))
    first, out = {}, {}
    for row in order:
        parts = row[1].split("\n")
        solid = [k for k, line in enumerate(parts) if re.search(r"\S", line, re.A)]
        drop = set()
        for a, b in zip(solid, solid[1:]):
            where = first.setdefault(tuple(parts[a : b + 1]), (row, a))
            if where[0] != row or a - where[1] > b - a:
                drop |= set(range(a, b + 1))
        out[row] = "\n".join(x for k, x in enumerate(parts) if k not in drop)
    return out


def lines_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def check_passages(rows, found):
    want = slow_passages(rows)
    assert len(found) == len(rows)
    assert sorted(str((r.doc_id, r.text)) for r in found) == sorted(str((i, None if t is None else want[i, t])) for i, t in rows)
    left = {x for r in found if r.text for x in r.text.split("\n")}
    assert {x for _, t in rows if t for x in t.split("\n") if x.strip()} <= left  # no line is lost everywhere
    return want


def test_passages_are_brute_force(spark):
    rng = random.Random(3)
    passages = [[f"line {rng.random()}" for _ in range(n)] for n in (2, 2, 3, 4, 6, 8)]
    passages[3][2] = ""
    rows = [(1, None), (2, ""), (3, "one line"), (4, "\n\n\n"), (5, "\n\n\n"), (6, "a\n" * 7), (7, "a\nb\n" * 4), (8, "a\n\nb"), (9, "lone\n"), (10, "lone\n")]
    for i in range(11, 80):
        own = [f"own {i} {k}" for k in range(rng.randint(0, 6))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + rng.choice(passages) + own[at:])))
    rows += [(80, rows[-1][1]), (80, rows[-1][1]), (None, "u\nv\n" + rows[20][1]), (None, "u\nv\nw"), (None, "x\ny"), (80, "x\ny\nz")]
    found = lines.dedup_passages(docs(spark, rows)).collect()
    check_passages(rows, found)
    assert sum(r.n_removed for r in found) > 150
    assert {r.doc_id: r.text for r in found if r.doc_id in (9, 10)} == {9: "lone\n", 10: "lone\n"}
    assert lines.dedup_passages(docs(spark, [])).count() == 0


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def slow_chunks(text, gap):
    """Chunks again, as ``(first line, last line)``; Spark's hash of an int and two longs is chained by seeds."""
    hashes = []
    for line in text.split("\n"):
        h = (xxhash.xxh64_intdigest(line.encode(), 42) << 1) & (1 << 64) - 1
        hashes.append(signed(h | 1 if re.search(r"\S", line, re.A) else h))
    solid = [k for k, h in enumerate(hashes) if h & 1]

    def chosen(k, side):
        h = xxhash.xxh64_intdigest(side.to_bytes(4, "little"), 42)
        for x in (hashes[solid[k]], hashes[solid[k + 1]]):
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
        return signed(h) % gap != 0

    out = []
    for k in range(len(solid) - 1):
        if chosen(k, 0):
            end = k + 1
            while end < len(solid) - 1 and end < k + lines.MOST and not chosen(end - 1, 1):
                end += 1
            out.append((solid[k], solid[end]))
    return out


def slow_anchored(rows, gap):
    """Kept lines by row: chunks find earlier places, what is equal around them goes."""
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0, lines_hash(r[1])))
    first, out = {}, []
    parts_of = [r[1].split("\n") for r in order]
    found = []
    for n, parts in enumerate(parts_of):
        for at, until in slow_chunks(order[n][1], gap) if "\n" in order[n][1] else []:
            where = first.setdefault(tuple(parts[at : until + 1]), (n, at))
            if where[0] != n or at - where[1] > until - at:
                found.append((n, where[0], at - where[1]))
    drop = [set() for _ in order]
    for a, b, shift in set(found):
        mine, theirs = parts_of[a], parts_of[b]
        same = [0 <= i - shift < len(theirs) and mine[i] == theirs[i - shift] for i in range(len(mine))]
        solid = [i for i in range(len(mine)) if re.search(r"\S", mine[i], re.A)]
        for i, j in zip(solid, solid[1:]):
            if all(same[i : j + 1]) and (a != b or j - i < shift):
                drop[a] |= set(range(i, j + 1))
    return sorted(str((r[0], "\n".join(x for k, x in enumerate(p) if k not in d))) for r, p, d in zip(order, parts_of, drop))


@pytest.mark.parametrize("gap", [2, 3, 16])
def test_anchored_passages_are_brute_force(spark, gap):
    rng = random.Random(gap)
    passages = [[f"line {rng.random()}" for _ in range(n)] for n in (2, 3, 4, 6, 8, 30)]
    passages[3][2] = " "
    rows = [(1, None), (2, ""), (3, "one line"), (4, "\n\n\n"), (6, "a\n" * 7), (7, "a\nb\n" * 4), (8, "a\n\nb"), (9, "a\n\na\n\na\n\na\nc")]
    for i in range(11, 60):
        own = [f"own {i} {k}" for k in range(rng.randint(0, 6))]
        at = rng.randint(0, len(own))
        passage = rng.choice(passages)
        start = rng.randint(0, len(passage) - 2)
        rows.append((i, "\n".join(own[:at] + passage[start:] + own[at:])))
    rows += [(80, rows[-1][1]), (None, "u\nv\n" + rows[20][1]), (None, "u\nv\nw"), (80, "x\ny\nz")]
    found = lines.dedup_passages(docs(spark, rows), gap=gap).collect()
    assert sorted(str((r.doc_id, r.text)) for r in found if r.text is not None) == slow_anchored(rows, gap)
    assert len(found) == len(rows) and sum(r.n_removed for r in found) > 20
    left = {x for r in found if r.text for x in r.text.split("\n")}
    assert {x for _, t in rows if t for x in t.split("\n") if x.strip()} <= left


def test_query_finds_most_repeated_runs_of_the_table(spark, sf_dir):
    """Recall of the query against an independent search for repeated line runs."""
    from imgrel.llm import queries

    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, found = slow_passages(table), queries.queries()["op5_lines"](spark, sf_dir).collect()
    texts, gone, repeated = dict(table), 0, 0
    for r in found:
        if r.text is not None:
            whole, least = texts[r.doc_id].count("\n"), want[r.doc_id, texts[r.doc_id]].count("\n")
            repeated += whole - least
            gone += whole - r.text.count("\n")
    assert len(found) == len(table) and repeated and 0.9 * repeated <= gone <= repeated
    left = {x for r in found if r.text for x in r.text.split("\n")}
    assert {x for _, t in table if t for x in t.split("\n") if x.strip()} <= left


def slow_vectors(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [
        (a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :]
        if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95
    ]
    return pairs, groups_of(pairs, [i for i, _ in rows])


@pytest.mark.parametrize("max_homes", [4096, 7])
def test_vectors_are_brute_force(spark, max_homes):
    rng = np.random.default_rng(2)
    rows = [(1, None), (2, []), (3, [0.0] * 16), (4, [1.0, None] + [0.0] * 14), (5, [float("nan")] * 16), (6, [float("inf")] * 16)]
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(100 * (c + 1) + k, (centre + rng.normal(size=16) * s).tolist()) for k, s in enumerate([0.0, 0.0, 0.1, 0.2, 0.25, 0.3, 0.5])]
    dense = rng.normal(size=16)
    rows += [(5000 + k, (dense + rng.normal(size=16) * 0.15).tolist()) for k in range(60)]
    rows += [(6000 + k, rng.normal(size=4).tolist()) for k in range(40)] + [(7000, [1.0]), (7001, [2.0]), (7002, [-1.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, component_id int")
    found = vectors.near_vectors(df, max_homes=max_homes).collect()
    pairs, want = slow_vectors(rows)
    assert len(found) == len(rows) and len(pairs) > 500
    assert {r.vec_id: r.component_id for r in found} == want
    counts = {i: 0 for i, _ in rows}
    for a, b in pairs:
        counts[a] += 1
        counts[b] += 1
    assert {r.vec_id: r.n_links for r in found} == counts


@pytest.mark.parametrize("length", [2048, 4097, 40_000, 70_000])
def test_long_vectors(spark, length):
    """Whatever the length, links are those of brute force; beyond ``MAX_LENGTH`` there is one block."""
    rng = np.random.default_rng(length)
    centre = rng.normal(size=length)
    rows = [(k, (centre + rng.normal(size=length) * s).astype(np.float32).tolist()) for k, s in enumerate((0.0, 0.15, 0.3))]
    rows += [(10, (2 * centre).astype(np.float32).tolist())] + ([(11, rng.normal(size=length).tolist())] if length > 4000 else [])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pairs, want = slow_vectors(rows)
    found = vectors.near_vectors(df, max_homes=2).collect()
    assert {r.vec_id: r.component_id for r in found} == want
    assert {r.vec_id: r.n_links for r in found} == {i: sum(i in p for p in pairs) for i, _ in rows}


def test_cells_of_any_length_have_keys_of_their_own():
    for length in (40_000, 65_536, 1 << 20):
        space = vectors.Subspaces(length, 0.95)
        assert space.blocks == 1 and space.grid == 0
    keys = {k for rows, k, _ in vectors.Subspaces(4096, 0.95).cells(np.zeros((1, 4096))) for k in k.tolist()}
    assert max(keys) < 1 << 35


def test_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(df).count() == 0


def test_repeated_vectors_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    found = sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in vectors.near_vectors(df).collect())
    assert found == [(-1, 0, -1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
