"""Ranked search, licence scans and clustering against brute force, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from imgrel.llm import lexical, licenses, lloyd
from imgrel.llm.words import PIECE, word_lists

DOC = "doc_id long, text string, lang string, item_id string"
ITEM = "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def slow_search(docs, items, top=10):
    texts = [(i, TERM.findall(lower(t))) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = set()
    for item, terms in asked.items():
        found = []
        for i, t in texts:
            tf, m = Counter(t), 10 + (90 * len(t) * n_docs) // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m))
                for w in terms if tf[w]
            )
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        for rank, (score, none, i) in enumerate(sorted(found)[:top], 1):
            out.add((item, rank, None if none else i, -score))
    return out


def some_docs(seed, n=300):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.6)) % 400}" for _ in range(6000)] + ["Ñandú", "x-y", "ß", "A1"]
    docs = [(k, " ".join(draw.choice(words) for _ in range(draw.choice([1, 5, 30, 200])))) for k in range(n)]
    docs += [(k, docs[7][1]) for k in range(1000, 1040)]  # ties
    return docs + [(2000, None), (2001, ""), (2002, "... --"), (None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1])]


@pytest.mark.parametrize("block", [1 << 17, 100])
def test_search_is_brute_force(block, spark):
    docs = some_docs(3)
    items = [(k, " ".join(docs[k * 9][1].split()[:25])) for k in range(12)]
    items += [(50, None), (51, "nothing here at all"), (52, "w1"), (52, "w2 w1"), (None, docs[3][1]), (53, "ß ÑANDÚ Ñandú a1")]
    df = spark.createDataFrame([(i, t, "x", "clash") for i, t in docs], DOC).repartition(5)
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEM)
    found = lexical.search(df, asked, block_terms=block).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found) == Counter(slow_search(docs, items))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(1, "a b", "x", "y")], DOC)
    assert lexical.search(docs, items).collect() == [] == lexical.search(some, items).collect()
    assert lexical.search(docs, spark.createDataFrame([(1, "a", "z")], ITEM)).collect() == []
    # one document alone: ln(4 / 3) times 1000
    assert [tuple(r) for r in lexical.search(some, spark.createDataFrame([(1, "A", "z")], ITEM)).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 8 * 100)))]


def test_shards_of_any_size_give_the_same(spark, monkeypatch):
    docs = some_docs(4, 80)
    items = [(k, docs[k][1]) for k in range(10)]
    monkeypatch.setattr(lexical, "SHARD_DOCS", 7)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOC).coalesce(2)
    found = lexical.search(df, spark.createDataFrame([(i, t, "z") for i, t in items], ITEM), top=3).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found) == Counter(slow_search(docs, items, 3))


def test_wand_leaves_documents_out():
    draw = np.random.default_rng(1)
    lists = []
    for share, weight in ((0.9, 10), (0.5, 40), (0.02, 5000)):
        docs = np.flatnonzero(draw.random(20_000) < share)
        impacts = draw.integers(1, weight, len(docs))
        lists.append(lexical.Postings(docs.tolist(), impacts.tolist(), int(impacts.max())))
    total = np.zeros(20_000, np.int64)
    for p in lists:
        total[p.docs] += p.impacts
    best = []
    scored = lexical.wand(lists, list(range(20_000)), best, 10)
    assert [(-s, i) for s, _, i in best] == sorted(((int(s), i) for i, s in enumerate(total)), key=lambda x: (-x[0], x[1]))[:10]
    assert scored < 2000  # all but a tenth are never scored


def test_long_texts_are_read_whole():
    text = ("word, " * (PIECE // 3) + "LAST").encode()
    assert sum(map(len, word_lists(text))) == PIECE // 3 + 1
    assert lexical.counts_of(text)[b"last"] == 1
    assert [len(w) for w in word_lists(b"a" * (3 * PIECE))] == [1]


# --- licences


def slow_base(text):
    words, out = TERM.findall(lower(text)), []
    for phrase, label in licenses.BASE:
        wanted = phrase.split()
        out += [(k, label) for k in range(len(words)) if words[k : k + len(wanted)] == wanted]
    return len(words), sorted(out)


def least_edits(notice, text):
    """The fewest edits between the notice and any part of the text."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[0], 0
        for k, x in enumerate(notice, 1):
            above, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, above + (x != c))
        best = min(best, row[-1])
    return best


def edited(draw, text, edits):
    for _ in range(edits):
        k = draw.randrange(len(text))
        text = draw.choice([text[:k] + text[k + 1 :], text[:k] + draw.choice("abcxyzé") + text[k:], text[:k] + draw.choice("qwv7") + text[k + 1 :]])
    return text


def test_seeds_lose_no_match():
    draw, known = random.Random(5), licenses.Notices(licenses.NOTICES)
    hits = 0
    for _ in range(60):
        number = draw.randrange(len(licenses.NOTICES))
        notice = licenses.NOTICES[number][1]
        text = " ".join(["foo bar", edited(draw, notice, draw.randint(0, known.errors[number] + 2)), draw.choice(["", notice, "mit license"]), "baz qux"])
        text = " ".join(text.split())
        found = known.matches(text)
        for other, (_, words) in enumerate(licenses.NOTICES):
            least, mine = least_edits(words, text), [m for m in found if m.notice == other]
            assert bool(mine) == (least <= known.errors[other]), (text, words, least)
            whole = [(*m.span(), sum(m.fuzzy_counts)) for m in known.patterns[other].finditer(text)]
            assert [(m.start, m.end, m.edits) for m in mine] == whole
            hits += bool(mine)
    assert hits > 40


def test_scan_is_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = licenses.op11_licenses(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    labelled = 0
    for r in rows:
        n, places = slow_base(texts[r.doc_id])
        labels = {label for _, label in places}
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((places and min(places)[0]) or (0 if places else None), (max(places)[0] if places else None))
        assert labels <= set(filter(None, r.labels.split(","))) and (r.score > 0) == bool(r.labels)
        for s in r.spans:
            part = texts[r.doc_id][s.start : s.end]
            assert least_edits(s.notice, " ".join(TERM.findall(lower(part)))) <= s.edits + 2
            assert TERM.findall(lower(texts[r.doc_id]))[s.first_word : s.last_word + 1] == TERM.findall(lower(part))
        labelled += bool(r.labels)
    assert labelled >= 3


def test_scan_edges(spark):
    texts = [
        None, "", "...", "The MIT\nLicense; Mit-License mit licenses", "Licenced under the Apachee License, Version 2.0!",
        "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0 and more", "GNU General Public License mit license mit license",
        "released under the is license", "a" * 10_000 + " Released under teh MIT License " + "é " * 10_000,
        "Permission is hereby granted, free of charge, to any persons obtaining a copy of this software",
    ]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)] + [(3, texts[3], "x", "y")], DOC)
    rows = sorted(licenses.scan(docs).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(texts) + 1 and rows[3] == rows[4]
    rows = {r.doc_id: r for r in rows}
    for k in (0, 1, 2):
        assert (rows[k].n_words, rows[k].n_base, rows[k].first_word, rows[k].labels, rows[k].score, rows[k].spans) == (0, 0, None, "", 0.0, [])
    assert (rows[3].n_base, rows[3].first_word, rows[3].last_word, rows[3].base_labels, rows[3].score) == (2, 1, 3, "mit", 1.0)
    assert rows[4].labels == "apache" and rows[4].base_labels == "" and 0.9 < rows[4].score < 1 and rows[4].spans[0].edits == 2
    assert (rows[5].labels, rows[6].labels) == ("cc-by-sa", "cc-by")
    assert (rows[7].base_labels, rows[7].n_base) == ("gpl,mit", 3)
    assert rows[9].labels == "mit" and rows[9].n_base == 1 and rows[9].spans[0].edits == 2 and rows[9].spans[0].start == 10_001
    assert rows[10].labels == "mit" and rows[10].n_base == 0
    assert licenses.scan(spark.createDataFrame([], DOC)).collect() == []


# --- clustering


def slow_clusters(rows, clusters=8, rounds=10, length=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:clusters]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        owner = [near(q)[1] for _, q in kept]
        for k in range(len(centroids)):
            own = [q for (_, q), o in zip(kept, owner) if o == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    sums = Counter()
    for _, k, d in found:
        sums[k] += d
    return Counter(
        (i, k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in found
    )


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, q string")


def of_rows(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_are_brute_force(spark):
    draw = np.random.default_rng(2)
    rows = [(k, [float(x) for x in draw.normal(size=64) * 0.1 + (k % 11) * 0.02]) for k in range(150)]
    rows += [(1000 + k, rows[5][1]) for k in range(50)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [1.0] * 63 + [None]), (2005, [float("nan")] * 64), (2006, [float("inf")] + [0.0] * 63), (2007, [0.0] * 64)]
    assert of_rows(lloyd.cluster(vectors_of(spark, rows, "double"))) == slow_clusters(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(k, [float(k % 3)] * 64) for k in range(5)], [(k, [0.5] * 64) for k in range(20)]])
def test_few_or_equal_vectors(rows, spark):
    assert of_rows(lloyd.cluster(vectors_of(spark, rows), rounds=3)) == slow_clusters(rows, rounds=3)


def test_large_components_are_exact(spark):
    draw = np.random.default_rng(3)
    rows = [(k, [float(x) for x in draw.integers(-(2**14), 2**14, 64)]) for k in range(40)] + [(k + 100, [float(k)] * 64) for k in range(20)]
    assert of_rows(lloyd.cluster(vectors_of(spark, rows, "double"), rounds=3)) == slow_clusters(rows, rounds=3)
    huge = vectors_of(spark, rows + [(500, [1e308] * 64), (501, [-1e300] * 64)], "double")
    found = {r.vec_id: r for r in lloyd.cluster(huge, rounds=2).collect()}
    assert len(found) == 62 and found[500].inertia <= 2**63 - 1


def test_only_changed_centroids_are_compared():
    draw = np.random.default_rng(4)
    q = draw.integers(-500, 500, (400, 64))
    old = [list(map(int, r)) for r in q[:8]]
    owner, distance = lloyd.reassign(q, np.full(400, -1), np.full(400, -1), old, list(range(8)))
    new = [list(c) for c in old]
    new[3] = [x + 40 for x in new[3]]
    again, least = lloyd.reassign(q, owner, distance, new, [3])
    full = lloyd.squared_distances(q, new)
    assert (again == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
