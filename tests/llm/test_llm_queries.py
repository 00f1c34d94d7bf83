"""The registered queries against their SQL, and the pipeline against its parts."""

import re

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from imgrel.llm import exact, quality, queries
from imgrel.llm.packing import FastIds
from imgrel.llm.bpe import default_path


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    found = sorted(map(str, df.select(*sorted(df.columns)).collect()))
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    rows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert found == sorted("Row(" + ", ".join(f"{c}={r[c]!r}" for c in sorted(r)) + ")" for r in rows)


def test_pipeline_is_its_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shapes = quality.Shapes()
    kept = [r for r in docs.orderBy("doc_id").collect() if model.score(shapes.features(r.text)) >= quality.THRESHOLD]
    groups = {}
    for r in kept:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    kept = sorted((max(g, key=lambda r: (len(r.text or ""), -r.doc_id)) for g in groups.values()), key=lambda r: r.doc_id)

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        parts = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        bits = np.zeros(64, int)
        for p in parts:
            bits += xxhash.xxh64_intdigest(p.encode(), 42) >> np.arange(64, dtype=np.uint64) & np.uint64(1) == 1
        return sum(1 << k for k in range(64) if 2 * bits[k] > len(parts))

    fps, root = [fingerprint(r.text) for r in kept], list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    ids = {kept[x].doc_id for x in root}
    found = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(found["doc_id"]) == ids
    assert found.groupby("sequence_id")["length"].sum().max() <= 2048
    tokenize, texts = FastIds(default_path()), {r.doc_id: r.text for r in kept}
    clean = [i for i in ids if not re.search("[0-9@]", texts[i] or "")]
    counts = found.groupby("doc_id")["doc_tokens"].max()
    assert clean and all(counts[i] == len(tokenize(texts[i] or "")) + 1 for i in clean)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "quality":
            assert stage(spark, docs, sf_dir).columns == docs.columns


def test_index_folder_is_bucketed(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "i"), buckets=4)
    exact.deduplicate(spark.createDataFrame([(1, "a")], "doc_id long, text string"), index)
    plan = spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()
    assert any(r.col_name == "Num Buckets" and r.data_type == "4" for r in plan)
