"""The pipeline's stages, one after the other, on odd rows, clashing names and empty tables, and on planted documents."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
CLASH = "toxicity double, mix_copy int, line_dedup_lines long, near_copy long, pii_entities int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(300):
        toxic = i % 10 == 0
        rows.append((i, text(40) + (" you stupid idiot moron, shut up idiot " * 3 if toxic else ""), "en", f"s{i % 3}"))
    base, line = text(120), " ".join(rng.choices(words, k=12))
    near = base.split()
    near[60] = "changed"
    odd = [(400, base, "en", "s0"), (401, base, "en", "s0"), (402, " ".join(near), "en", "s1"), (403, None, None, None), (404, "", "en", "s1"), (405, f"{line}\nfirst words here", "en", "s2"), (406, f"other words\n{line}", "en", "s2"), (407, text(15_000), "en", "s0")]
    full = [(*r, None if r[1] is None else len(r[1]), 0.5, 7, 8, 9, 1) for r in rows + odd]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def stages(spark, folder, docs):
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/out-{name}-{random.random()}"
        docs.write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    from riftline.llm import bpe

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stages(spark, folder, docs)
    for name in ("toxicity", "line_dedup", "near_dedup", "mixing"):
        assert out[name].columns == docs.columns and [f.dataType for f in out[name].schema] == [f.dataType for f in docs.schema]
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in out.items()}
    clean = set(range(300)) - set(range(0, 300, 10))
    odd = set(range(400, 408))
    assert ids["toxicity"] >= clean | odd and len(ids["toxicity"] & set(range(0, 300, 10))) <= 3
    kept = {r.doc_id: r for r in out["line_dedup"].collect()}
    assert set(kept) == ids["toxicity"] - {401} and kept[406].text == "other words" and kept[406].n_chars == 11 and kept[403].text is None
    assert ids["near_dedup"] == ids["line_dedup"] - {402}
    taken = out["mixing"].groupBy("doc_id").count()
    assert ids["mixing"] <= ids["near_dedup"] and taken.agg(F.max("count")).first()[0] <= 2
    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in out["mixing"].collect())
    assert sorted((r.doc_id, r.n_tokens) for r in out["encoding"].collect()) == want
    run = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.ids_sha256) for r in run.collect()) == sorted((r.doc_id, r.ids_sha256) for r in out["encoding"].collect())


def test_empty_documents(spark, folder):
    out = stages(spark, folder, spark.read.parquet(f"{folder}/documents.parquet").limit(0))
    assert all(df.count() == 0 for df in out.values())
