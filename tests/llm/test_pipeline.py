"""The pipeline: each stage does what it says, on the tables and on edge cases."""

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sumweave.llm import _common, near_copies, packing
from sumweave.llm.queries import documents, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_on_tables(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert before > 0.6 * documents(spark, SF).count()
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before
    assert cp.run(spark, SF).count() == packed.count()


def test_tokens_of_all_documents_are_in_the_sequences(spark):
    docs = documents(spark, SF).limit(60).cache()
    packed = cp.STAGES[-1][1](spark, docs, SF).cache()
    held = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.sequences(packed).collect()}
    found = {}
    for r in packed.orderBy("start").collect():
        found.setdefault(r.doc_id, []).extend(held[r.sequence_id][r.offset : r.offset + r.length].tolist())
    encode = packing.WordTokenizer(tokenizer_path()).whole
    assert found == {r.doc_id: [*np.frombuffer(encode(r.text or ""), "<u4").tolist(), 1] for r in docs.collect()}


def test_copies_and_benchmark_go(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = documents(spark, SF).filter("length(text) > 1500").limit(3).collect()
    kind = documents(spark, SF).schema
    rows = [(i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(clean)]
    rows += [(10, clean[0].text, "en", None, None), (11, bench + " " + bench, "en", None, None), (12, None, None, None, None), (13, "?!", None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    ids = {r.doc_id for r in docs.collect()}
    assert ids.isdisjoint({10, 11, 12, 13})
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_equal_ids_with_other_texts_stay(spark):
    kind = documents(spark, SF).schema
    texts = [" ".join(f"{x}{i}" for i in range(300)) for x in "ab"]
    rows = [(1, texts[0], "en", "s", 9), (1, texts[1], "en", "s", 9), (1, texts[1], "en", "s", 9), (2, texts[0], "en", "s", 9)]
    kept = cp.drop_near_duplicates(spark, spark.createDataFrame(rows, kind), SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, texts[0]), (1, texts[1])]


def test_clashing_columns_and_broken_texts(spark):
    """Columns named as the operators name theirs come out as they went in, and a text that is no UTF-8 stops nothing."""
    base = documents(spark, SF).filter("text IS NOT NULL AND lang IS NOT NULL").limit(40)
    extra = ["_new", "_key", "score", "kept", "rejected", "lang_pred", "key", "row", "first", "covered", "items", "hits"]
    docs = base.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in extra})
    bad = docs.limit(1).withColumns({"doc_id": F.lit(7_000_000).cast("long"), "text": F.expr("CAST(X'636166e920ff20776f726473' AS STRING)"), **{c: F.lit(f"{c} of 7000000") for c in extra}})
    docs = docs.unionByName(bad).cache()
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        for r in docs.drop("text").collect():
            assert all(r[c] == f"{c} of {r.doc_id}" for c in extra), name
    assert cp.STAGES[-1][1](spark, docs, SF).count() >= docs.count() > 20


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [128, 5])
def test_edited_copies_go_and_clean_texts_stay(spark, block):
    rng = np.random.default_rng(5)
    texts = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (150, 220, 300, 400, 600, 900)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        for c in range(20):  # each edited word changes five shingles
            own = list(t)
            for at in rng.choice(len(t), max(1, int(len(t) * rng.uniform(0.003, 0.05))), replace=False):
                own[at] = f"new{rng.integers(1 << 30)}"
            rows.append((100 * (i + 1) + c, " ".join(own)))
    link = {i: i for i, _ in rows}
    edited = 0
    for i, a in rows:
        for j, b in rows:
            if i < j and (s := jaccard(a, b)) >= 0.8:
                edited += s <= 0.95
                old, new = link[j], link[i]
                link = {k: new if v == old else v for k, v in link.items()}
    least = {}
    for i, v in link.items():
        least[v] = min(i, least.get(v, i))
    assert edited > 100 and len(least) > len(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], documents(spark, SF).schema)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, block=block).collect()}
    assert got == {i: least[v] for i, v in link.items()}
    if block == 128:
        assert {r.doc_id for r in cp.drop_near_duplicates(spark, docs, SF).collect()} == set(least.values())


def test_empty(spark):
    docs = documents(spark, SF).limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.filter(F.lit(True)).count() == 0


def test_batches_to_python_are_bounded(spark):
    """A task's memory doesn't grow with the texts: 15 MB of them reach Python in several batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    spark.conf.unset(key)
    try:
        packed = cp.pack_sequences(spark, docs, "")
        assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 5 << 20
        assert packed.agg(F.sum("length")).first()[0] == 3000 * 1001
        spark.conf.set(key, "1m")
        _common.small_batches(spark)
        assert spark.conf.get(key) == "1m"  # a session that asks for less gets that
    finally:
        spark.conf.unset(key)
