"""The pipeline on a small planted corpus."""

import random

import pytest

import corpus_pipeline
from lodestone.llm import minhash, packing


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(17)
    sf = str(tmp_path_factory.mktemp("sf"))
    text = lambda n=80: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    docs = [(i, text()) for i in range(200)]
    docs += [(300 + i, text(40) + f" {rng.choice(['idiot', 'moron'])} scum pathetic " + text(40)) for i in range(40)]
    docs += [(400, docs[0][1]), (401, docs[1][1] + " tail"), (402, docs[2][1].upper())]
    item = text(30)
    docs += [(500, text(20) + " " + item + " " + text(20)), (600, text(30) + " token=Zx81kfu3mQpw92LsDv " + text(5))]
    spark.createDataFrame([(i, t, "en", f"src{i % 7}", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(300 <= i < 340)) for i, _ in docs if i < 500], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, dict(docs)


def test_each_stage_does_its_part(spark, planted):
    sf, texts = planted
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    clean = set(range(200))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        path = f"{sf}/out-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert clean <= set(kept[name])
    assert not set(range(300, 340)) & set(kept["toxicity"]) and {400, 401, 402, 500, 600} <= set(kept["toxicity"])
    assert set(kept["near_dedup"]) == set(kept["toxicity"]) - {400, 401, 402}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - {500}
    assert "[SECRET]" in kept["secrets"][600] and "Zx81" not in kept["secrets"][600] and all(kept["secrets"][i] == texts[i] for i in clean)
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted({d for r in bins for d in r["doc_ids"]}) == sorted(kept["secrets"])
    assert sum(r["used"] for r in bins) == sum(len(t.encode()) for t in kept["secrets"].values())
    held = b"".join(bytes(r["payload"]) for r in bins)
    assert b"token" not in held and held.count(b"[SECRET]") == 1 and all(len(r["payload"]) == r["used"] for r in bins)
    ran = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["bin_id"] for r in ran) == sorted(r["bin_id"] for r in bins)
    assert minhash.BANDS == 40 and packing.CAPACITIES[-1] == 8192


def test_empty_documents_end_at_the_packing_stage(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, ""), (3, None), (4, "more")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in packing.plan(docs).where("bin_id is null").collect()) == [2, 3]
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert sorted(d for r in bins.collect() for d in r["doc_ids"]) == [1, 4]
    assert "empty or null text" in packing.sequences.__doc__


def test_nulls_repeats_and_long_texts_pass_every_stage(spark, tmp_path):
    """What the docstring of the pipeline states of odd rows, stage by stage."""
    rng = random.Random(23)
    text = lambda n=60: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, long = text(), text(), text(30_000)
    rows = [(1, a), (1, a), (5, a), (5, b), (6, b), (7, ""), (7, None), (None, text()), (None, None), (8, long), (9, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert kept["toxicity"] == sorted((i or 0, t or "") for i, t in rows)
    without = [(1, a), (5, a), (6, b)]
    want = list(kept["toxicity"])
    for row in without:
        want.remove(row)
    assert kept["near_dedup"] == want == kept["secrets"] and (5, b) in want
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r["used"] for r in bins) == sum(len(t.encode()) for _, t in want) and all(len(r["payload"]) == r["used"] for r in bins)


def test_nothing_goes_through_every_stage(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
