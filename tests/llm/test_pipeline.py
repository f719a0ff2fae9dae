import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from conftest import SF
from helpers import words
from test_dedup import plain_lines, plain_near

import corpus_pipeline as pipeline
from catalox.llm import mixing, quality


def test_stages_against_brute_force(spark):
    """Each stage on what the one before left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    read = lambda df: {r.doc_id: r for r in df.collect()}
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    held = docs
    for name, stage in pipeline.STAGES:
        before = read(held)
        done = stage(spark, held, SF).cache()
        if name != "packing":
            after = read(done)
            assert done.columns == pipeline.COLUMNS and (name == "mixing" or done.count() == len(after))
        if name == "quality":
            kept = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
            assert set(after) == kept and all(after[i] == before[i] for i in kept)
        elif name == "line_dedup":
            want = plain_lines([(i, r.text) for i, r in before.items()], 10)
            assert {i: r.text for i, r in after.items()} == {i: t for i, (_, t) in want.items()}
            assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source) for i, r in after.items())
        elif name == "near_dedup":
            want = plain_near([(i, r.text) for i, r in before.items()], 5)
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
        elif name == "mixing":
            taken = mixing.mix(held).collect()
            assert mixing.MAX_EPOCHS > 1
            want = []
            for r in taken:
                w = words(before[r.doc_id].text)
                want.append((r.doc_id, before[r.doc_id].text if r.taken == r.tokens == len(w) else " ".join(w[: r.taken])))
            assert sorted((r.doc_id, r.text) for r in done.collect()) == sorted(want)
        else:
            pieces = done.collect()
            assert {r.doc_id for r in pieces} == set(before)
        held = done


def test_mixture_keeps_every_epoch(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(10)), "en" if i < 36 else "es", "src0", 29) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    drawn = mixing.mix(docs, max_epochs=3).collect()
    assert {r.epoch for r in drawn if r.lang == "es"} == {0, 1, 2}
    got = pipeline.mixture(spark, docs, SF, max_epochs=3).collect()
    assert sorted((r.doc_id, len(words(r.text))) for r in got) == sorted((r.doc_id, r.taken) for r in drawn)


def test_null_and_empty(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (None, "a b", "en", "src0", 3), (3, "some words that stay", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        held = table
        for _, stage in pipeline.STAGES:
            held = stage(spark, held, SF)
        held.collect()


def test_odd_rows(spark):
    """Repeated rows and ids, equal texts, a very long text and columns with the stages' own names: no stage fails or loses a kept id."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "src0", 1), (1, text, "en", "src0", 1), (2, text, "en", "src0", 1), (3, "a b c d e\nshared", "en", "src0", 1), (3, "other text here\nshared", "de", None, 2), (4, " ".join(f"x{i % 5000}" for i in range(200_000)), "en", "src3", 3)]
    clash = ["id", "rep", "kept", "lang_", "epoch", "taken", "piece", "block", "h"]
    docs = spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    held, seen = docs, []
    for name, stage in pipeline.STAGES:
        held = stage(spark, held, SF).cache()
        seen.append({r.doc_id for r in held.collect()})
        if name != "packing":
            assert held.columns == pipeline.COLUMNS
    assert seen[0] == seen[1] == {1, 2, 3, 4} and seen[2] == {1, 3, 4}
    assert seen[3] <= seen[2] and seen[4] == seen[3]
