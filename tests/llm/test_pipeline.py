"""The pipeline, stage by stage, against brute-force versions on the smallest tables."""

from pathlib import Path

from test_operators import SF, brute_classes, brute_hits, check_packing

import corpus_pipeline
from ledgerloom.llm import queries
from ledgerloom.llm.common import materialize



def test_every_stage_by_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = materialize(stage(spark, docs, SF), "test")
        after = docs.collect()
        kept = {r.doc_id for r in after}
        if name == "packing":
            tokenizer = Tokenizer.from_file(queries.tokenizer_path())
            check_packing(after, {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in before})
            continue
        assert docs.columns == columns
        if name == "language ID":
            assert len(kept) > 0.95 * len(before)
        elif name == "quality classifier":
            held = [d for d, _ in before if d in labels]
            assert sum((d in kept) == bool(labels[d]) for d in held) > 0.95 * len(held)
        elif name == "n-gram Jaccard join":
            assert kept == {c for _, c in brute_classes(before, 5, 80).values()} and len(after) == len(kept)
        else:
            assert kept == {h[0] for h in brute_hits(before, bench) if not h[5]}


def test_repeated_rows_and_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = corpus_pipeline.distinct(spark, docs.limit(20).unionByName(docs.limit(20)), SF)
    assert twice.count() == twice.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_repeated_and_missing_ids_are_documents_by_their_texts(spark):
    """Unrelated texts under one id both stay; copies, exact and near, of rows with and without an id go; clashing columns stay."""
    import random

    draw = random.Random(2)
    text = lambda: [f"word{draw.randrange(10**6)}" for _ in range(80)]
    one, two, three, four = text(), text(), text(), text()
    near = [*two]
    near[40] = "edited"
    rows = [(1, one), (1, two), (None, near), (None, three), (None, three), (5, three), (7, four), (8, four), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, " ".join(t) if t else t, "en", "s", 0, "x", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, component_id string, score double")
    kept = corpus_pipeline.distinct(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "")[:20]) for r in kept.collect())
    head = lambda t: " ".join(t)[:20]
    assert len(got) == 6 and ("1", head(one)) in got and ("1", head(two)) in got and ("5", head(three)) in got and ("7", head(four)) in got


def test_stages_on_odd_rows(spark):
    """Null, empty, very long and tied texts, repeated rows and clashing names pass all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [tuple(r) for r in docs.limit(30).collect()]
    long = " ".join(base[0][1].split() * 2000)[:3_000_000]
    rows = [*base, *base[:5], (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, long, "en", "s", 1), (None, base[3][1], "en", "s", 1), (9004, "1 2 3 4", "en", "s", 7)]
    wide = spark.createDataFrame([(*r, "a", 1, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, n int, quality_score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        wide = materialize(out, "odd")
    pieces = corpus_pipeline.packed(spark, wide, SF)
    assert sum(r.length for r in pieces.collect()) > 0


def test_written_tables_are_data_only(spark):
    out = materialize(spark.range(10), "bare")
    names = [p.name for p in Path(out._loom_path.removeprefix("file://")).iterdir() if not p.name.endswith(".crc")]
    assert names and all(n.startswith("part-") for n in names)
    assert out.count() == 10
