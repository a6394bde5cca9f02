import numpy as np
import pyarrow as pa
import pytest

from lathe.llm import packing, pii
from lathe.llm.queries import TOKENIZER
from lathe.llm.texts import LibraryEncoder
from tests.llm.test_duplicates import brute_classes
from tests.llm.test_tokens import encoded

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spoken = corpus_pipeline.language(spark, docs, sf_dir)
    assert spoken.schema == docs.schema and spoken.count() >= 0.97 * docs.count()
    first = {}
    for r in sorted(spoken.collect(), key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    rows = [(d, t) for t, d in first.items()]
    texts = dict(rows)
    left = {g[0]: texts[g[0]] for g in brute_classes(rows)}
    want = sorted((d, encoded(pii.replaced(t, pii.find_spans(t)), 0)) for d, t in left.items())
    found: dict = {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r.start):
        found.setdefault(r.doc_id, []).append(r)
    assert sorted((d, b"".join(p.ids for p in pieces)) for d, pieces in found.items()) == want
    places = np.sort([p.sequence_id * 1024 + p.offset for ps in found.values() for p in ps])
    assert places[0] == 0 and len(set(places)) == len(places)


def test_stages_take_odd_rows(spark, odd, empty, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "personal_data", "sequences"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        assert out.count() > 0 and stage(spark, empty, sf_dir).count() == 0
        if name != "sequences":
            assert out.columns == odd.columns


def test_sequences_keep_few_matches(spark, odd):
    """Workers of the last stage keep what packing bounds, not the larger cache of id files."""
    corpus_pipeline.sequences(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), "").count()
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "512"

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([e.keep for key, e in LibraryEncoder._made.items() if key == (TOKENIZER, packing.KEEP)], pa.int64())})

    found = {r.n for _ in range(5) for r in spark.range(0, 40, 1, 8).mapInArrow(kept, "n long").collect()}
    assert found == {packing.KEEP} and packing.KEEP <= 200_000
