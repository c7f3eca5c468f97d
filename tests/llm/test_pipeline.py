"""The pipeline against the brute-force operators, and the registered queries."""

import collections
import sys

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import WORD, near_duplicates, remove_repeats, sha, targets

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402

from twinstage.llm import bpe, catalog, quality  # noqa: E402
from twinstage.llm.common import stored  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def extra_rows(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = [(-1, None, "en", "src0", None), (-2, "", None, None, 0), (900, d.first().text, "en", "src1", 5), (None, "a b", "xx", "s", 3)]
    return d.union(spark.createDataFrame(more, d.schema))


def test_stages(spark):
    docs = extra_rows(spark)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        out[name] = (before, docs.collect())
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = out["quality"]
    verdict = {r.doc_id: r.kept for r in quality.judge_quality(extra_rows(spark)).collect()}
    assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if verdict[r.doc_id])
    before, after = out["near_dups"]
    want = near_duplicates([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted({c for _, n, c in want if n})
    before, after = out["repeats"]
    want = {r[0]: r[4].decode("utf-8", "ignore") for r in remove_repeats([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    before, after = out["mix"]
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in after:
        taken[r.source] += len(WORD.findall(r.text))
    top = max(len(WORD.findall(r.text)) for r in before)
    assert all(abs(taken[s] - t) <= top for s, t in targets(sizes).items())
    before, after = out["encode"]
    ranks = bpe.load_ranks(public_tokenizers.path(catalog.RANKS))
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        ids = truth.encode_ordinary(texts[r.doc_id])
        assert r.input_ids == ids and r.ids_sha256 == sha(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, name, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    got = stage(spark, docs, SMALL)
    assert got.count() == 0 and (name == "encode" or got.columns == docs.columns)


def test_registered_names():
    import __spark_entry__ as entry
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op")}
    assert "pipeline" in names and "op5_urls" in entry.oracle_sql()
