"""The mix moves whole rows once, and not in an order."""

import collections

from twinstage.llm import mixing


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_own_keys_are_neither_sorted_nor_counted_again(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "ab"[i % 2]) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = collections.Counter()
    for r in mixing.mix_sources(d).collect():
        want[r.doc_id] += r.copies
    for most in (mixing.BROADCAST, 0):
        monkeypatch.setattr(mixing, "BROADCAST", most)
        got = mixing.take_mix(d)
        text = plan(got)
        assert "Window" not in text and "Sort" not in text and "regexp_extract" not in text and "regexp_count" not in text
        assert collections.Counter(r.doc_id for r in got.collect()) == +want


def test_rows_that_share_id_and_source(spark):
    """Same id and source with other sizes, whole copies, null ids and sources: as many of each as the mix has."""
    rows = [(None if i % 3 == 0 else i // 4, "w " * (1 + i % 2), None if i % 5 == 0 else "ab"[i % 2]) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = collections.Counter()
    for r in mixing.mix_sources(d, leaf_rows=9, fan_in=3).collect():
        want[r.doc_id, r.source, r["size"]] += r.copies
    got = mixing.take_mix(d, leaf_rows=9, fan_in=3).collect()
    assert collections.Counter((r.doc_id, r.source, r.text.count("w")) for r in got) == +want
