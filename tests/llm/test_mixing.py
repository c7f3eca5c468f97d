"""Mixing: targets against brute force, sums kept, reruns agree."""

import collections

import pytest
from brute import WORD, targets

from twinstage.llm import mixing

SMALL = "/root/testdata/sf0.001"


def docs(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    more = [(-1, None, None), (-1, None, "zz"), (-2, "a b c", "zz"), (-2, "a b c", "zz"), (None, "x", None), (-3, "", "only empty"),
            (-4, "word " * 20_000, "src1"), (-5, "x y", "\U0001F600"), (-6, "x", "\uFF5E")]
    return d.union(spark.createDataFrame(more, "doc_id long, text string, source string"))


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 7, "fan_in": 3}])
def test_mix(spark, options):
    d = docs(spark)
    sizes, largest = collections.Counter(), collections.Counter()
    for r in d.collect():
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    want = targets(sizes)
    rows = mixing.mix_sources(d, **options).collect()
    assert len(rows) == d.count()
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        rate = r.target / r.source_size if r.source_size else 0
        assert r.size == 0 or int(rate) <= r.copies <= int(rate) + 1 or abs(rate - round(rate)) < 1e-9
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    key = ["doc_id", "source", "size", "nth", "copies"]
    again = mixing.mix_sources(d.repartition(9), **options).select(*key).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix_sources(d, **options).select(*key).collect())


def test_expected_copies(spark):
    """Over many seeds each document is taken as often as its fraction says."""
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "a" if i % 2 else "b") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets(sizes)
    total = collections.Counter()
    for seed in range(12):
        for r in mixing.mix_sources(d, seed=seed, leaf_rows=8, fan_in=4).collect():
            total[r.source] += r.copies
    for s in sizes:
        mean = total[s] / 12 / 20
        assert abs(mean - want[s] / sizes[s]) < 0.25


def test_take_mix(spark):
    d = docs(spark).withColumn("copies", mixing.F.lit("own")).withColumn("row", mixing.F.lit(1)).withColumn("size", mixing.F.lit(2))
    got = mixing.take_mix(d)
    assert got.columns == d.columns
    want = collections.Counter()
    for r in mixing.mix_sources(d).collect():
        want[(r.doc_id, r.source, r["size"])] += r.copies
    have = collections.Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in got.collect())
    assert have == +want
    assert mixing.take_mix(d.limit(0)).count() == 0 and mixing.mix_sources(d.limit(0)).count() == 0
