"""Personal data: base kinds and disclosing terms, against brute force."""

import random

import pytest
from brute import base_spans, personal_data, sha
from pyspark.sql import functions as F

from twinstage.llm import catalog, pii
from twinstage.llm.common import matches_of, running

SMALL = "/root/testdata/sf0.001"
PARTS = ["a@b.c", "x.y%z@mail-1.example.com", "_d@e.f.", "a@b", "@", "1.2.3.4", "255.256.1.1", "000255.0.0.001", "9.9.9.9.9.9.9.9", "4111 1111 1111 1111",
         "4111-1111-1111-1111", "4111111111111111", "4111 1111 1111 1112", "6011000990139424", "1 2", "12  34", "+1 (555) 123-4567", "+49 30 901820.", "+1 2", "+1",
         "+3-()..5 ", "+123456789012345678", " ", "  ", "\n", "\t", ",", ".", "-", "é", "日本", "😀", "Müller", "Bob", "bob", "(Alice)", "call", "\"secret\",",
         "x1", "0", "7", "%", "a@b.c%d@e.f", "..", "1.2.3.4 4111 1111 1111 1111", "+1 4111 1111 1111 1111"]


def mixed(seed, n, length=14):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) + rnd.choice(["", " ", " ", " "]) for _ in range(rnd.randint(0, length))) for _ in range(n)]


def corpus(spark):
    """The small table; mixed texts; copies, near copies and terms that stand with one entity, often or everywhere."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = [(20_000 + k, t) for k, t in enumerate(mixed(1, 250))]
    for k in range(6):
        more.append((30_000 + k, f"case {k} of Quasimodo, bellringer: quasi@notre.fr lives near Esmeralda today{k} the tower"))
        more.append((30_100 + k, f"the tower and today word{k}"))
    more += [(30_200, "exact copy Hapax here one@two.three and Rare words"), (30_201, "exact copy Hapax here one@two.three and Rare words"),
             (-1, None), (-2, ""), (-3, " \n"), (None, more[0][1]), (None, None), (20_001, more[1][1]), (20_001, more[1][1]),
             (-4, "write to Bob a@b.cc or 10.1.2.3 " * 3000), (-5, "y" * 60_000 + " +1 555 123 4567 " + "1 " * 30_000)]
    return d.union(spark.createDataFrame(more, "doc_id long, text string"))


@pytest.mark.parametrize("reach", [80, 40])
def test_personal_data(spark, reach):
    d = corpus(spark)
    rows = [tuple(r) for r in d.collect()]
    got = pii.find_personal_data(d.repartition(4), reach=reach, with_text=True).collect()
    want = personal_data(rows, reach)
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans], r.clean_text) for r in got), key=str) == sorted(want, key=str)
    acts = {s[3] for _, spans, _ in want for s in spans}
    assert acts == {"mask", "remove", "generalise"}
    told = {t[a:b] for (_, t), (_, spans, _) in zip(rows, want) for k, a, b, _ in spans if k == "term"}
    assert "Quasimodo" in told and "Hapax" not in told  # one passage copied is no evidence
    bare = pii.find_personal_data(d, reach=reach)
    assert bare.columns == ["doc_id", "spans"]


def test_base_kinds(spark):
    rows = list(enumerate(mixed(2, 3000, 20)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(s)[:3] for s in r.spans if s.kind != "term"] for r in pii.find_personal_data(d).collect()}
    assert got == {i: base_spans(t) for i, t in rows}
    assert {k for spans in got.values() for k, *_ in spans} == set(pii.KINDS)


def test_pii_query(spark, tmp_path):
    """Also with columns whose names the operator uses itself."""
    d = corpus(spark).withColumn("row", F.lit("x")).withColumn("base", F.lit(1)).withColumn("id", F.lit(None).cast("string"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text").collect()]
    got = catalog.queries()["op12_pii"](spark, str(tmp_path))
    want = []
    for i, spans, _ in personal_data(rows):
        text = [f"{k}:{a}:{b}" for k, a, b, _ in spans]
        n = [sum(s[0] == k for s in spans) for k in (*pii.KINDS, "term")]
        want.append((i, *n[:4], sha(",".join(text[:len(text) - n[4]]).encode()), ",".join(text), n[4]))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
    assert pii.find_personal_data(d.limit(0), with_text=True).count() == 0


def test_arrays_in_a_row(spark):
    """Running folds over and beyond the block, and matches of a text of many."""
    for n in (0, 1, 5, 511, 512, 513, 3000):
        v = [(k * 7919) % 11 for k in range(n)]
        d = spark.createDataFrame([(v,)], "v array<int>")
        sums, tops = d.select(running(F.col("v"), lambda a, b: a + b), running(F.col("v"), F.greatest)).first()
        assert sums == [sum(v[:k]) for k in range(n)] and tops == [max(v[:k], default=0) for k in range(n)]
    text = "é1 22x " * 5000
    got = spark.createDataFrame([(text,)], "t string").select(matches_of(F.col("t"), "[0-9]+").alias("m")).first().m
    assert [(m.start, m.end, m.value) for m in got[:2]] == [(1, 2, "1"), (3, 5, "22")] and len(got) == 10_000
    assert (got[-1].start, got[-1].end, got[-1].before, got[-1].after) == (34_996, 34_998, " ", "x ")
