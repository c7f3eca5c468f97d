"""All cuts of a cascade, and the channel of rejected lines."""
import random

import pytest
from pyspark.sql import types as T

from twinstage.operators import cascade as C
from twinstage.operators import metrics as E
from twinstage.operators import models as D
from twinstage.sources import io


def brute(rows, benign):
    out = {}
    for t in [None, *{p for _, p, _ in rows if p is not None}]:
        pred = [s if p is not None and (t is None or p > t) else benign for _, p, s in rows]
        labels = {y for y, *_ in rows} | set(pred)
        f1 = []
        for c in labels:
            tp = sum(y == c and q == c for (y, *_), q in zip(rows, pred))
            f1.append(2 * tp / (sum(y == c for y, *_ in rows) + sum(q == c for q in pred)))
        up = sum(p is not None and (t is None or p > t) for _, p, _ in rows)
        out[t] = (up, round(sum(f1) / len(f1), 9))
    return out


@pytest.mark.parametrize("buckets", [500_000, 7])
def test_sweep_equals_brute_force(spark, monkeypatch, buckets):
    rnd = random.Random(buckets)
    rows = [(rnd.choice(["b", "b", "b", "x", "y", None]), rnd.choice([None, *[k / 40 for k in range(40)]]), rnd.choice(["x", "y", "z", "b"]))
            for _ in range(300)]
    monkeypatch.setattr(E.running_totals, "__defaults__", (buckets, True))
    d = spark.createDataFrame(rows, "yy string, p double, s2 string")
    got = E.cascade_sweep(d, "yy", "p", "s2", "b").collect()
    want = brute(rows, "b")
    assert {r.threshold: (r.routed, round(r.macro_f1, 9)) for r in got} == want and len(got) == len(want)
    top = E.best_cut(E.cascade_sweep(d, "yy", "p", "s2", "b")).first()
    assert round(top.macro_f1, 9) == max(v for _, v in want.values()) == want[top.threshold][1]
    none = E.cascade_sweep(d.limit(0), "yy", "p", "s2", "b").collect()
    assert [(r.threshold, r.routed, r.macro_f1) for r in none] == [(None, 0, 0.0)]


def test_tuned_threshold_is_the_best_one(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        cls = rnd.choice(["benign"] * 6 + ["scan", "ddos"])
        base = {"benign": 0.0, "scan": 1.2, "ddos": 2.4}[cls]
        rows.append((i, rnd.gauss(base, 1.0), "t", cls))
    d = spark.createDataFrame(rows, "id long, x double, proto string, y string")
    spec = C.CascadeSpec(num_cols=["x"], cat_cols=["proto"], label_col="y", benign="benign",
                         stage1_params=dict(maxIter=4, maxDepth=3), stage2_params=dict(numTrees=4, maxDepth=3))
    model = C.fit_two_stage(D.stable_order(d.where("id < 600"), "id", 2), spec)
    held = d.where("id >= 600")
    tuned = C.tune_threshold(model, held)

    def score(m):
        return E.macro_f1(m.predict(held), "y", "y_pred").first().macro_f1
    assert model.spec.threshold == 0.5 and score(tuned) >= score(model)
    cuts = [r.p_attack for r in model.predict(held).select("p_attack").distinct().collect()]
    assert all(score(C.TwoStageModel(model.stage1, model.stage2, model.attack_labels, C.replace(spec, threshold=t))) <= score(tuned) + 1e-12
               for t in cuts[:6])


def test_rejected_lines_are_counted_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,name\n1,0.5,ann\n2,oops,bob\n3,1.5\n4,2.5,"c, d"\n\n5,,eve\n6,1,2,3\nseven,1.0,x\n8,1e3,"open\n')
    (tmp_path / "b.csv").write_text(' name , id\nzoe,9\nmax,\n,10\nmore,than,two\n')
    (tmp_path / "c.csv").write_text("id\n")
    (tmp_path / "d.txt").write_text("id\n99\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("name", T.StringType())])
    good, bad = io.read_folder_checked(spark, str(tmp_path), "*.csv", schema)
    rows = {(r.file[-5:], r.id, r.x, r.name) for r in good.collect()}
    assert rows == {("a.csv", 1, 0.5, "ann"), ("a.csv", 4, 2.5, "c, d"), ("a.csv", 5, None, "eve"), ("b.csv", 9, None, "zoe"),
                    ("b.csv", None, None, "max"), ("b.csv", 10, None, None)} | {x for x in rows if x[1] == 8}
    told = sorted((r.file[-5:], r.line, r.reason) for r in bad.collect())
    assert [t for t in told if not t[1].startswith("8,")] == [("a.csv", "2,oops,bob", "x"), ("a.csv", "3,1.5", "fields"), ("a.csv", "6,1,2,3", "fields"),
                                                            ("a.csv", "seven,1.0,x", "id"), ("b.csv", "more,than,two", "fields")]
    assert len(rows) + len(told) == 12  # every line but headers and blank ones
    with pytest.raises(FileNotFoundError):
        io.read_folder_checked(spark, str(tmp_path / "none"), "*.csv", schema)
    with pytest.raises(FileNotFoundError):
        io.read_folder_checked(spark, str(tmp_path), "*.tsv", schema)
