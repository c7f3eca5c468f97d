"""Repeated cross-validation of single- vs two-stage on the SIEM stand-in (C6),
fold scores written as JSON lines (S8), then the paired comparison (T1–T4) and
score summaries (A10, T5, T7) — the reference's 25-run study as Spark jobs.

usage: python tools/run_cv.py [sf_dir] [runs] [folds] [out_dir]
"""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    runs = int(sys.argv[2]) if len(sys.argv) > 2 else 5
    folds = int(sys.argv[3]) if len(sys.argv) > 3 else 5
    from twinstage.operators import cascade as C
    from twinstage.operators import runstats as RS
    from twinstage.operators import split as R
    from twinstage.operators import stats as A
    from twinstage.plans import trained as TR
    from twinstage.session import checkpoint_root, get_spark
    from twinstage.sources import io
    spark = get_spark()
    out = sys.argv[4] if len(sys.argv) > 4 else f"{checkpoint_root(spark)}/cv_scores"
    lab = TR.labelled(spark, sf_dir)
    split = R.repeated_folds(lab.select("event_id", TR.LABEL), TR.LABEL, "event_id", k=folds, runs=runs, seed=42)
    folded = TR.by_fold(lab.drop(TR.LABEL).join(split, "event_id"), ["run", "fold"])
    scores = C.cv_compare(folded, TR.spec(), "siem_events")
    io.write_scores(scores, out)
    sc = io.read_scores(spark, out)
    test = RS.paired_tests(sc, pairs=[("two_stage", "single_stage")]).first()
    summary = A.score_summary(sc).join(RS.ci95(sc).select("dataset", "model", "half_width"), ["dataset", "model"])
    print(json.dumps({
        "scores": out, "runs": runs, "folds": folds,
        "paired": {k: test[k] for k in ("n", "mean_a", "mean_b", "mean_diff", "t", "dof", "p_value",
                                        "cohens_d", "significant")},
        "summary": [r.asDict() for r in summary.collect()],
        "five_numbers": [r.asDict() for r in RS.five_numbers(sc).collect()],
    }, default=str))


if __name__ == "__main__":
    main()
