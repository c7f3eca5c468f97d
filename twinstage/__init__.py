"""twinstage — Spark-native two-stage intrusion-detection analytics.

Entry points: ``operators.features.add_features`` (log features),
``operators.split`` (exact stratified / repeated / time splits),
``operators.cascade.fit_two_stage`` / ``fit_single_stage`` (MLlib cascade),
``operators.metrics`` (confusion, macro-F1, report, ROC/AUC),
``operators.runstats`` (paired t-test, Cohen's d, CI, run-time summary),
``streaming.scoring`` (cascade on a stream), ``sources.io`` (read / write).
"""
