"""Classifier score queries on the given tables."""

from pyspark.sql import functions as F

from strandline.operators import scores as sc
from strandline.plans.registry import query
from strandline.session import scratch_path
from strandline.sources.text import log_proportions, log_shapes, read_json_log, read_score_reports

RANKED = "row_number() OVER (PARTITION BY sample_id, classifier ORDER BY {v} DESC, class_name) AS rank"


@query(
    "AGG45_classifier_top",
    f"""WITH l AS (SELECT s.* FROM class_scores s JOIN (SELECT sample_id, classifier, max(batch_id) AS batch_id FROM class_scores GROUP BY 1, 2) m USING (sample_id, classifier, batch_id)),
        t AS (SELECT *, {RANKED.format(v='score')}, round(score * 100.0, 4) AS confidence FROM l)
        SELECT sample_id, classifier, batch_id, class_name, rank, confidence, CASE classifier WHEN 'sturgeon' THEN CASE WHEN confidence >= 95 THEN 'High confidence' WHEN confidence >= 80 THEN 'Medium confidence' WHEN confidence >= 0 THEN 'Low confidence' ELSE 'Very low confidence' END
        ELSE CASE WHEN confidence >= 85 THEN 'High confidence' WHEN confidence >= 65 THEN 'Medium confidence' WHEN confidence >= 0 THEN 'Low confidence' ELSE 'Very low confidence' END END AS level FROM t WHERE rank <= 3""",
)
def classifier_top(v):
    return sc.classifier_top(v.class_scores, 3)


PER = "per AS (SELECT sample_id, classifier, class_name, arg_max(score, batch_id) AS last, max(score) AS highest FROM class_scores GROUP BY 1, 2, 3)"


@query("WIN15_top_classes_last", f"WITH {PER} SELECT * FROM (SELECT *, {RANKED.format(v='last')} FROM per) WHERE rank <= 10")
def top_classes_last(v):
    return sc.top_classes(v.class_scores, 10, "last")


@query("WIN15_top_classes_highest", f"WITH {PER} SELECT * FROM (SELECT *, {RANKED.format(v='highest')} FROM per WHERE highest >= 0.5) WHERE rank <= 10")
def top_classes_highest(v):
    return sc.top_classes(v.class_scores, 10, "highest", 0.5)


@query("WIN15_top_classes_over_five", f"WITH {PER} SELECT * FROM (SELECT *, {RANKED.format(v='last')} FROM per WHERE highest >= 0.05) WHERE rank <= 3")
def top_classes_over_five(v):
    return sc.top_classes(v.class_scores, 3, "last", 0.05)


LEAVES = """leaves AS (SELECT sample_id, concat('F', CAST(CAST(replace(class_name, 'class_', '') AS BIGINT) % 2 AS STRING)) AS l1, concat('S', CAST(CAST(replace(class_name, 'class_', '') AS BIGINT) % 4 AS STRING)) AS l2,
  class_name AS l3, max(score) AS score FROM class_scores GROUP BY 1, 2, 3, 4)"""


@query(
    "AGG46_score_hierarchy",
    f"""WITH {LEAVES}, n AS (SELECT sample_id, 1 AS level, l1 AS name, sum(score) AS score FROM leaves GROUP BY 1, 3 UNION ALL SELECT sample_id, 2, concat(l1, '/', l2), sum(score) FROM leaves GROUP BY 1, 3
          UNION ALL SELECT sample_id, 3, concat(l1, '/', l2, '/', l3), sum(score) FROM leaves GROUP BY 1, 3)
        SELECT sample_id, level, name, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, level ORDER BY score DESC, name) AS rank FROM (SELECT sample_id, level, name, round(score, 6) AS score FROM n)) WHERE rank <= 10""",
)
def score_hierarchy(v):
    leaves = v.sql(f"WITH {LEAVES} SELECT * FROM leaves")
    low = leaves.groupBy("sample_id", "l1", "l2").agg(F.collect_list(F.struct(F.col("l3").alias("group"), "score")).alias("members"))
    mid = low.groupBy("sample_id", "l1").agg(F.collect_list(F.struct(F.col("l2").alias("group"), "members")).alias("members"))
    nested = mid.groupBy("sample_id").agg(F.collect_list(F.struct(F.col("l1").alias("group"), "members")).alias("members"))
    return sc.top_nodes(sc.score_hierarchy(nested).withColumn("score", F.round("score", 6)))


@query(
    "AGG46_score_json",
    f"""WITH {LEAVES} SELECT sample_id, 1 AS level, l1 AS name, round(sum(score), 6) AS score FROM leaves GROUP BY 1, 3 UNION ALL SELECT sample_id, 2, concat(l1, '/', l2), round(sum(score), 6) FROM leaves GROUP BY 1, 3
        UNION ALL SELECT sample_id, 3, concat(l1, '/', l2, '/', l3), round(sum(score), 6) FROM leaves GROUP BY 1, 3""",
)
def score_json(v):
    """Reports as JSON lines, with a broken line per sample that the reader leaves out."""
    leaves = v.sql(f"WITH {LEAVES} SELECT * FROM leaves")
    low = leaves.groupBy("sample_id", "l1", "l2").agg(F.collect_list(F.struct(F.col("l3").alias("group"), "score")).alias("members"))
    mid = low.groupBy("sample_id", "l1").agg(F.collect_list(F.struct(F.col("l2").alias("group"), "members")).alias("members"))
    nested = mid.groupBy("sample_id").agg(F.collect_list(F.struct(F.col("l1").alias("group"), "members")).alias("members"))
    lines = nested.select(F.to_json(F.struct("sample_id", "members")).alias("value"))
    path = scratch_path(v.spark, "reports")
    lines.unionByName(nested.select(F.concat(F.lit("{"), "sample_id").alias("value"))).write.text(path)
    return sc.score_hierarchy(read_score_reports(v.spark, path)).withColumn("score", F.round("score", 6))


LOGITS = "logits AS (SELECT sample_id, concat(classifier, '_', CAST(batch_id AS STRING)) AS model, class_name, score * 10 - 5 AS logit FROM class_scores)"
TEMPS = "temps AS (SELECT DISTINCT concat(classifier, '_', CAST(batch_id AS STRING)) AS model, 1.0E0 + (batch_id % 4) * 0.25 AS temperature FROM class_scores)"


@query(
    "AGG48_calibrate_scores",
    f"""WITH {LOGITS}, {TEMPS}, e AS (SELECT sample_id, model, class_name, exp(logit / temperature) AS x FROM logits JOIN temps USING (model)),
        p AS (SELECT *, round(x / sum(x) OVER (PARTITION BY sample_id, model), 9) AS probability FROM e), w AS (SELECT sample_id, model FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY probability DESC, model DESC) AS k FROM p) WHERE k = 1)
        SELECT sample_id, model, class_name, round(probability, 6) AS probability FROM p JOIN w USING (sample_id, model)""",
)
def calibrate_scores(v):
    out = sc.calibrate_scores(v.sql(f"WITH {LOGITS} SELECT * FROM logits"), v.sql(f"WITH {TEMPS} SELECT * FROM temps"))
    return out.withColumn("probability", F.round("probability", 6))


@query(
    "SET7_bed_fraction_series",
    """SELECT sample_id, kind AS type, job_id * 1000 AS ts_ms, 100.0 * p AS percent FROM (SELECT sample_id, job_id, 'cnv_breakpoints' AS kind, duration_seconds / 1000 AS p FROM job_events
       UNION ALL SELECT sample_id, job_id, 'target_panel', duration_seconds / 2000 FROM job_events) ORDER BY 1, 2, 3""",
)
def bed_fraction_series(v):
    log = v.job_events.select("sample_id", F.col("job_id").alias("ts"), F.create_map(F.lit("cnv_breakpoints"), F.col("duration_seconds") / 1000, F.lit("target_panel"), F.col("duration_seconds") / 2000).alias("proportions"))
    return sc.fraction_series(log)


def json_log(v):
    """A log on disk: six in ten records hold a map, three a single type, and one in ten is cut off."""
    half = F.create_map(F.lit("cnv_breakpoints"), F.col("duration_seconds") / 1000, F.lit("target_panel"), F.col("duration_seconds") / 2000)
    newer = F.to_json(F.struct("sample_id", F.col("job_id").alias("ts"), half.alias("proportions")))
    older = F.to_json(F.struct("sample_id", F.col("job_id").alias("ts"), F.lit("cnv_breakpoints").alias("type"), (F.col("duration_seconds") / 1000).alias("proportion")))
    turn = F.expr("job_id div 3 % 10")
    line = F.when(turn < 6, newer).when(turn < 9, older).otherwise(F.substring(newer, 1, 25))
    path = scratch_path(v.spark, "json-log")
    v.job_events.select(line.alias("value")).write.text(path)
    return read_json_log(v.spark, path)


@query(
    "SET7_json_log",
    """SELECT sample_id, 'cnv_breakpoints' AS type, job_id * 1000 AS ts_ms, 100.0 * (duration_seconds / 1000) AS percent FROM job_events WHERE job_id // 3 % 10 < 9
       UNION ALL SELECT sample_id, 'target_panel', job_id * 1000, 100.0 * (duration_seconds / 2000) FROM job_events WHERE job_id // 3 % 10 < 6""",
)
def fractions_of_json_log(v):
    return sc.fraction_series(log_proportions(json_log(v)))


@query("SET7_json_log_shapes", "SELECT CASE WHEN job_id // 3 % 10 < 6 THEN 'map' WHEN job_id // 3 % 10 < 9 THEN 'single' ELSE 'broken' END AS shape, count(*) AS lines FROM job_events GROUP BY 1")
def shapes_of_json_log(v):
    return log_shapes(json_log(v))
