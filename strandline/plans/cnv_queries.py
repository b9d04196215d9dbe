"""Copy number queries on the given tables."""

from pyspark.sql import functions as F

from strandline.operators import cnv
from strandline.plans.registry import query

TRACK = """counts AS (SELECT sample_id, chrom, ref_start // 1000000 AS bin_idx, count(*) AS n FROM cnv_starts WHERE mapq >= 60 AND chrom <> 'chrM' GROUP BY 1, 2, 3),
  lasts AS (SELECT sample_id, chrom, max(bin_idx) AS lastb, sum(n) AS s FROM counts GROUP BY 1, 2),
  means AS (SELECT sample_id, sum(s) / sum(lastb + 1) AS m FROM lasts WHERE regexp_matches(chrom, '^chr[0-9]+$') GROUP BY 1),
  grid AS (SELECT sample_id, chrom, unnest(range(0, lastb + 1)) AS bin_idx FROM lasts),
  raw_track AS (SELECT g.sample_id, g.chrom, g.bin_idx, 2.0E0 * coalesce(n, 0) / m AS value FROM grid g LEFT JOIN counts c USING (sample_id, chrom, bin_idx) JOIN means USING (sample_id)),
  pcounts AS (SELECT chrom, bin_idx, sum(n) AS n FROM counts WHERE chrom <> 'chrM' GROUP BY 1, 2),
  plasts AS (SELECT chrom, max(bin_idx) AS lastb, sum(n) AS s FROM pcounts GROUP BY 1),
  ref_track AS (SELECT g.chrom, g.bin_idx, 2.0E0 * coalesce(n, 0) / (SELECT sum(s) / sum(lastb + 1) FROM plasts WHERE regexp_matches(chrom, '^chr[0-9]+$') AND chrom NOT IN ('chr7', 'chr10')) AS value
    FROM (SELECT chrom, unnest(range(0, lastb + 1)) AS bin_idx FROM plasts) g LEFT JOIN pcounts USING (chrom, bin_idx))"""
SMOOTH = "(coalesce(lag(value) OVER {w}, value) + value + coalesce(lead(value) OVER {w}, value)) / 3"
NORM = f"""{TRACK}, smooth AS (SELECT sample_id, chrom, bin_idx, {SMOOTH.format(w='(PARTITION BY sample_id, chrom ORDER BY bin_idx)')} AS value FROM raw_track),
  ref_flat AS (SELECT chrom, bin_idx, CAST(2.0 AS DOUBLE) AS value FROM ref_track),
  rsmooth AS (SELECT chrom, bin_idx, {SMOOTH.format(w='(PARTITION BY chrom ORDER BY bin_idx)')} AS value FROM ref_flat),
  want AS (SELECT s.sample_id, r.* FROM (SELECT DISTINCT sample_id, chrom FROM smooth) s JOIN rsmooth r USING (chrom)),
  norm AS (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.bin_idx, b.bin_idx) AS bin_idx, coalesce(a.value, 0) - coalesce(b.value, 0) AS value
    FROM smooth a FULL JOIN want b ON a.sample_id = b.sample_id AND a.chrom = b.chrom AND a.bin_idx = b.bin_idx)"""
SEX = """sexes AS (SELECT sample_id, x_mean, y_mean, CASE WHEN x_mean IS NULL OR y_mean IS NULL THEN 'Unknown' WHEN x_mean >= 0.1 AND y_mean <= -0.1 THEN 'Female' WHEN x_mean <= 0.1 AND y_mean >= -0.2 THEN 'Male'
    WHEN x_mean >= 0.1 AND y_mean >= -0.1 THEN 'Male (query X/Y copy number changes)' WHEN x_mean < 0.1 AND y_mean < -0.2 THEN 'Unknown (Query XY copy number changes)' ELSE 'Unknown' END AS sex
  FROM (SELECT sample_id, avg(value) FILTER (chrom = 'chrX' AND value <> 0) AS x_mean, avg(value) FILTER (chrom = 'chrY' AND value <> 0) AS y_mean FROM norm GROUP BY 1))"""
LIMITS = "CASE WHEN chrom = 'chrX' AND upper(sex) IN ('XY', 'MALE') THEN {a} WHEN chrom = 'chrX' THEN {b} WHEN chrom = 'chrY' AND upper(sex) IN ('XY', 'MALE') THEN {c} WHEN chrom = 'chrY' THEN {d} ELSE {e} END"
GAIN = LIMITS.format(a=0.3, b=0.75, c=0.5, d=0.2, e=0.4)
LOSS = LIMITS.format(a=-0.3, b=-0.75, c=-0.5, d=-1.0, e=-0.4)
BANDED = "banded AS (SELECT t.*, c.band, c.start_pos AS band_start, c.end_pos AS band_end FROM norm t JOIN cytobands c ON c.chrom = t.chrom AND t.bin_idx BETWEEN c.start_pos // 1000000 AND c.end_pos // 1000000)"
ARMS = f"""{NORM}, {SEX}, {BANDED}, arms AS (SELECT sample_id, chrom, substr(band, 1, 1) AS arm, avg(value) AS mean,
    greatest(avg(CASE WHEN value > {GAIN} THEN 1.0E0 ELSE 0 END), avg(CASE WHEN value < {LOSS} THEN 1.0E0 ELSE 0 END)) AS share, min(band_start) AS start_pos, max(band_end) AS end_pos, any_value(sex) AS sex
    FROM banded JOIN sexes USING (sample_id) GROUP BY 1, 2, 3)"""
EVENTS = f"""{ARMS}, wide AS (SELECT sample_id, chrom, max(mean) FILTER (arm = 'p') AS pm, max(mean) FILTER (arm = 'q') AS qm, max(share) FILTER (arm = 'p') AS ps, max(share) FILTER (arm = 'q') AS qs,
    max(start_pos) FILTER (arm = 'p') AS p0, max(end_pos) FILTER (arm = 'p') AS p1, max(start_pos) FILTER (arm = 'q') AS q0, max(end_pos) FILTER (arm = 'q') AS q1, min(start_pos) AS s0, max(end_pos) AS s1,
    any_value(sex) AS sex, any_value(cm) AS cm FROM arms JOIN (SELECT sample_id, chrom, avg(value) AS cm FROM norm GROUP BY 1, 2) z USING (sample_id, chrom) GROUP BY 1, 2),
  w AS (SELECT *, {GAIN} AS gain, {LOSS} AS loss FROM wide WHERE NOT (chrom = 'chrY' AND upper(sex) IN ('XY', 'MALE'))),
  events AS (SELECT sample_id, chrom, concat('WHOLE_CHR_', CASE WHEN pm > gain THEN 'GAIN' ELSE 'LOSS' END) AS event_type, '' AS arm, cm AS mean_cnv, s0 AS start_pos, s1 AS end_pos,
      CASE WHEN least(ps, qs) > 0.8 THEN 'High' ELSE 'Medium' END AS confidence, greatest(ps, qs) AS share FROM w WHERE ps IS NOT NULL AND qs IS NOT NULL AND greatest(ps, qs) > 0.7 AND least(ps, qs) > 0.4
        AND ((pm > gain AND qm > gain) OR (pm < loss AND qm < loss))
    UNION ALL SELECT sample_id, chrom, CASE WHEN cm > gain THEN 'WHOLE_CHR_GAIN' ELSE 'WHOLE_CHR_LOSS' END, '', cm, s0, s1, 'Medium', 1.0 FROM w WHERE (ps IS NULL OR qs IS NULL) AND abs(cm) > abs(gain) * 1.5
    UNION ALL SELECT sample_id, chrom, CASE WHEN pm > gain THEN 'GAIN' ELSE 'LOSS' END, 'p', pm, p0, p1, CASE WHEN ps > 0.8 THEN 'High' ELSE 'Medium' END, ps FROM w WHERE qs IS NOT NULL AND chrom <> 'chrY' AND ps > 0.4 AND (pm > gain OR pm < loss)
    UNION ALL SELECT sample_id, chrom, CASE WHEN qm > gain THEN 'GAIN' ELSE 'LOSS' END, 'q', qm, q0, q1, CASE WHEN qs > 0.8 THEN 'High' ELSE 'Medium' END, qs FROM w WHERE ps IS NOT NULL AND chrom <> 'chrY' AND qs > 0.4 AND (qm > gain OR qm < loss))"""


def raw_track(v):
    return cnv.cnv_bin_counts(v.cnv_starts)


def norm_track(v):
    """The track against a flat reference of two copies."""
    raw = raw_track(v)
    flat = raw.groupBy("chrom").agg(F.max("bin_idx").alias("_l")).select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), "_l")).alias("bin_idx")).withColumn("value", F.lit(2.0))
    return cnv.normalise_cnv(raw, flat)


def sexes(v):
    return cnv.estimate_sex(norm_track(v))


@query("AGG37_cnv_bin_counts", f"WITH {TRACK} SELECT * FROM raw_track")
def cnv_bin_counts(v):
    return raw_track(v)


@query("WIN1_moving_average", f"WITH {NORM} SELECT * FROM smooth")
def moving_average(v):
    return cnv.moving_average(raw_track(v))


@query("WIN2_normalise_cnv", f"WITH {NORM} SELECT * FROM norm")
def normalise_cnv(v):
    return norm_track(v)


@query(
    "WIN3_significant_regions",
    f"""WITH {NORM}, m AS (SELECT *, CASE WHEN value > 0 THEN 'gain' ELSE 'loss' END AS type FROM norm WHERE abs(value) > 0.5), r AS (SELECT *, bin_idx - row_number() OVER (PARTITION BY sample_id, chrom, type ORDER BY bin_idx) AS run FROM m)
        SELECT sample_id, chrom, type, min(bin_idx) * 1000000 AS start_pos, (max(bin_idx) + 1) * 1000000 AS end_pos FROM r GROUP BY sample_id, chrom, type, run""",
)
def significant_regions(v):
    return cnv.significant_regions(norm_track(v))


STATS = """stats AS (SELECT sample_id, chrom, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, count(*) AS length FROM norm GROUP BY 1, 2)"""


@query(
    "AGG38_chrom_stats",
    f"""WITH {NORM}, {SEX}, {STATS} SELECT s.*, m AS autosome_mean, d AS autosome_std, CASE WHEN chrom = 'chrX' AND sex = 'Female' THEN 1.0 WHEN chrom = 'chrY' AND sex <> 'Male' THEN -1.0 ELSE 0.0 END AS baseline,
        CASE sex WHEN 'Male' THEN 'XY' WHEN 'Female' THEN 'XX' ELSE sex END AS sex
        FROM stats s JOIN (SELECT sample_id, avg(mean) AS m, stddev_pop(mean) AS d FROM stats WHERE regexp_matches(chrom, '^chr[0-9]+$') GROUP BY 1) a USING (sample_id) JOIN sexes USING (sample_id)""",
)
def chrom_stats(v):
    name = F.when(F.col("sex") == "Male", "XY").when(F.col("sex") == "Female", "XX").otherwise(F.col("sex"))
    track = norm_track(v)
    return cnv.chrom_stats(track, cnv.estimate_sex(track).select("sample_id", name.alias("sex")))


@query("AGG39_estimate_sex", f"WITH {NORM}, {SEX} SELECT * FROM sexes")
def estimate_sex(v):
    return sexes(v)


@query("JN13_bins_to_bands", f"WITH {NORM}, {BANDED} SELECT sample_id, chrom, band, bin_idx, value FROM banded")
def bins_to_bands(v):
    return cnv.bins_to_bands(norm_track(v), v.cytobands).select("sample_id", "chrom", "band", "bin_idx", "value")


@query("AGG40_arm_stats", f"WITH {ARMS} SELECT sample_id, chrom, arm, mean, share, start_pos, end_pos FROM arms")
def arm_stats(v):
    track = norm_track(v)
    return cnv.arm_stats(track, v.cytobands, cnv.estimate_sex(track)).select("sample_id", "chrom", "arm", "mean", "share", "start_pos", "end_pos")


def events(v):
    track = norm_track(v)
    return cnv.cnv_events(track, v.cytobands, cnv.estimate_sex(track))


HITS = "EXISTS (SELECT 1 FROM cnv_genes g WHERE g.chrom = e.chrom AND g.start_pos <= e.end_pos AND g.end_pos >= e.start_pos)"


@query(
    "AGG41_cnv_events",
    f"""WITH {EVENTS} SELECT e.*, (SELECT count(DISTINCT gene) FROM cnv_genes g WHERE g.chrom = e.chrom AND g.start_pos <= e.end_pos AND g.end_pos >= e.start_pos) AS n_genes FROM events e""",
)
def cnv_events(v):
    return cnv.with_gene_counts(events(v), v.cnv_genes, ["sample_id", "chrom", "event_type", "arm"])


@query(
    "AGG42_cnv_summary",
    f"""WITH {EVENTS} SELECT sample_id, count(*) AS total_events, count(*) FILTER (starts_with(event_type, 'WHOLE_CHR_')) AS whole_chromosome_events, count(*) FILTER (NOT starts_with(event_type, 'WHOLE_CHR_')) AS arm_events,
        count(*) FILTER (hit) AS gene_containing_events, count(*) FILTER (confidence = 'High') AS high_confidence_events, count(*) FILTER (confidence = 'Medium') AS medium_confidence_events, any_value(total_genes) AS total_genes
        FROM (SELECT e.*, {HITS} AS hit FROM events e) JOIN (SELECT sample_id, count(DISTINCT gene) AS total_genes FROM events e JOIN cnv_genes g ON g.chrom = e.chrom AND g.start_pos <= e.end_pos AND g.end_pos >= e.start_pos GROUP BY 1) t USING (sample_id) GROUP BY 1""",
)
def cnv_summary(v):
    return cnv.cnv_summary(events(v), v.cnv_genes)


def _states(mode: str) -> str:
    cent = "cent AS (SELECT chrom, min(start_pos) // 1000000 AS a, max(end_pos) // 1000000 AS b FROM cytobands WHERE stain = 'acen' GROUP BY 1), masked AS (SELECT t.* FROM norm t WHERE NOT EXISTS (SELECT 1 FROM cent c WHERE c.chrom = t.chrom AND t.bin_idx >= a AND t.bin_idx < b))"
    base = "cs AS (SELECT sample_id, chrom, avg(value) AS cm, stddev_pop(value) AS sd, any_value(sex) AS sex FROM masked JOIN sexes USING (sample_id) GROUP BY 1, 2)"
    if mode == "data":
        k = "CASE WHEN chrom = 'chrY' AND sex NOT IN ('Male', 'XY') THEN 1.2 ELSE 1.0 END"
        lim = f"""lv AS (SELECT sample_id, avg(cm) AS m, stddev_pop(cm) AS s FROM cs WHERE regexp_matches(chrom, '^chr[0-9]+$') GROUP BY 1),
          lim AS (SELECT sample_id, chrom, cm, m + {k} * s AS wg, m - {k} * s AS wl, cm + {k} * sd AS bg, cm - {k} * sd AS bl FROM cs JOIN lv USING (sample_id))"""
        judged, keep = "masked", "WHERE state <> 'NORMAL'"
    else:
        lim = f"lim AS (SELECT sample_id, chrom, cm, {GAIN} AS wg, {LOSS} AS wl, {GAIN} AS bg, {LOSS} AS bl FROM cs)"
        judged, keep = "norm", ""
    return f"""{NORM}, {SEX}, {BANDED}, {cent}, {base}, {lim},
      sh AS (SELECT sample_id, chrom, avg(CASE WHEN value > wg THEN 1.0E0 ELSE 0 END) AS up, avg(CASE WHEN value < wl THEN 1.0E0 ELSE 0 END) AS down FROM {judged} JOIN lim USING (sample_id, chrom) GROUP BY 1, 2),
      wc AS (SELECT *, CASE WHEN up > 0.7 THEN 'GAIN' WHEN down > 0.7 THEN 'LOSS' END AS state FROM sh),
      bm AS (SELECT sample_id, chrom, band, band_start, band_end, avg(value) AS mean_cnv FROM banded GROUP BY 1, 2, 3, 4, 5),
      bs AS (SELECT bm.*, CASE WHEN mean_cnv > bg THEN 'GAIN' WHEN mean_cnv < bl THEN 'LOSS' ELSE 'NORMAL' END AS state FROM bm JOIN lim USING (sample_id, chrom)),
      fr AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY sample_id, chrom ORDER BY band_start) = state THEN 0 ELSE 1 END AS f FROM bs),
      rn AS (SELECT *, sum(f) OVER (PARTITION BY sample_id, chrom ORDER BY band_start ROWS UNBOUNDED PRECEDING) AS run FROM fr),
      runs AS (SELECT sample_id, chrom, min(band_start) AS start_pos, max(band_end) AS end_pos, concat(chrom, ' ', arg_min(band, band_start), '-', arg_max(band, band_start)) AS name, avg(mean_cnv) AS mean_cnv, state FROM rn GROUP BY sample_id, chrom, run, state),
      states AS (SELECT *, end_pos - start_pos AS length FROM (SELECT * FROM runs {keep} UNION ALL SELECT sample_id, chrom, e.a, e.b, concat(chrom, ' WHOLE CHROMOSOME ', state), cm, state FROM wc JOIN lim USING (sample_id, chrom)
        JOIN (SELECT chrom, min(start_pos) AS a, max(end_pos) AS b FROM cytobands GROUP BY 1) e USING (chrom) WHERE state IS NOT NULL))"""


def states(v, mode):
    cent = v.cytobands.filter("stain = 'acen'").groupBy("chrom").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    track = norm_track(v)
    return cnv.cytoband_states(track, v.cytobands, cent, cnv.estimate_sex(track), mode=mode)


@query("AGG43_cytoband_states_data", f"WITH {_states('data')} SELECT * FROM states")
def cytoband_states_data(v):
    return states(v, "data")


@query("AGG43_cytoband_states_fixed", f"WITH {_states('fixed')} SELECT * FROM states")
def cytoband_states_fixed(v):
    return states(v, "fixed")


@query("WIN5_state_runs", f"WITH {_states('fixed')} SELECT * FROM runs")
def state_runs(v):
    return states(v, "fixed").filter(~F.contains("name", F.lit("WHOLE CHROMOSOME"))).drop("length")


@query(
    "AGG49_gained_lost_genes",
    f"""WITH {_states('data')}, h AS (SELECT DISTINCT s.sample_id, s.chrom, s.state, g.gene FROM states s JOIN cnv_genes g ON g.chrom = s.chrom AND g.start_pos <= s.end_pos AND g.end_pos >= s.start_pos)
        SELECT sample_id, chrom, count(*) FILTER (state = 'GAIN') AS gained_genes, count(*) FILTER (state = 'LOSS') AS lost_genes FROM h GROUP BY 1, 2""",
)
def gained_lost_genes(v):
    return cnv.gained_lost_genes(states(v, "data"), v.cnv_genes)


@query(
    "WIN17_zscore_class",
    f"""WITH {NORM}, s AS (SELECT sample_id, avg(value) AS m, stddev_pop(value) AS d FROM norm WHERE regexp_matches(chrom, '^chr[0-9]+$') GROUP BY 1)
        SELECT sample_id, chrom, bin_idx, value, CASE WHEN d > 0 AND (value - m) / d > 0.5 THEN 'high' WHEN d > 0 AND (value - m) / d < -0.5 THEN 'low' ELSE 'normal' END AS class FROM norm JOIN s USING (sample_id)""",
)
def zscore_class(v):
    return cnv.zscore_class(norm_track(v))


@query(
    "SRT4_even_sample",
    f"""WITH {TRACK}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY bin_idx) - 1 AS i, count(*) OVER (PARTITION BY sample_id, chrom) AS n FROM raw_track), k AS (SELECT unnest(range(0, 12)) AS s)
        SELECT sample_id, chrom, bin_idx, value FROM r WHERE n <= 12 OR EXISTS (SELECT 1 FROM k WHERE round_even(s * (n - 1) / 11, 0) = i)""",
)
def even_sample(v):
    return cnv.even_sample(raw_track(v), 12)


@query(
    "SRT4_even_sample_budget",
    f"""WITH {TRACK}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY bin_idx) - 1 AS i FROM raw_track),
        sizes AS (SELECT sample_id, chrom, count(*) AS n FROM r GROUP BY 1, 2),
        sums AS (SELECT *, sum(n) OVER (PARTITION BY sample_id) AS total, count(*) OVER (PARTITION BY sample_id) AS k FROM sizes),
        quota AS (SELECT *, (200 - k) * (n - 1) // (total - k) AS down, (200 - k) * (n - 1) % (total - k) AS remains FROM sums),
        turns AS (SELECT *, 200 - k - sum(down) OVER (PARTITION BY sample_id) AS spare, row_number() OVER (PARTITION BY sample_id ORDER BY remains DESC, chrom) AS turn FROM quota),
        shares AS (SELECT *, CASE WHEN total <= 200 THEN n ELSE 1 + down + (turn <= spare)::INT END AS share FROM turns),
        spots AS (SELECT sample_id, chrom, CASE WHEN share = 1 THEN n // 2 ELSE (2 * s * (n - 1) + share - 1) // (2 * (share - 1)) END AS i FROM (SELECT *, unnest(range(0, share::BIGINT)) AS s FROM shares))
        SELECT sample_id, chrom, bin_idx, value FROM r JOIN spots USING (sample_id, chrom, i)""",
)
def even_sample_budget(v):
    """200 rows of each sample, over all its chromosomes."""
    return cnv.even_sample_budget(raw_track(v), 200)


FITTED = """base AS (SELECT sample_id, chrom, ref_start // 125000 AS b, count(*) AS n FROM cnv_starts WHERE mapq >= 60 AND chrom <> 'chrM' GROUP BY 1, 2, 3),
  ends AS (SELECT sample_id, chrom, max(b) AS lastb, sum(n) AS n FROM base WHERE regexp_matches(chrom, '^chr[0-9]+$') GROUP BY 1, 2),
  tried AS (SELECT sample_id, k, sum(n) AS n, sum((lastb >> k) + 1) AS bins FROM ends, (SELECT unnest(range(0, 7)) AS k) GROUP BY 1, 2),
  level AS (SELECT sample_id, coalesce(min(k) FILTER (n >= 30 * bins), 6) AS k FROM tried GROUP BY 1),
  fitted AS (SELECT sample_id, 125000 * (1 << any_value(k)) AS width, chrom, b >> k AS bin_idx, sum(n) AS n FROM base JOIN level USING (sample_id) GROUP BY sample_id, chrom, b >> k)"""


def fitted(v):
    """The reads come in two parts, which are counted apart."""
    parts = [cnv.base_counts(v.cnv_starts.filter(f"ref_start % 2 = {i}")) for i in (0, 1)]
    return cnv.fitted_bins(parts[0].unionByName(parts[1]))


@query("AGG37_fitted_bins", f"WITH {FITTED} SELECT sample_id, width, chrom, bin_idx, CAST(n AS BIGINT) AS n FROM fitted")
def fitted_bins(v):
    return fitted(v)


@query(
    "AGG37_width_and_variance",
    f"""WITH {FITTED}, tops AS (SELECT sample_id, width, chrom, max(bin_idx) AS lastb, sum(n) AS n FROM fitted WHERE regexp_matches(chrom, '^chr[0-9]+$') GROUP BY 1, 2, 3),
        cells AS (SELECT sample_id, width, chrom, unnest(range(0, lastb + 1)) AS bin_idx FROM tops),
        steps AS (SELECT c.sample_id, coalesce(f.n, 0) - lag(coalesce(f.n, 0)) OVER (PARTITION BY c.sample_id, c.chrom ORDER BY c.bin_idx) AS d FROM cells c LEFT JOIN fitted f USING (sample_id, chrom, bin_idx)),
        noise AS (SELECT sample_id, sum(d * d) AS sq, count(d) AS pairs FROM steps GROUP BY 1),
        totals AS (SELECT sample_id, width, CAST(sum(lastb + 1) AS BIGINT) AS bins, CAST(sum(n) AS BIGINT) AS reads FROM tops GROUP BY 1, 2)
        SELECT sample_id, width, bins, reads, (2.0E0 * bins / reads) * (2.0E0 * bins / reads) * sq / (2 * pairs) AS variance FROM totals JOIN noise USING (sample_id)""",
)
def width_and_variance(v):
    return cnv.width_and_variance(fitted(v))


@query(
    "SRT5_downsample_mean",
    f"""WITH {TRACK}, r AS (SELECT *, max(bin_idx) OVER (PARTITION BY sample_id, chrom) + 1 AS n FROM raw_track)
        SELECT sample_id, chrom, (bin_idx // 4 * 4 + least(bin_idx // 4 * 4 + 4, n)) / 2.0E0 * 1000000 AS position, avg(value) AS value FROM r WHERE n >= 4 GROUP BY sample_id, chrom, bin_idx // 4, n
        UNION ALL SELECT sample_id, chrom, (bin_idx + 0.5E0) * 1000000, value FROM r WHERE n < 4""",
)
def downsample_mean(v):
    return cnv.downsample_mean(raw_track(v), 4)


@query(
    "SRT6_random_sample",
    """SELECT sample_id, read_id, chrom, ref_start, ref_end FROM alignments
       WHERE CAST(concat('0x', substr(md5(concat_ws('|', sample_id, read_id, chrom, CAST(ref_start AS VARCHAR), CAST(ref_end AS VARCHAR), '42')), 1, 8)) AS BIGINT) < 429496729""",
)
def random_sample(v):
    key = ["sample_id", "read_id", "chrom", "ref_start", "ref_end"]
    return cnv.random_sample(v.alignments.select(*key), 0.1, key)


SEGMENTS = f"""WITH RECURSIVE {TRACK}, sig AS (SELECT sample_id, chrom, list(value ORDER BY bin_idx) AS v FROM raw_track WHERE chrom <> 'chrM' GROUP BY 1, 2 HAVING count(*) > 3),
  sums AS (SELECT sample_id, chrom, len(v) AS n, list_transform(range(0, len(v) + 1), lambda i: coalesce(list_sum(v[1:i]), 0.0E0)) AS s1, list_transform(range(0, len(v) + 1), lambda i: coalesce(list_sum(list_transform(v[1:i], lambda x: x * x)), 0.0E0)) AS s2 FROM sig),
  best(sample_id, chrom, e, cost, back) AS (SELECT sample_id, chrom, CAST(1 AS BIGINT), [-10.0E0, 1.0E300], [CAST(0 AS BIGINT), CAST(0 AS BIGINT)] FROM sums
    UNION ALL SELECT sample_id, chrom, e, list_append(cost, list_min(c)), list_append(back, CAST(list_position(c, list_min(c)) - 1 AS BIGINT)) FROM (
      SELECT b.sample_id, b.chrom, b.e + 1 AS e, cost, back, list_transform(range(0, b.e), lambda s: cost[s + 1] + s2[b.e + 2] - s2[s + 1] - (s1[b.e + 2] - s1[s + 1]) * (s1[b.e + 2] - s1[s + 1]) / (b.e + 1 - s) + 10.0E0) AS c
      FROM best b JOIN sums u ON u.sample_id = b.sample_id AND u.chrom = b.chrom WHERE b.e < u.n)),
  done AS (SELECT b.sample_id, b.chrom, n, back FROM best b JOIN sums u ON u.sample_id = b.sample_id AND u.chrom = b.chrom AND b.e = u.n),
  walk(sample_id, chrom, stop, back) AS (SELECT sample_id, chrom, CAST(n AS BIGINT), back FROM done UNION ALL SELECT sample_id, chrom, back[stop + 1], back FROM walk WHERE back[stop + 1] > 0)
  SELECT sample_id, chrom, stop * 1000000 - 1000000 AS start_pos, stop * 1000000 + 1000000 AS end_pos FROM walk"""


@query("SEG1_change_points", SEGMENTS)
def change_points(v):
    return cnv.change_points(raw_track(v))
