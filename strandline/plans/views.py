"""Domain tables derived from the given star-schema tables.

Every text is valid in Spark SQL and in DuckDB. ``{table}`` stands for a given
table, so one text feeds both the Spark plan and the SQL it is compared with.
Genome coordinates grow with the part keys, so the depth per position stays the
same at every scale.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _chrom(expr: str, n: int = 25) -> str:
    names = "WHEN 22 THEN 'X' WHEN 23 THEN 'Y'" + (" WHEN 24 THEN 'M'" if n == 25 else "")
    return f"concat('chr', CASE {expr} {names} ELSE CAST({expr} + 1 AS STRING) END)"


def _div(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


_FILE = _div("l_orderkey", 300)
_LOCUS = _div("l_partkey", 25)
_PLOCUS = _div("p_partkey", 25)

VIEWS = {
    "alignments": f"""
SELECT concat('s', CAST({_FILE} % 3 AS STRING)) AS sample_id,
       concat(CASE WHEN {_FILE} % 5 = 0 THEN 'fail' ELSE 'pass' END, '_', CAST({_FILE} AS STRING), '.bam') AS file,
       concat('r', CAST(l_orderkey AS STRING)) AS read_id,
       {_chrom('l_partkey % 25')} AS chrom,
       100000 + 2000 * {_LOCUS} + (l_suppkey * 37) % 400 AS ref_start,
       100000 + 2000 * {_LOCUS} + (l_suppkey * 37) % 400 + 150 + CAST(l_quantity AS BIGINT) * 40 AS ref_end,
       CAST(40 + l_suppkey % 21 AS INT) AS mapq,
       CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
       (l_linenumber = 1 AND l_partkey % 10 = 0) AS is_unmapped,
       l_linenumber >= 5 AS is_secondary,
       l_linenumber BETWEEN 2 AND 4 AS is_supplementary,
       150 + CAST(l_quantity AS BIGINT) * 40 AS query_length,
       CAST(5 AS BIGINT) AS read_start,
       150 + CAST(l_quantity AS BIGINT) * 40 AS read_end,
       concat('5S', CAST(100 + CAST(l_quantity AS BIGINT) * 20 AS STRING), 'M5D', CAST(45 + CAST(l_quantity AS BIGINT) * 20 AS STRING), 'M') AS cigar,
       CASE WHEN l_linenumber <= 4 THEN concat('chr', CASE WHEN l_suppkey % 25 = 24 THEN 'M' ELSE CAST(l_suppkey % 22 + 1 AS STRING) END, ',',
            CAST(100001 + 2000 * {_LOCUS} AS STRING), ',', CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END, ',',
            CAST(CAST(l_quantity AS BIGINT) * 40 + 100 AS STRING), 'M50S,', CAST(40 + l_partkey % 21 AS STRING), ',3;',
            CASE WHEN l_linenumber = 3 THEN 'chr9,5000,-,*,60,0;' ELSE '' END) END AS sa,
       CAST(8 + round(l_discount * 100) AS DOUBLE) AS qs,
       CASE WHEN {_FILE} % 4 = 0 THEN concat('run', CAST({_FILE} % 3 AS STRING), '_barcode', CAST({_FILE} % 3 + 7 AS STRING))
            ELSE concat('run', CAST({_FILE} % 3 AS STRING)) END AS rg,
       l_shipdate AS st
FROM {{lineitem}}""",
    "read_groups": f"""
SELECT file, concat('@RG', chr(9), 'ID:run', CAST(n % 3 AS STRING), '_hac', chr(9), 'DT:2024-01-', CASE WHEN n % 28 + 1 < 10 THEN '0' ELSE '' END, CAST(n % 28 + 1 AS STRING), 'T08:00:00Z', chr(9),
       'DS:runid=run', CAST(n % 3 AS STRING), ' basecall_model=dna_r10_hac@v', CAST(n % 4 AS STRING), chr(9),
       CASE WHEN n % 7 = 0 THEN '' ELSE concat('LB:lib', CAST(n % 3 AS STRING), chr(9)) END,
       'PL:ONT', chr(9), 'PM:P2-', CAST(n % 2 AS STRING), chr(9), 'PU:FC', CAST(n % 6 AS STRING), chr(9), 'al:ref', CAST(n % 2 AS STRING)) AS header
FROM (SELECT DISTINCT {_div('o_orderkey', 300)} AS n,
             concat(CASE WHEN {_div('o_orderkey', 300)} % 5 = 0 THEN 'fail' ELSE 'pass' END, '_', CAST({_div('o_orderkey', 300)} AS STRING), '.bam') AS file
      FROM {{orders}}) f""",
    "regions": f"""
SELECT {_chrom('p_partkey % 25')} AS chrom,
       99500 + 2000 * {_PLOCUS} + (p_size % 10) * 100 AS start_pos,
       101000 + 2000 * {_PLOCUS} + (p_size % 10) * 100 AS end_pos,
       concat('G', CAST((p_partkey % 25) * 2 + {_PLOCUS} % 2 AS STRING)) AS name,
       concat('T', CAST(p_partkey AS STRING)) AS target_id,
       CASE WHEN p_size % 3 = 0 THEN '+' WHEN p_size % 3 = 1 THEN '-' ELSE '.' END AS strand,
       CASE WHEN p_size % 4 = 0 THEN 'target' ELSE 'genome' END AS region_type
FROM {{part}}""",
    "fusion_hits": f"""
SELECT concat('s', CAST({_FILE} % 3 AS STRING)) AS sample_id, concat('r', CAST(l_orderkey AS STRING)) AS read_id,
       concat('G', CAST((l_partkey % 25) * 2 + {_LOCUS} % 2 AS STRING)) AS gene, {_chrom('l_partkey % 25')} AS chrom,
       100000 + 2000 * ({_LOCUS} % 4) + (l_suppkey * 37) % 400 AS ref_start,
       100000 + 2000 * ({_LOCUS} % 4) + (l_suppkey * 37) % 400 + 150 + CAST(l_quantity AS BIGINT) * 40 AS ref_end,
       CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CAST(40 + l_suppkey % 21 AS INT) AS mapq, 150 + CAST(l_quantity AS BIGINT) * 40 AS mapping_span
FROM {{lineitem}}""",
    "genome": f"""
SELECT {_chrom('p_partkey % 25')} AS chrom, 110000 + 2000 * max({_PLOCUS}) AS length
FROM {{part}} GROUP BY 1""",
    "mod_calls": f"""
SELECT concat('s', CAST(user_id % 3 AS STRING)) AS sample_id, concat('m', CAST(user_id AS STRING)) AS read_id,
       CASE WHEN event_id % 7 = 6 THEN 'chr10' ELSE concat('chr', CAST(event_id % 7 + 1 AS STRING)) END AS chrom,
       CASE WHEN event_id % 7 = 6 THEN 129467200 + event_id % 80
            ELSE 10000 + (event_id % 40) * 26 + 1040 * {_div('event_id', 2500)} END AS pos,
       CASE WHEN {_div('event_id', 80)} % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CASE WHEN event_id % 3 = 0 THEN 'h' ELSE 'm' END AS mod_code,
       CAST(floor(value * 2.56) AS BIGINT) % 256 AS prob,
       ts
FROM {{events}}""",
    "meth_rows": f"""
SELECT concat('s', CAST(user_id % 3 AS STRING)) AS sample_id, concat('batch_', CAST({_div('event_id', 1000)} AS STRING)) AS file,
       CASE WHEN event_id % 7 = 6 THEN 'chr10' ELSE concat('chr', CAST(event_id % 7 + 1 AS STRING)) END AS chrom,
       CASE WHEN event_id % 7 = 6 THEN 129467200 + event_id % 80
            ELSE 10000 + (event_id % 40) * 26 + 1040 * {_div('event_id', 2500)} END AS pos,
       CASE WHEN {_div('event_id', 80)} % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CASE WHEN event_id % 5 = 0 THEN 'h' ELSE 'm' END AS mod_code,
       10 + user_id % 20 AS valid_cov,
       CAST(floor(value) AS BIGINT) % 11 AS n_mod,
       10 + user_id % 20 - CAST(floor(value) AS BIGINT) % 11 AS n_canonical,
       100.0E0 * (CAST(floor(value) AS BIGINT) % 11) / (10 + user_id % 20) AS percent_modified
FROM {{events}}""",
    "probes": f"""
SELECT concat('cg', CAST(o_orderkey AS STRING)) AS probe_name,
       concat('chr', CAST(o_orderkey % 7 + 1 AS STRING)) AS chrom,
       10000 + {_div('o_orderkey', 7)} * 26 AS start_pos, 10000 + {_div('o_orderkey', 7)} * 26 + 1 AS end_pos
FROM {{orders}}""",
    "cnv_starts": f"""
SELECT concat('s', CAST(o_orderkey % 3 AS STRING)) AS sample_id,
       {_chrom("(CASE WHEN o_custkey % 24 = 9 AND o_orderstatus <> 'P' THEN 6 ELSE o_custkey % 24 END)", 24)} AS chrom,
       (CASE WHEN o_totalprice > 400000 THEN o_orderkey % 10 ELSE o_orderkey % 50 END) * 1000000 + o_custkey % 1000000 AS ref_start,
       CASE WHEN o_orderpriority = '5-LOW' THEN 55 ELSE 60 END AS mapq
FROM {{orders}}""",
    "pileup_bases": f"""
SELECT concat('s', CAST(l_orderkey % 3 AS STRING)) AS sample_id, concat('r', CAST(l_orderkey AS STRING)) AS read_id,
       concat('chr', CAST(l_partkey % 4 + 1 AS STRING)) AS chrom,
       100001 + 8 * {_div('l_partkey', 8)} + l_partkey % 4 AS pos,
       CASE l_suppkey % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'G' WHEN 2 THEN 'T' WHEN 3 THEN 'N' ELSE 'C' END AS base,
       CAST(l_quantity AS INT) AS qual, l_linenumber = 7 AS is_del
FROM {{lineitem}}""",
    "vcf": f"""
SELECT concat('chr', CAST(p_partkey % 4 + 1 AS STRING)) AS chrom, 100001 + 8 * {_div('p_partkey', 8)} + p_partkey % 4 AS pos,
       concat('rs', CAST(p_partkey AS STRING)) AS id,
       'C' AS ref, CASE p_partkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'G' ELSE 'CA' END AS alt,
       CAST(p_size AS DOUBLE) AS qual, CASE WHEN p_size % 4 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter,
       concat('CLNSIG=', CASE p_partkey % 5 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic' WHEN 2 THEN 'Benign' WHEN 3 THEN 'Conflicting_classifications_of_pathogenicity' ELSE 'Uncertain_significance' END,
              CASE WHEN p_partkey % 5 = 3 THEN CASE WHEN p_partkey % 2 = 0 THEN ';CLNSIGCONF=Pathogenic(3)|Benign(1)' ELSE ';CLNSIGCONF=Pathogenic(1)|Benign(2)' END ELSE '' END,
              ';GENEINFO=G', CAST({_div('p_partkey', 8)} % 50 AS STRING), ':', CAST({_div('p_partkey', 8)} % 50 AS STRING),
              ';ANN=T|missense_variant|MODERATE|G', CAST({_div('p_partkey', 8)} % 50 AS STRING), '|ID|transcript|NM1|coding|1/2|c.1C>T|p.A1V|1/9|1/9|1/3||,T|intron_variant|MODIFIER|G', CAST({_div('p_partkey', 8)} % 50 AS STRING), '|ID|transcript|NM2|coding|1/2|c.2C>T||||||') AS info,
       'GT:DP:AF' AS format, concat(CASE WHEN p_size % 2 = 0 THEN '0/1' ELSE '1/1' END, ':', CAST(p_size AS STRING), ':0.5') AS gt
FROM {{part}}""",
    "job_events": """
SELECT concat('s', CAST(o_custkey % 7 AS STRING)) AS sample_id, o_orderkey AS job_id,
       CASE o_custkey % 5 WHEN 0 THEN 'cnv' WHEN 1 THEN 'fusion' WHEN 2 THEN 'mgmt' WHEN 3 THEN 'target' ELSE 'preprocessing' END AS job_type,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'failed' END AS status,
       CASE WHEN o_custkey % 2 = 0 THEN 'live' ELSE 'existing' END AS origin,
       o_orderdate AS ts, o_totalprice / 1000 AS duration_seconds
FROM {orders}""",
    "class_scores": """
SELECT concat('s', CAST(o_custkey % 7 AS STRING)) AS sample_id,
       CASE o_custkey % 2 WHEN 0 THEN 'sturgeon' ELSE 'random_forest' END AS classifier,
       o_orderkey % 20 AS batch_id, concat('class_', CAST(o_custkey % 12 AS STRING)) AS class_name,
       max((o_orderkey * 7919) % 1000) / 1000.0E0 AS score
FROM {orders} GROUP BY 1, 2, 3, 4""",
    "target_batches": f"""
SELECT concat('s', CAST(l_orderkey % 3 AS STRING)) AS sample_id, 1700000000000 + 60000 * (l_orderkey % 12) AS ts,
       {_chrom('l_partkey % 25')} AS chrom, 99500 + 2000 * {_LOCUS} AS start_pos, 101000 + 2000 * {_LOCUS} AS end_pos,
       concat('T', CAST(l_partkey AS STRING)) AS name,
       sum(150 + CAST(l_quantity AS BIGINT) * 40) AS bases, count(*) AS reads
FROM {{lineitem}} GROUP BY 1, 2, 3, 4, 5, 6""",
    "target_coverage": """
SELECT sample_id, chrom, start_pos, end_pos, name, bases, end_pos - start_pos + 1 AS length,
       bases * 1.0E0 / (end_pos - start_pos + 1) AS coverage
FROM (SELECT sample_id, chrom, start_pos, end_pos, name, sum(bases) AS bases FROM target_batches GROUP BY 1, 2, 3, 4, 5) t""",
    "genome_batches": f"""
SELECT concat('s', CAST(l_orderkey % 3 AS STRING)) AS sample_id, concat('b', CAST({_div('l_orderkey', 3000)} AS STRING)) AS file,
       {_chrom('l_partkey % 25')} AS chrom, CAST(1 AS BIGINT) AS start_pos, CAST(250000 AS BIGINT) AS end_pos,
       count(*) AS numreads, sum(CAST(l_quantity AS BIGINT) * 30) AS covbases,
       sum(CAST(l_quantity AS BIGINT) * 40) / 250000.0E0 AS meandepth
FROM {{lineitem}} GROUP BY 1, 2, 3""",
    "cytobands": """
SELECT concat('chr', CASE c WHEN 22 THEN 'X' WHEN 23 THEN 'Y' ELSE CAST(c + 1 AS STRING) END) AS chrom,
       b * 5000000 AS start_pos, (b + 1) * 5000000 AS end_pos,
       concat(CASE WHEN b < 4 THEN 'p' ELSE 'q' END, CAST(CASE WHEN b < 4 THEN 4 - b ELSE b - 3 END AS STRING)) AS band,
       CASE WHEN b IN (3, 4) THEN 'acen' ELSE 'gneg' END AS stain
FROM (SELECT DISTINCT o_custkey % 24 AS c, o_orderkey % 10 AS b FROM {orders}) x""",
    "cnv_genes": f"""
SELECT concat('chr', CASE p_partkey % 24 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' ELSE CAST(p_partkey % 24 + 1 AS STRING) END) AS chrom,
       ({_div('p_partkey', 24)} * 613000) % 49000000 AS start_pos, ({_div('p_partkey', 24)} * 613000) % 49000000 + 20000 AS end_pos,
       concat('GENE', CAST(p_partkey % 20000 AS STRING)) AS gene
FROM {{part}}""",
}


def _needed(body: str) -> list[str]:
    """Views a text uses, directly or through other views, in definition order."""
    found: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[A-Za-z_]\w*", todo.pop()))
        for name in words & VIEWS.keys() - found:
            found.add(name)
            todo.append(VIEWS[name])
    # a view may only use views that are defined before it
    return [name for name in VIEWS if name in found]


def _fill(text: str, sf_dir: str | None) -> str:
    for table in TABLES:
        target = table if sf_dir is None else f"parquet.`{sf_dir.rstrip('/')}/{table}.parquet`"
        text = text.replace("{" + table + "}", target)
    return text


def with_views(body: str, sf_dir: str | None = None) -> str:
    """``body`` with a WITH clause for every view it names.

    ``body`` may itself start with WITH (or WITH RECURSIVE).
    """
    body = body.strip()
    names = _needed(body)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    head = re.match(r"WITH(\s+RECURSIVE)?\s", body, re.I)
    if head:
        rest = body[head.end():]
        text = f"{head.group(0)}{ctes + ',' if ctes else ''}\n{rest}"
    else:
        text = f"WITH {ctes}\n{body}" if ctes else body
    return _fill(text, sf_dir)


class Views:
    """Attribute access to the derived views as Spark DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.spark.sql(with_views(f"SELECT * FROM {name}", self.sf_dir))

    def sql(self, body: str) -> DataFrame:
        return self.spark.sql(with_views(body, self.sf_dir))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
