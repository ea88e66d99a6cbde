"""SQL fragments for the oracle side: the same stand-in shapes as
``hearth.sources.tables``, written independently in DuckDB SQL."""

SPLIT = "(CASE WHEN substr(md5(CAST({k} AS VARCHAR)), 1, 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END)"

HH = f"""hh AS (
  SELECT c_custkey AS id,
         CASE c_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS country,
         CASE WHEN {SPLIT.format(k='c_custkey')} = 'train' THEN c_acctbal < 0 END AS poor,
         c_mktsegment,
         c_nationkey,
         {SPLIT.format(k='c_custkey')} AS _split
  FROM customer)"""

IND = f"""ind AS (
  SELECT o_custkey AS id, o_orderkey AS iid, o_orderstatus, o_totalprice, o_orderpriority,
         {SPLIT.format(k='o_custkey')} AS _split
  FROM orders)"""

# households with num_indiv
NI = """ni AS (
  SELECT hh.*, coalesce(c.n, 0) AS num_indiv
  FROM hh LEFT JOIN (SELECT id, count(*) AS n FROM ind GROUP BY id) c ON hh.id = c.id)"""

# deterministic score for metric queries (FIXTURES.md)
SC = """sc AS (
  SELECT ni.*, 1.0 / (1.0 + exp(-(num_indiv - 10) / 3.0)) AS p FROM ni)"""

BASE = f"WITH {HH},\n{IND},\n{NI},\n{SC}\n"

# labelled documents as a train/test shaped household table
DOCS = """docs AS (
  SELECT d.doc_id AS id, 'A' AS country, (l.toxic = 1) AS poor, d.n_chars, d.lang, d.source,
         CASE WHEN l.toxic IS NULL THEN 'test' ELSE 'train' END AS _split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def hexint(expr: str, digits: int) -> str:
    """Integer value of the first ``digits`` hex characters of an md5 string."""
    return f"CAST(('0x' || substr({expr}, 1, {digits})) AS BIGINT)"


def md5_key(cols: list[str], seed) -> str:
    parts = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5({parts} || '|{seed}')"
