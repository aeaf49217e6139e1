"""SQL text shared by the oracle queries: the same derivation of the domain inputs."""

ORDER = (
    "l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice, "
    "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
)

GENOME = """
genome AS (
  SELECT node_id, 'chr' || CAST((node_id - 1) // 10 + 1 AS VARCHAR) AS seqnames,
         e - width + 1 AS s, e, width, cn
  FROM (SELECT *, CAST(sum(width) OVER (PARTITION BY (node_id - 1) // 10 ORDER BY node_id) AS BIGINT) AS e
        FROM (SELECT CAST(p_partkey % 120 AS INTEGER) + 1 AS node_id,
                     CAST(20000 + 500 * (sum(p_size) % 61) AS BIGINT) AS width,
                     CAST(max(p_size) % 4 + 1 AS INTEGER) AS cn
              FROM part GROUP BY 1)))"""

CUSTOMER_STEPS = f"""
steps AS (
  SELECT o_custkey AS kar_id, l_orderkey AS walk_id, o_orderstatus = 'P' AS circular,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS pos,
         count(*) OVER (PARTITION BY l_orderkey) AS n,
         CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * (l_partkey % 120 + 1) AS INTEGER) AS node
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ORDER_STEPS = f"""
steps AS (
  SELECT l_orderkey AS kar_id,
         l_orderkey * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS walk_id,
         l_returnflag = 'R' AS circular,
         row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {ORDER}) AS pos,
         count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n,
         CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * (l_partkey % 120 + 1) AS INTEGER) AS node
  FROM lineitem)"""

PAIRS = """
pairs AS (
  SELECT o_orderkey AS pair_id, o_orderkey AS kar_a, nxt AS kar_b
  FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt
        FROM orders) WHERE nxt IS NOT NULL)"""

CONTACTS = """
contacts AS (
  SELECT least(a, b) AS i, greatest(a, b) AS j, sum(q) AS value
  FROM (SELECT CAST(l_partkey % 120 + 1 AS INTEGER) AS a, CAST(l_suppkey % 120 + 1 AS INTEGER) AS b,
               l_quantity AS q FROM lineitem) GROUP BY 1, 2)"""
