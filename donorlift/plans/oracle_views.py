"""SQL twins of the stand-in views, for the DuckDB oracle.

Each view is written independently of the Spark code in
``donorlift.sources.standin``; both follow the same definitions.  REF month
index: 2001 * 12 + 7 - 1 = 24018.
"""

from __future__ import annotations

REF_MONTH = 24018

MONTH_IDX = "(year({d}) * 12 + month({d}) - 1)"


def month_idx(d: str) -> str:
    return MONTH_IDX.format(d=d)


VIEWS: dict[str, tuple[list[str], str]] = {
    "members": ([], """
SELECT c.c_custkey AS member_id, c.c_mktsegment AS segment, n.n_name AS nation,
       r.r_name AS region, c.c_acctbal AS acctbal
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "gifts": ([], """
SELECT o_custkey AS member_id, o_orderkey AS gift_id, CAST(o_orderdate AS DATE) AS gift_date,
       o_totalprice AS amount
FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01 00:00:00'"""),
    "targets": ([], """
SELECT c.c_custkey AS member_id,
       CAST(CASE WHEN r.amt IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS target_b,
       CAST(COALESCE(r.amt, 0) AS DOUBLE) AS target_d
FROM customer c LEFT JOIN (
  SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS amt
  FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01 00:00:00' GROUP BY o_custkey
) r ON c.c_custkey = r.o_custkey"""),
    "history": (["gifts"], f"""
SELECT g.member_id, g.i,
       CAST(DATE '2001-07-01' - to_months(3 * (g.i - 2)) AS DATE) AS send_date,
       c.rdate, c.ramnt
FROM (SELECT c_custkey AS member_id, CAST(UNNEST(range(3, 25)) AS INTEGER) AS i FROM customer) g
LEFT JOIN (
  SELECT member_id, i, MIN(gift_date) AS rdate,
         CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS ramnt
  FROM (SELECT *, CAST(ceil(({REF_MONTH} - {month_idx('gift_date')}) / 3) AS INTEGER) + 2 AS i
        FROM gifts)
  WHERE i BETWEEN 3 AND 24
  GROUP BY member_id, i
) c ON g.member_id = c.member_id AND g.i = c.i"""),
    "first_gift": ([], """
SELECT o_custkey AS member_id, MIN(CAST(o_orderdate AS DATE)) AS first_date
FROM orders GROUP BY o_custkey"""),
    "raw_members": (["first_gift"], """
SELECT c.c_custkey AS member_id,
  CASE WHEN c.c_custkey % 7 = 0 AND starts_with(strftime(f.first_date, '%y%m'), '0')
       THEN substr(strftime(f.first_date, '%y%m'), 2, 3)
       ELSE strftime(f.first_date, '%y%m') END AS odate,
  CASE WHEN c.c_custkey % 11 = 0
       THEN lpad(CAST((c.c_custkey * 37) % 99999 AS VARCHAR), 5, '0') || '-'
       ELSE lpad(CAST((c.c_custkey * 37) % 99999 AS VARCHAR), 5, '0') END AS zip,
  CASE c.c_custkey % 5 WHEN 0 THEN 'X' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN ' ' END AS flag,
  CASE WHEN c.c_custkey % 13 = 0
       THEN substr('FNALIS', CAST(c.c_custkey % 6 + 1 AS INTEGER), 1) || CAST(c.c_custkey % 4 + 1 AS VARCHAR)
       ELSE substr('FNALIS', CAST(c.c_custkey % 6 + 1 AS INTEGER), 1) || CAST(c.c_custkey % 4 + 1 AS VARCHAR)
            || substr('ABCDEFG', CAST(c.c_custkey % 7 + 1 AS INTEGER), 1) END AS rfa,
  substr('UCSTR', CAST(c.c_custkey % 5 + 1 AS INTEGER), 1) || CAST(c.c_custkey % 4 + 1 AS VARCHAR) AS domain
FROM customer c LEFT JOIN first_gift f ON c.c_custkey = f.member_id"""),
    "scored": (["targets", "gifts"], f"""
SELECT t.member_id,
       CAST(COALESCE(a.recent, 0) AS DOUBLE) / (COALESCE(a.n_all, 0) + 1) AS p,
       CAST(a.s AS DOUBLE) / a.n_all AS d_hat,
       t.target_b, t.target_d
FROM targets t LEFT JOIN (
  SELECT member_id,
         COUNT(CASE WHEN {REF_MONTH} - {month_idx('gift_date')} <= 24 THEN 1 END) AS recent,
         COUNT(*) AS n_all,
         SUM(CAST(amount AS DECIMAL(18,2))) AS s
  FROM gifts GROUP BY member_id
) a ON t.member_id = a.member_id"""),
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(views: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """Prefix ``body`` with a WITH clause holding the named views (and their
    dependencies) followed by ``extra`` (name, sql) CTEs."""
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _closure(views)]
    parts += [f"{n} AS ({sql}\n)" for n, sql in extra]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
