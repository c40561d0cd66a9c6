"""Markdown reports out of orders and line items: one document per order, in eight shapes (o_orderkey % 8).

The SQL is the same for Spark and DuckDB but for the ordered aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mdloom.session import dealt, table, tasks_for

_NL = "chr(10)"
#: shape -> (text before, text of a row, text after), as SQL.
SHAPES = {
    0: ("concat('# Order ', k, NL, NL, '| part | supp | qty | flag |', NL, '|---|:-:|---|---|')", "concat('| ', p, ' | ', s, ' | ', q, ' | ', f, ' |')", "concat(NL, 'end')"),
    1: ("concat('Order ', k, NL, '| part |  | qty |  | note | flag |', NL, '|---|---|---|---|---|---|')", "concat('| ', p, ' |  | ', q, ' |  |  | ', f, ' |')", "concat(NL, NL, 'total')"),
    2: ("concat('| A |  | C |  | E |  | G |  | I |  |', NL, '|---|---|---|---|---|---|---|---|---|---|', NL, '|  | **b** |  | **d** |  |  |  |  |  | ** |', NL, '|  | **x** |  |  |  | **f  g** |  |  |  |  |')", "concat('| ', p, ' | **', s, '** | ', q, ' | ', f, ' |  | ', c, ' | ', t, ' |  | ', n, ' | - ', p, ' |')", "concat(NL, 'end')"),
    3: ("concat('Report ', k, NL, '| part | text | flag |', NL, '|---|---|---|')", "concat('| ', p, ' | ', repeat(concat('item ', q, '  - ', s, '  1. ', p, '  ', t, '   '), 8), ' | ', f, ' |')", "concat(NL, NL, NL)"),
    4: ("concat('| h1 | h2 | h3 | h4 | h5 | h6 | h7 | h8 | h9 |', NL, '|---|---|---|---|---|---|---|---|---|')", "CASE WHEN n <= 3 THEN concat('| **', p, '** | **', s, '** |  | **', q, '** |  |  |  |  | **', f, '** |') END", "concat(NL, 'bold')"),
    5: ("concat('no rule', NL, '| part | supp |')", "concat('| ', p, ' | ', s, ' |  |')", "concat(NL, '|')"),
    6: ("concat('# ', k, chr(13), NL, chr(9), '| a | b |  | ** |', '   ', chr(13), NL, '|---|---|---|---|', chr(13))", "CASE n % 4 WHEN 0 THEN '|  |  |' WHEN 1 THEN concat('| ', p, ' |  ') WHEN 2 THEN concat('  | ', s, ' | ', q, ' |  |  | ', chr(13)) ELSE concat('|', f, '|', t, '| **|') END", "concat(NL, NL, ' ', NL, NL, NL, NL, '| x |  |', NL, '|-|-|', NL, '|', k, '|', NL, '  ')"),
    7: ("concat('Order ', k)", "concat('part ', p, ' | qty ', q, '  ')", "''"),
}


def lines_of_orders() -> str:
    """SELECT of an order's items: its key k, the items' columns under one letter, and their number n."""
    return """SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, CAST(floor(l_quantity) AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS c, l_returnflag AS f, l_linestatus AS t,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem"""


def html_pages_sql() -> str:
    """SELECT page_id, html for Spark: one page per order, with a table whose header and rows span, in three shapes (k % 3)."""
    head = """concat('<!-- <table> --><script>if (a < b) "</p>"</script><h2 title="x>y">Order&nbsp;', k, '</h2><p>See <a class=q href="/o/', k, '?a=1&amp;b=2">order <b>', k, '</b></a> &mdash; it&#39;s <em>here</em></p>
        <ol start=2><li>one<li>two<ul><li>deep</ul></ol><table border=1><caption>Items of ', k, '</caption><thead><tr><th rowspan=2>part</th><th colspan="2">amounts</th>',
        CASE k % 3 WHEN 1 THEN '<th rowspan=2></th>' WHEN 2 THEN '<th colspan=9>notes</th>' ELSE '' END, '</tr><tr><th>qty<th>price</thead><tbody>')"""
    row = """CASE n % 3 WHEN 1 THEN concat('<tr><td rowspan=2>', p, '<td>', q, '<br>', f, '<td>', c, '</tr>') WHEN 2 THEN concat('<tr><td>', q, ' &lt; |</td><td><table><tr><td>', f, '<td>', t, '<tr><td>x</table></td></tr>')
        ELSE concat('<tr><td>', p, '</td><td colspan=2 class="a>b">', s, '</td></tr>') END"""
    return f"""SELECT k AS page_id, concat(max({head}), listagg({row}, '') WITHIN GROUP (ORDER BY n), '</tbody></table><p>end <img alt="z" src=/i.png></p><pre>\n a\n\n  b</pre>') AS html FROM ({lines_of_orders()}) GROUP BY k"""


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return spark.sql(html_pages_sql().replace("FROM lineitem", "FROM {lineitem}"), lineitem=dealt(items, tasks_for(items), "l_orderkey"))


def reports_sql(spark: bool) -> str:
    """SELECT doc_id, content over orders and lineitem."""
    case = lambda i: "CASE o.o_orderkey % 8 " + " ".join(f"WHEN {k} THEN {v[i]}" for k, v in SHAPES.items()) + " END"
    text = (case(0), case(1), case(2))
    head, row, tail = (x.replace("NL", _NL) for x in text)
    joined = f"listagg(line, {_NL}) WITHIN GROUP (ORDER BY n)" if spark else f"string_agg(line, {_NL} ORDER BY n)"
    return f"""
    SELECT k AS doc_id, concat(max(head), {_NL}, {joined}, max(tail)) AS content
    FROM (SELECT k, n, {head} AS head, {row} AS line, {tail} AS tail
          FROM (SELECT l_orderkey AS k, l_orderkey, l_partkey AS p, l_suppkey AS s, CAST(floor(l_quantity) AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS c, l_returnflag AS f, l_linestatus AS t,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem) l
          JOIN (SELECT o_orderkey FROM orders) o ON o.o_orderkey = l.k) x
    GROUP BY k"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: raw Markdown with tables of every kind. Items and orders are dealt alike, so the rows move before they become
    texts, and only then."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = tasks_for(items)
    return spark.sql(reports_sql(True).replace("FROM lineitem", "FROM {lineitem}").replace("FROM orders", "FROM {orders}"), lineitem=dealt(items, n, "l_orderkey"), orders=dealt(orders, n, "o_orderkey"))


def roughened_sql() -> str:
    """documents with line ends that need cleaning."""
    return "SELECT doc_id, replace(text, chr(10), concat('  ', chr(13), chr(10), chr(9), chr(10), chr(10), chr(13), chr(13), chr(10))) AS content FROM documents"


def roughened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(roughened_sql().replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))
