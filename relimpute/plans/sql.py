"""Fragments of the ANSI SQL that the registered queries are checked against."""

from __future__ import annotations

from hashlib import md5

from relimpute.functions.text import LONG_TEXT

BOUND_20 = "33333333"

KEYS = {
    "region": ("r_regionkey", {}),
    "nation": ("n_nationkey", {"n_regionkey": "region"}),
    "customer": ("c_custkey", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", {"s_nationkey": "nation"}),
    "part": ("p_partkey", {}),
    "orders": ("o_orderkey", {"o_custkey": "customer"}),
    "lineitem": ("row_id", {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": ("event_id", {"user_id": "customer"}),
    "documents": ("doc_id", {}),
    "labels": ("doc_id", {"doc_id": "documents"}),
    "conversations": ("conv_id__turn", {}),
}

# (column, kind) with kind i = whole number, d = double, s = string, t = timestamp
COLUMNS = {
    "region": [("r_regionkey", "i"), ("r_name", "s")],
    "nation": [("n_nationkey", "i"), ("n_name", "s"), ("n_regionkey", "i")],
    "customer": [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "d"), ("c_mktsegment", "s")],
    "supplier": [("s_suppkey", "i"), ("s_name", "s"), ("s_nationkey", "i"), ("s_acctbal", "d")],
    "part": [("p_partkey", "i"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "i"), ("p_retailprice", "d")],
    "orders": [
        ("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "d"), ("o_orderdate", "t"),
        ("o_orderpriority", "s"), ("o_custkey_c_name", "s"), ("o_custkey_c_acctbal", "d"),
    ],
    "events": [("event_id", "i"), ("ts", "t"), ("user_id", "i"), ("event_type", "s"), ("value", "d"), ("props", "s")],
    "labels": [("doc_id", "i"), ("quality", "i"), ("toxic", "i")],
    "lineitem": [
        ("row_id", "s"), ("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"), ("l_quantity", "d"), ("l_extendedprice", "d"),
        ("l_discount", "d"), ("l_tax", "d"), ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t"),
    ],
    "documents": [("doc_id", "i"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "i")],
    "conversations": [("conv_id", "i"), ("turn", "i"), ("role", "s"), ("text", "s")],
}
KEY_PARTS = ("conv_id", "turn")

DTYPES = {"i": "bigint", "d": "double", "s": "string", "t": "timestamp"}


def draw(key: str, name: str, seed: int = 42) -> str:
    return f"md5(concat_ws(':', CAST({key} AS VARCHAR), {name}, '{seed}'))"


def masked(key: str, column: str, bound: str = BOUND_20) -> str:
    return f"CASE WHEN substring({draw(key, repr(column))},1,8) < '{bound}' THEN NULL ELSE {column} END AS {column}"


def text(column: str, kind: str) -> str:
    if kind == "s":
        return column
    if kind == "d":
        return (
            f"CASE WHEN {column} = floor({column}) AND abs({column}) < 1e15 THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({column} AS VARCHAR) END"
        )
    return f"CAST({column} AS VARCHAR)"


def path_id(label: str) -> str:
    return md5(label.encode()).hexdigest()[:8]


LINEITEM_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()
ROW_ID = "md5(concat_ws('|'," + ",".join(f"CAST({c} AS VARCHAR)" for c in LINEITEM_COLUMNS) + "))"

LI = f"li AS (SELECT *, {ROW_ID} AS row_id FROM lineitem)"
ORD_D = (
    "ord_d AS (SELECT o.*, c.c_name AS o_custkey_c_name, c.c_acctbal AS o_custkey_c_acctbal "
    "FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"
)
CUST_D = (
    "cust_d AS (SELECT c.*, n.n_name AS c_nationkey_n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"
)
SUPP_D = (
    "supp_d AS (SELECT s.*, n.n_name AS s_nationkey_n_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey)"
)
ORDER_ATTRIBUTES = ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey_c_name", "o_custkey_c_acctbal"]
CUSTOMER_ATTRIBUTES = ["c_name", "c_acctbal", "c_mktsegment", "c_nationkey_n_name"]
ORD_X = f"{ORD_D}, ord_x AS (SELECT o_orderkey, o_custkey, " + ", ".join(masked("o_orderkey", a) for a in ORDER_ATTRIBUTES) + " FROM ord_d)"
CUST_X = f"{CUST_D}, cust_x AS (SELECT c_custkey, c_nationkey, " + ", ".join(masked("c_custkey", a) for a in CUSTOMER_ATTRIBUTES) + " FROM cust_d)"


def source(table: str) -> str:
    return {"orders": "ord_d", "lineitem": "li"}.get(table, table)


def is_key(table: str, column: str) -> bool:
    pk, fks = KEYS[table]
    return column == pk or column in fks or (table == "conversations" and column in KEY_PARTS)


def cell_values(tables: list[str], keys: bool = True) -> str:
    """Distinct (t, c, k, v) of all columns; `k` marks keys."""
    parts = []
    for t in tables:
        for c, kind in COLUMNS[t]:
            if keys or not is_key(t, c):
                parts.append(
                    f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {str(is_key(t, c)).lower()} AS k, {text(c, kind)} AS v "
                    f"FROM {source(t)} WHERE {c} IS NOT NULL"
                )
    return " UNION ALL ".join(parts)


def containment(tables: list[str]) -> str:
    """CTEs `cv`, `nd` and `idx` (t1, c1, t2, c2, score)."""
    return (
        f"{ORD_D}, {LI}, cv AS MATERIALIZED ({cell_values(tables)}), nd AS (SELECT t, c, count(*) AS n FROM cv GROUP BY t, c), "
        "pr AS (SELECT a.t AS t1, a.c AS c1, a.k AS k1, b.t AS t2, b.c AS c2, b.k AS k2, count(*) AS common "
        "FROM cv a JOIN cv b ON a.v = b.v AND a.t <> b.t GROUP BY ALL), "
        "idx AS (SELECT t1, c1, t2, c2, CAST(common AS DOUBLE) / n AS score FROM pr JOIN nd ON t1 = nd.t AND c1 = nd.c WHERE NOT k1)"
    )


def signatures(tables: list[str], permutations: int = 128) -> str:
    """CTEs of `containment` and `sg` (t, c, k, n, signature): the least hash of a column under every mask."""
    masks = ", ".join(f"({i}, {int(md5(str(i).encode()).hexdigest()[:15], 16)})" for i in range(permutations))
    short = f"CASE WHEN length(v) > {LONG_TEXT} THEN '#' || sha256(v) ELSE v END"
    return (
        f"{containment(tables)}, mk(i, m) AS (VALUES {masks}), "
        f"hv AS MATERIALIZED (SELECT t, c, k, CAST('0x' || substr(md5({short}), 1, 15) AS BIGINT) AS h FROM cv), "
        "lw AS (SELECT t, c, k, i, min(xor(h, CAST(m AS BIGINT))) AS low FROM hv, mk GROUP BY ALL), "
        "sg AS MATERIALIZED (SELECT t, c, k, CAST(greatest(1, floor(CAST(1099511627776 * " + str(permutations) + " AS DOUBLE) / greatest(sum(low // 1048576), 1)) - 1) AS BIGINT) AS n, "
        "list(low ORDER BY i) AS signature FROM lw GROUP BY t, c, k)"
    )


def lsh(tables: list[str], threshold: float = 0.3, partitions: int = 32) -> str:
    """CTEs of `signatures` and `hits` (t1, c1, t2, c2): columns that agree on a band of the width their sizes ask for."""
    width = " ".join(f"WHEN 1 - pow(1 - pow(least(1.0, {threshold} / (1 + u / q - {threshold})), {r}), {128 // r}) >= 0.95 THEN {r}" for r in (8, 4, 2))
    same = "len(list_filter(range(0, 128 // r), lambda i: list_slice(a.signature, i * r + 1, i * r + r) = list_slice(b.signature, i * r + 1, i * r + r))) > 0"
    return (
        f"{signatures(tables)}, sz AS (SELECT *, ntile({partitions}) OVER (ORDER BY n, t, c) AS part FROM sg), "
        "up AS (SELECT part, CAST(max(n) AS DOUBLE) AS u FROM sz GROUP BY part), "
        f"qs AS (SELECT t, c, k, signature, part, CASE {width} ELSE 1 END AS r FROM (SELECT *, CAST(n AS DOUBLE) AS q FROM sg), up), "
        f"hits AS (SELECT DISTINCT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2 FROM qs a JOIN sz b USING (part) WHERE a.t <> b.t AND {same})"
    )


COMPATIBLE = (
    "comp AS (SELECT t1, c1, t2, c2, max(score) AS score FROM (SELECT * FROM idx WHERE score > 0.9 UNION ALL "
    "SELECT t2, c2, t1, c1, score FROM idx WHERE score > 0.9) GROUP BY t1, c1, t2, c2)"
)


def edge_values(tables: list[str] | None = None) -> str:
    rows = []
    for src, (_, fks) in KEYS.items():
        for column, dst in fks.items():
            if tables is None or (src in tables and dst in tables):
                key = KEYS[dst][0]
                rows.append(f"('{src}','{column}','{dst}','{key}')")
                rows.append(f"('{dst}','{key}','{src}','{column}')")
    return ", ".join(rows)


def path_search(start: str, tables: list[str] | None = None, per_goal: int = 3) -> str:
    """Recursive CTEs `walk` and `pth` (goal, label, hops). Goes first after WITH RECURSIVE."""
    return (
        f"steps(st, sc, dt, dc) AS (VALUES {edge_values(tables)}), "
        f"walk(spot, seen, label, hops) AS (SELECT '{start}', ['{start}'], '{start}', 0 UNION ALL "
        "SELECT dt, list_append(seen, dt), label || '>(' || sc || ',' || dc || ')>' || dt, hops + 1 "
        "FROM walk JOIN steps ON spot = st WHERE hops < 10 AND NOT list_contains(seen, dt)), "
        "pth AS (SELECT spot AS goal, label, hops FROM (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY hops, label) AS r "
        f"FROM walk WHERE hops > 0) WHERE r <= {per_goal})"
    )


def value_parts(key: str, columns: list[tuple[str, str]], source_: str) -> str:
    """(row_id, attr, slot, w): the hashed values of the rows of a table; kinds as in `COLUMNS`."""
    parts = []
    for c, kind in columns:
        v = text(c, kind)
        head = f"SELECT CAST({key} AS VARCHAR) AS row_id, '{c}' AS attr"
        parts.append(f"{head}, {v} AS token, 1.0::DOUBLE AS weight FROM {source_} WHERE {c} IS NOT NULL")
        if kind in "id":
            digits = f"length(regexp_extract({v}, '^-?([0-9]+)', 1))"
            parts.append(f"{head}, '#' || CASE WHEN {v} LIKE '-%' THEN '-' ELSE '' END || CAST({digits} AS VARCHAR), 0.5 FROM {source_} WHERE {c} IS NOT NULL")
    return (
        "SELECT row_id, attr, CAST(CAST('0x' || substring(md5(token),1,8) AS BIGINT) % 64 AS INTEGER) AS slot, "
        f"CASE WHEN substring(md5(token),9,1) < '8' THEN weight ELSE -weight END AS w FROM ({' UNION ALL '.join(parts)})"
    )


def dense(source_: str, by: str) -> str:
    """(`by`, e): the parts summed into unit vectors of 64 numbers."""
    return (
        f"SELECT {by}, list_transform(v, lambda x: x / CASE WHEN list_dot_product(v, v) > 0 THEN sqrt(list_dot_product(v, v)) ELSE 1 END) AS e FROM ("
        f"SELECT {by}, list(coalesce(w, 0.0::DOUBLE) ORDER BY i) AS v FROM (SELECT DISTINCT {by} FROM {source_}) CROSS JOIN range(64) AS t(i) "
        f"LEFT JOIN (SELECT {by}, slot, sum(w) AS w FROM {source_} GROUP BY ALL) USING ({by}, slot) GROUP BY {by})"
    ).replace(f"range(64) AS t(i) LEFT JOIN", "(SELECT range AS i, CAST(range AS INTEGER) AS slot FROM range(64)) LEFT JOIN")
