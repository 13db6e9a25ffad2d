"""SQL text that other modules build their oracle queries from."""

from __future__ import annotations

COLUMNS = range(8)


def edges(column: str, table: str, where: str = "true", bins: int = 10) -> str:
    shares = ", ".join(f"{i * (1 / bins)!r}::double" for i in range(1, bins))
    return f"(select list_sort(list_distinct(quantile_cont({column}::double, [{shares}]))) from {table} where {where})"


def inner_edges(column: str, table: str, bins: int = 10) -> str:
    """Different quantiles without the least and the greatest value."""
    shares = ", ".join(f"{i * (1 / bins)!r}::double" for i in range(bins)) + ", 1.0::double"
    return f"(select list_sort(list_distinct(quantile_cont({column}::double, [{shares}])))[2:-2] from {table})"


def below(column: str, list_sql: str) -> str:
    return f"len(list_filter({list_sql}, lambda e: e <= {column}))"


#: raw rows and coded rows of the orders view, and its cells.
ORDERS = f"""
raw as (select o_orderkey tid, o_orderstatus, o_orderpriority, c_mktsegment, n_regionkey, o_orderdate, o_totalprice, c_acctbal
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
price as (select {inner_edges("o_totalprice", "orders")} e), balance as (select {edges("c_acctbal", "raw", "c_acctbal <> 0")} e),
ord as materialized (select tid, (dense_rank() over (order by o_orderstatus) - 1)::bigint a0, (dense_rank() over (order by o_orderpriority) - 1)::bigint a1,
        (dense_rank() over (order by c_mktsegment) - 1)::bigint a2, (dense_rank() over (order by n_regionkey) - 1)::bigint a3,
        (year(o_orderdate) - 1992)::bigint a4, (quarter(o_orderdate) - 1)::bigint a5, {below("o_totalprice", "price.e")}::bigint a6,
        (case when c_acctbal = 0 then 0 else 1 + {below("c_acctbal", "balance.e")} end)::bigint a7 from raw, price, balance),
cells as materialized ({" union all ".join(f"select tid, {k} attr, a{k} as value from ord" for k in COLUMNS)}),
histogram as materialized (select attr, value, count(*) n from cells group by attr, value)"""


def on_orders(body: str, *more: str) -> str:
    """body over the orders view's common tables; a body may bring common tables of its own."""
    return "with " + ",".join([ORDERS, *more]) + (", " + body[5:] if body.startswith("with ") else " " + body)


def uniform(tag: str) -> str:
    """The number in (0, 1) of a tag, given as SQL text."""
    return f"((('0x' || substr(sha256({tag}), 1, 13))::bigint + 0.5) / 4503599627370496.0)"


def uniform_cut(tag: str, place: str) -> str:
    """The number in (0, 1) at a place of the digest of a tag: four of them, of 13 hex digits each."""
    return f"((('0x' || substr(sha256({tag}), 1 + 13 * (({place}) % 4), 13))::bigint + 0.5) / 4503599627370496.0)"


def laplace(scale: str, tag: str) -> str:
    u = f"({uniform(tag)} - 0.5)"
    return f"(-({scale}) * sign({u}) * ln(1.0 - 2.0 * abs({u})))"


def tag(*parts: str) -> str:
    """Parts as SQL expressions, joined by bars."""
    return f"concat_ws('|', {', '.join(parts)})"


def splitmix(x: str) -> str:
    """The mixing step on an unsigned 64-bit value, in 128-bit arithmetic."""
    m = "18446744073709551616::uhugeint"
    one = f"((({x})::uhugeint + 11400714819323198485::uhugeint) % {m})"
    two = f"((xor({one}::ubigint, {one}::ubigint >> 30)::uhugeint * 13787848793156543929::uhugeint) % {m})"
    three = f"((xor({two}::ubigint, {two}::ubigint >> 27)::uhugeint * 10723151780598845931::uhugeint) % {m})"
    return f"xor({three}::ubigint, {three}::ubigint >> 31)"


def name(attrs: list[str], values: list[str]) -> str:
    """The text of an itemset with the given attribute and value expressions."""
    cells = " || ', ' || ".join(f"'a' || {a} || '=' || {v}" for a, v in zip(attrs, values, strict=True))
    return f"('{{' || {cells} || '}}')"


def itemset_counts(max_size: int, items: str = "items") -> str:
    """size, t (text), sort key columns and n of all itemsets of the given items, by self-joins of the cells on tid."""
    parts = []
    for size in range(1, max_size + 1):
        froms = ["picked c0"]
        for k in range(1, size):
            froms.append(f"join picked c{k} on c{k}.tid = c0.tid and c{k}.attr > c{k - 1}.attr")
        cells = ", ".join(f"c{k}.attr, c{k}.value" for k in range(size))
        key = ", ".join(f"{{'attr': c{k}.attr, 'value': c{k}.value}}" for k in range(size))
        t = name([f"c{k}.attr" for k in range(size)], [f"c{k}.value" for k in range(size)])
        parts.append(f"select {size} size, {t} t, [{key}] k, count(*) n from {' '.join(froms)} group by {cells}")
    return f"picked as materialized (select tid, c.attr, c.value from cells c join {items} i on c.attr = i.attr and c.value = i.value), sets as (" + " union all ".join(parts) + ")"
