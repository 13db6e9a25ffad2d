"""One query for each operator, over the orders view unless it says otherwise, and its SQL."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions import itemsets, prf
from .operators import binning, budget, candidates, circuits, counts, encode, estimate, keys, metrics, partition, randomizer, sketch, wire
from .oracle import laplace, name, on_orders, splitmix, tag, uniform, uniform_cut
from .plans import config, protocol
from .sources import archives, files, views
from .sources.views import read
from .streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 2026
#: A client's share of the histogram round at epsilon 1, and of the row number.
EPSILON, EPSILON_N, CLIENTS = 0.1125, 0.0125, 4
PARTS = ((0, 1), (2, 3), (4, 5), (6, 7))


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return views.orders_view(spark, d)


def _domain(wide: DataFrame) -> DataFrame:
    return encode.domains(wide)


def _round(c, digits: int = 6):
    return F.bround(c, digits)


# Sources and coders


@query("s1_coded_orders", on_orders("select * from ord"))
def _(spark, d):
    return _orders(spark, d)


@query("s3_domains", on_orders("select distinct attr, value from cells"))
def _(spark, d):
    return _domain(_orders(spark, d))


@query("s4_sample_rows", on_orders(f"select * from ord order by substr(sha256({tag('2026', chr(39) + 'row' + chr(39), 'tid')}), 1, 13), tid limit 500"))
def _(spark, d):
    return encode.sample_rows(_orders(spark, d), 500, SEED)


@query("s5_sample_share", on_orders(f"select * exclude (r, c) from (select *, row_number() over (order by substr(sha256({tag('7', chr(39) + 'row' + chr(39), 'tid')}), 1, 13), tid) r, count(*) over () c from ord) where r <= greatest(1, round_even(c * 0.1, 0))"))
def _(spark, d):
    return encode.sample_share(_orders(spark, d), 0.1, 7)


def _zipf_draw(*parts: str) -> str:
    total, edges = 0.0, []
    for p in files.zipf(4, 1.2)[:-1]:
        total += p
        edges.append(total)
    u = uniform(tag("11", *parts, "tid"))
    return "(" + " + ".join(f"({u} >= {e!r}::double)::bigint" for e in edges) + ")"


def _synthetic_sql() -> str:
    q = lambda x: f"'{x}'"
    cells = [f"case when {uniform(tag('11', q('use'), str(a), 'tid'))} < 0.6 then {_zipf_draw(q('latent'), str(a // 2))} else {_zipf_draw(q('own'), str(a))} end a{a}" for a in range(4)]
    return f"select tid, {', '.join(cells)} from range(5000) t(tid)"


@query("s9_synthetic", _synthetic_sql())
def _(spark, d):
    return files.generate(spark, 5000, 4, 4, 2, 0.6, 1.2, 11)


@query("s11_toy", "select tid, " + ", ".join(f"xor(({uniform(tag('2026', chr(39) + 'latent' + chr(39), str(a // 2), 'tid'))} < 0.5)::bigint, ({uniform(tag('2026', chr(39) + 'flip' + chr(39), str(a), 'tid'))} < 0.08)::bigint) a{a}" for a in range(8)) + " from range(1200) t(tid)")
def _(spark, d):
    return files.toy(spark)


_LINE_TEXT = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("s15_table_rows", "select count(*) as rows, sum(('0x' || substr(sha256(" + " || '|' || ".join(f"coalesce({c}::varchar, '\\N')" for c in _LINE_TEXT) + "), 1, 13))::bigint)::varchar as digest from lineitem")
def _(spark, d):
    return files.table_digest(read(spark, d, "lineitem").select(*_LINE_TEXT))


@query("t1_categories", "select event_type as value, (row_number() over (order by event_type) - 1)::bigint code from (select distinct event_type from events where event_type is not null)")
def _(spark, d):
    return encode.category_table(read(spark, d, "events"), "event_type")


@query("t2_zero_aware_codes", on_orders("select a7 code, count(*) n from ord group by a7"))
def _(spark, d):
    return _orders(spark, d).groupBy(F.col("a7").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _edge_rows(table: str, column: str, where: str, kind: str) -> str:
    return f"select '{kind}' kind, unnest(list_transform({oracle.edges(column, table, where)}, lambda e: round_even(e, 6)::double)) edge"


@query("t3_quantile_edges", _edge_rows("customer", "c_acctbal", "true", "all") + " union all " + _edge_rows("customer", "c_acctbal", "c_acctbal > 0", "positive"))
def _(spark, d):
    table = read(spark, d, "customer")
    rows = [(kind, e) for kind, zero in (("all", False), ("positive", True)) for e in encode.quantile_edges(table, F.col("c_acctbal"), zero_aware=zero)]
    return spark.createDataFrame(rows, "kind string, edge double").withColumn("edge", _round(F.col("edge")))


@query("t4_offset_codes", f"with e as (select {oracle.edges('c_acctbal', 'customer', 'c_acctbal > 0')} l) select c_custkey, (case when c_acctbal = 0 then 0 else 1 + {oracle.below('c_acctbal', 'l')} end)::bigint code from customer, e")
def _(spark, d):
    table = read(spark, d, "customer")
    return table.select("c_custkey", encode.Deciles.fit(table, F.col("c_acctbal"), zero="offset").code(F.col("c_acctbal")).alias("code"))


@query("t5_decile_codes", f"with e as (select {oracle.inner_edges('l_extendedprice', 'lineitem')} l), c as (select {oracle.below('l_extendedprice', 'l')}::bigint code from lineitem, e) select code, count(*) n from c group by code")
def _(spark, d):
    table = read(spark, d, "lineitem")
    code = encode.Deciles.fit(table, F.col("l_extendedprice")).code(F.col("l_extendedprice"))
    return table.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("t6_clean_rows", "select trim(n_name) n_name, trim(n_nationkey::varchar) n_nationkey, regexp_replace(trim(n_regionkey::varchar || '. '), '\\.$', '') label from nation")
def _(spark, d):
    raw = read(spark, d, "nation").select(F.concat(F.lit(" "), "n_name").alias("n_name"), F.col("n_nationkey").cast("string").alias("n_nationkey"), F.concat(F.col("n_regionkey").cast("string"), F.lit(". ")).alias("label"))
    return encode.clean_row(raw, 3, "label")


@query("t7_label_split", on_orders("select a7 label, count(*) n from ord group by a7"))
def _(spark, d):
    _, label = encode.split_label(_orders(spark, d), "a7", "a0")
    return label.groupBy(F.col("a7").alias("label")).agg(F.count(F.lit(1)).alias("n"))


#: Values of the orders view's attributes, from 0; the domain check takes one less of each as public.
_SIZES_OF = (3, 5, 5, 5, 7, 4, 10, 11)


@query("t8_domain_violations", on_orders(" union all ".join(f"select 'a{a}' attr, count_if(not a{a} between 0 and {n - 2})::bigint violations from ord" for a, n in enumerate(_SIZES_OF))))
def _(spark, d):
    return encode.out_of_domain(_orders(spark, d), {f"a{a}": (0, n - 2) for a, n in enumerate(_SIZES_OF)})


def _reduced_sql() -> str:
    u = uniform(tag("5", "'domain'", "attr", "value"))
    codes = f"""dom as (select attr, value, count(*) over (partition by attr) size, row_number() over (partition by attr order by value) - 1 place,
        row_number() over (partition by attr order by {u}, value) - 1 drawn from histogram),
      tgt as (select *, least(greatest(1, round_even(size * 0.5, 0)), size)::bigint target from dom),
      code as (select attr, value, (case when target = size then place else drawn * target // size end)::bigint code from tgt)"""
    return on_orders("select c.attr, code as value, count(*) n from cells c join code using (attr, value) group by c.attr, code", codes)


@query("t9_reduced_domains", _reduced_sql())
def _(spark, d):
    return counts.histogram(encode.reduce_domains(_orders(spark, d), 0.5, 5))


_GROUPS = encode.merge_groups(8, 0.5, 4, 9)


@query("t10_merged_features", on_orders("select tid, " + ", ".join(f"(dense_rank() over (order by {', '.join(f'a{a}' for a in g)}) - 1)::bigint a{k}" for k, g in enumerate(_GROUPS)) + " from ord"))
def _(spark, d):
    return encode.merge_features(_orders(spark, d), encode.merge_groups(8, 0.5, 4, 9))


def _chain_sql() -> str:
    """Half of the rows, every domain halved, then attributes merged: the seed is that of the sample."""
    domains = [f"m{a} as (select v, ((row_number() over (order by u, v) - 1) * greatest(1, round_even(count(*) over () * 0.5, 0))::bigint // count(*) over ())::bigint code from (select distinct a{a} v, {uniform(tag(str(SEED), chr(39) + 'domain' + chr(39), str(a), f'a{a}'))} u from half))" for a in range(8)]
    half = f"half as materialized (select * exclude (r, c) from (select *, row_number() over (order by substr(sha256({tag(str(SEED), chr(39) + 'row' + chr(39), 'tid')}), 1, 13), tid) r, count(*) over () c from ord) where r <= greatest(1, round_even(c * 0.5, 0)))"
    reduced = "less as (select tid, " + ", ".join(f"m{a}.code a{a}" for a in range(8)) + " from half " + " ".join(f"join m{a} on half.a{a} = m{a}.v" for a in range(8)) + ")"
    groups = encode.merge_groups(8, 0.5, CLIENTS, SEED + 7919)
    return on_orders("select tid, " + ", ".join(f"(dense_rank() over (order by {', '.join(f'a{a}' for a in g)}) - 1)::bigint a{k}" for k, g in enumerate(groups)) + " from less", half, *domains, reduced)


@query("t11_transform_chain", _chain_sql())
def _(spark, d):
    data = config.Data(domain_ratio=0.5, feature_ratio=0.5, sample_ratio=0.5)
    return protocol.prepare(_orders(spark, d), config.Config(data)).wide


@query("t12_client_columns", on_orders("select tid, a2, a3 from ord"))
def _(spark, d):
    return _orders(spark, d).select("tid", *(f"a{a}" for a in PARTS[1]))


@query("t13_one_hot", on_orders("select tid, " + ", ".join(f"(a{a} = {v})::int a{a}_{v}" for a, n in enumerate(_SIZES_OF) for v in range(n)) + " from ord"))
def _(spark, d):
    return encode.one_hot(_orders(spark, d), [(a, v) for a, n in enumerate(_SIZES_OF) for v in range(n)])


def _some_candidates(spark, d, size: int = 3, count: int = 40) -> tuple[DataFrame, DataFrame]:
    """The orders view and its candidates from exact counts: the 12 most frequent items as pool."""
    wide = _orders(spark, d)
    pool = candidates.frequent_items(counts.histogram(wide).withColumnRenamed("n", "noisy").withColumn("noisy", F.col("noisy").cast("double")), 12)
    n = wide.count()
    return wide, candidates.ranked_candidates(pool, float(n), count, 1, size)


def _candidate_ctes(size: int = 3, count: int = 40, source: str = "histogram", n: str = "(select count(*)::double from ord)", pool: int = 12, order: str = "score desc, k") -> list[str]:
    """picked items, every itemset with score and guess, and the best of them (sets: k, t, size, score, guess)."""
    parts = []
    for s in range(1, size + 1):
        froms = "pool p0" + "".join(f" join pool p{k} on p{k}.attr > p{k - 1}.attr" for k in range(1, s))
        score, guess = (" * ".join(f"p{k}.{c}" for k in range(s)) for c in ("share", "part"))
        key = ", ".join(f"{{'attr': p{k}.attr, 'value': p{k}.value}}" for k in range(s))
        t = name([f"p{k}.attr" for k in range(s)], [f"p{k}.value" for k in range(s)])
        parts.append(f"select {s} size, [{key}] k, {t} t, {score} score, total * ({guess}) guess from {froms}, total")
    return [
        f"total as (select {n} total)",
        f"top as (select attr, value, greatest(n, 0)::double c from {source} order by c desc, attr, value limit {pool})",
        "pool as (select attr, value, 0.9::double * least(greatest(c, 0), total) / max(least(greatest(c, 0), total)) over () share, least(greatest(c, 0), total) / total part from top, total)",
        "every as (" + " union all ".join(parts) + ")",
        f"best as (select * from every order by {order} limit {count})",
    ]


_OWNED = "owned as (select k, t, score, guess, x.attr // 2 client, list_sort(list(x)) part from (select k, t, score, guess, unnest(k) x from best) group by k, t, score, guess, x.attr // 2)"
_TEXT = lambda col: f"('{{' || array_to_string(list_transform({col}, lambda x: 'a' || x.attr || '=' || x.value), ', ') || '}}')"


def _owners(spark: SparkSession) -> DataFrame:
    return partition.owner_table(spark, PARTS)


@query("t14_local_parts", on_orders(f"select client::int client, t as itemset, {_TEXT('part')} part from owned", *_candidate_ctes(), _OWNED))
def _(spark, d):
    _, best = _some_candidates(spark, d)
    parts = keys.projections(best, _owners(spark))
    return parts.select("client", itemsets.text_column(F.col("itemset")).alias("itemset"), itemsets.text_column(F.col("part")).alias("part"))


@query("t15_canonical", on_orders("select tid, '{a0=' || a0 || ', a3=' || a3 || '}' itemset from ord"))
def _(spark, d):
    wide = _orders(spark, d)
    items = itemsets.item_columns([(F.lit(3), F.col("a3")), (F.lit(0), F.col("a0")), (F.lit(3), F.col("a3"))])
    return wide.select("tid", itemsets.text_column(itemsets.canonical_column(items)).alias("itemset"))


# Dealing attributes


@query("p1_order_partition", "select i attr, (ntile(3) over (order by i) - 1)::int owner from (select i::int i from range(8) t(i))")
def _(spark, d):
    return partition.deal_table(spark.range(8).select(F.col("id").cast("int").alias("attr")), 3)


@query("p2_random_partition", f"select attr::int attr, (ntile(3) over (order by u, attr) - 1)::int owner from (select attr, {uniform(tag('13', chr(39) + 'partition' + chr(39), 'attr'))} u from range(8) t(attr))")
def _(spark, d):
    return partition.owner_table(spark, partition.deal(partition.order_of(8, 13), partition.sizes_equal(8, 3)))


@query("p3_ratio_partition", """with r as (select * from (values (0, 2), (1, 1), (2, 1), (3, 1)) t(client, ratio)), q as (select client, 16 * ratio / sum(ratio) over () quota from r),
    f as (select client, floor(quota) base, row_number() over (order by quota - floor(quota) desc, client) place, 16 - sum(floor(quota)) over () rest from q) select client::int client, (base + (place <= rest)::int)::int size from f""")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(partition.sizes_by_ratio(16, (2, 1, 1, 1)))), "client int, size int")


@query("p4_repaired_partition")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(partition.sizes_by_ratio(8, (100, 1, 1, 1)))), "client int, size int")


@query("p5_affinity_partition")
def _(spark, d):
    return partition.owner_table(spark, protocol.prepare(_orders(spark, d), config.Config(config.Data(strategy="affinity"))).parts)


@query("p6_owner_map", "select a::int attr, (a // 2)::int owner from range(8) t(a)")
def _(spark, d):
    return _owners(spark)


# Predicates, joins and sets


@query("j1_membership", on_orders("select tid from ord where a0 = 2 and a5 = 3"))
def _(spark, d):
    return _orders(spark, d).where(counts.matches(((0, 2), (5, 3)))).select("tid")


@query("j2_bin_membership", on_orders("select tid from ord where a6 in (0, 1, 2) and a7 in (4, 5)"))
def _(spark, d):
    return _orders(spark, d).where(counts.matches_bins(((6, 0), (7, 1)), {(6, 0): [0, 1, 2], (7, 1): [4, 5]})).select("tid")


@query("j3_other_category", on_orders("select tid from ord where a3 not in (1, 2)"))
def _(spark, d):
    return _orders(spark, d).where(counts.matches_category((3, itemsets.OTHER), [1, 2])).select("tid")


@query("j4_complement", on_orders("select count(*) n from ord where not (a0 = 2 and a5 = 3)"))
def _(spark, d):
    return _orders(spark, d).where(~counts.matches(((0, 2), (5, 3)))).agg(F.count(F.lit(1)).alias("n"))


@query("j5_aligned_rows", on_orders("select tid, a0, a7 from ord where a0 = 2 and a7 = 3"))
def _(spark, d):
    wide = _orders(spark, d)
    return wide.where("a0 = 2").select("tid", "a0").join(wide.where("a7 = 3").select("tid", "a7"), "tid")


@query("j6_hashed_rows", on_orders("select coalesce(l.h, r.h) htid, coalesce(l.a0, -1) a0, coalesce(r.a7, -1) a7 from (select sha256('key|' || tid) h, a0 from ord where a0 = 2) l full join (select sha256('key|' || tid) h, a7 from ord where a7 = 3) r on l.h = r.h"))
def _(spark, d):
    wide = _orders(spark, d)
    return circuits.join_owners([wide.where("a0 = 2").select("tid", "a0"), wide.where("a7 = 3").select("tid", "a7")], "key").select("htid", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("a0", "a7")))


@query("j7_item_pairs", on_orders("select t as itemset, round_even(score, 9)::double score from every where size = 2", *_candidate_ctes(2)))
def _(spark, d):
    wide = _orders(spark, d)
    pool = candidates.frequent_items(counts.histogram(wide).select("attr", "value", F.col("n").cast("double").alias("noisy")), 12)
    return candidates.item_products(pool, wide.count(), 2, 2).select(itemsets.text_column(F.col("itemset")).alias("itemset"), _round("score", 9).alias("score"))


@query("j8_candidate_blocks", on_orders(f"""select t as itemset, string_agg(shown, ' ' order by client, shown) blocks from (select t, client, case when known then {_TEXT('part')} else array_to_string(list_transform(part, lambda x: '{{a' || x.attr || '=' || x.value || '}}'), ' ') end shown
    from (select t, client, part, len(part) = 1 or part in (select part from (select part, client, max(guess) g from owned group by all order by g desc, part limit 3)) known from owned)) group by t""", *_candidate_ctes(), _OWNED))
def _(spark, d):
    _, best = _some_candidates(spark, d)
    parts = keys.projections(best, _owners(spark))
    reported = parts.groupBy("part", "client").agg(F.max("guess").alias("g")).orderBy(F.desc("g"), "part").limit(3).collect()
    found, owner = candidates.collect_candidates(best), partition.owner_map(PARTS)
    known = {(r["client"], itemsets.canonical(map(tuple, r["part"]))) for r in reported} | {(owner[i[0]], (i,)) for c in found for i in c.itemset}
    blocks = [(itemsets.text(c.itemset), owner, estimate.blocks_of(c.itemset, owner, keys.MIXED, known)) for c in found]
    rows = [(t, " ".join(sorted(map(itemsets.text, b), key=lambda x: (owner[int(x[2 : x.index("=")])], x)))) for t, owner, b in blocks]
    return spark.createDataFrame(rows, "itemset string, blocks string")


@query("j10_tid_intersections", on_orders("select labels, n support from (select 'c' || attr || ':' || value labels, count(*) n from cells group by 1 union all select 'c' || a.attr || ':' || a.value || ' c' || b.attr || ':' || b.value, count(*) from cells a join cells b on a.tid = b.tid and a.attr < b.attr group by 1)"))
def _(spark, d):
    long = encode.to_long(_orders(spark, d)).select("tid", F.concat(F.lit("c"), "attr", F.lit(":"), "value").alias("label"))
    return circuits.tid_intersections(long, 2, 100_000).select(F.array_join("labels", " ").alias("labels"), "support")


@query("j11_key_sets", on_orders(f"""with s as (select distinct client, [x] k from (select client, unnest(part) x from owned)), w as (select distinct client, part k from owned) select 'union' op, count(*) n from (select * from s union select * from w)
    union all select 'both', count(*) from (select * from s intersect select * from w) union all select 'joint only', count(*) from (select * from w except select * from s)""", *_candidate_ctes(), _OWNED))
def _(spark, d):
    _, best = _some_candidates(spark, d)
    owners = _owners(spark)
    s, w = (keys.key_table(best, owners, m) for m in (keys.SINGLE, keys.LOCAL))
    count = lambda name, df: df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return count("union", s.union(w).distinct()).union(count("both", s.intersect(w))).union(count("joint only", w.join(s, ["client", "key"], "left_anti")))


@query("j12_coarse_keys", on_orders("select distinct attr, value // 3 as bin from histogram"))
def _(spark, d):
    return counts.histogram(_orders(spark, d)).select("attr", F.floor(F.col("value") / 3).alias("bin")).distinct()


@query("j13_concatenated", on_orders("select attr, value, 2 * n as n from histogram"))
def _(spark, d):
    wide = _orders(spark, d)
    return counts.histogram(wide.unionByName(wide))


@query("j14_containment", on_orders("select tid from ord where a0 = 1 and a2 = 3 and a4 = 2"))
def _(spark, d):
    rows = encode.to_long(_orders(spark, d)).groupBy("tid").agg(F.collect_list(F.concat_ws(":", "attr", "value")).alias("items"))
    return rows.where(F.size(F.array_except(F.array(F.lit("0:1"), F.lit("2:3"), F.lit("4:2")), "items")) == 0).select("tid")


# Counts


@query("a2_candidate_supports", on_orders("select b.t as itemset, coalesce(s.n, 0) support from best b left join sets s on s.t = b.t", *_candidate_ctes(), oracle.itemset_counts(3, "pool")))
def _(spark, d):
    wide, best = _some_candidates(spark, d)
    found = candidates.collect_candidates(best)
    table = counts.support_table(wide, [c.itemset for c in found])
    names = spark.createDataFrame([(k, itemsets.text(c.itemset)) for k, c in enumerate(found)], "candidate int, itemset string")
    return table.join(names, "candidate").select("itemset", "support")


@query("a3_histogram", on_orders("select attr, value, n from histogram union all select 0, 99, 0"))
def _(spark, d):
    wide = _orders(spark, d)
    extra = spark.sql("select 0 as attr, 99L as value")
    return counts.full_histogram(wide, _domain(wide).union(extra))


_NOISY = f"noisy as materialized (select attr // 2 client, attr, value, greatest(round_even(n + {laplace(f'2 / {EPSILON}', tag(str(SEED), chr(39) + 'client_' + chr(39) + ' || (attr // 2)', chr(39) + 'round1' + chr(39), 'attr', 'value'))}, 9), 0)::double n from histogram)"


def _noisy(spark, d, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    wide = _orders(spark, d)
    return wide, randomizer.first_histogram(counts.histogram(wide), _owners(spark), EPSILON, SEED, limit)


@query("n2_first_round", on_orders("select client::int client, attr, value, n noisy from noisy", _NOISY))
def _(spark, d):
    return _noisy(spark, d)[1]


@query("k2_report_limit", on_orders("select client::int client, attr, value, n noisy from (select *, row_number() over (partition by client order by n desc, attr, value) r from noisy) where r <= 5", _NOISY))
def _(spark, d):
    return _noisy(spark, d, 5)[1]


@query("a4_summed_reports", on_orders("select attr, value, sum(n) noisy from noisy group by attr, value", _NOISY))
def _(spark, d):
    return _noisy(spark, d)[1].groupBy("attr", "value").agg(F.sum("noisy").alias("noisy"))


_ROWS = f"rows_n as (select client, round_even(total + {laplace(f'1 / {EPSILON_N}', tag(str(SEED), chr(39) + 'client_' + chr(39) + ' || client', chr(39) + 'noisy_n' + chr(39)))}, 9)::double noisy_n from (select count(*) total from ord), range({CLIENTS}) t(client))"


@query("n3_noisy_rows", on_orders("select client::int client, noisy_n from rows_n", _ROWS))
def _(spark, d):
    return randomizer.noisy_rows(_orders(spark, d).agg(F.count(F.lit(1)).alias("n")), CLIENTS, EPSILON_N, SEED)


@query("a5_mean_rows", on_orders("select round_even(greatest(1.0, avg(noisy_n)), 6)::double noisy_n from rows_n", _ROWS))
def _(spark, d):
    rows = randomizer.noisy_rows(_orders(spark, d).agg(F.count(F.lit(1)).alias("n")), CLIENTS, EPSILON_N, SEED)
    return randomizer.mean_rows(rows).select(_round("noisy_n").alias("noisy_n"))


def _nmi_sql(log: str) -> str:
    return on_orders(
        f"""select l.a::int as "left", l.b::int as "right", round_even(case when hx <= 1e-15 or hy <= 1e-15 then 0 else least(greatest(mi / sqrt(hx * hy), 0), 1) end, 6)::double nmi from
        (select a, b, sum(n / t * {log}(n * t / (nx * ny))) mi from (select *, sum(n) over (partition by a, b) t, sum(n) over (partition by a, b, x) nx, sum(n) over (partition by a, b, y) ny from joint) group by a, b) l
        join (select attr, -sum(n / t * {log}(n / t)) hx from (select attr, n::double n, sum(n) over (partition by attr) t from histogram) group by attr) h on h.attr = l.a
        join (select attr, -sum(n / t * {log}(n / t)) hy from (select attr, n::double n, sum(n) over (partition by attr) t from histogram) group by attr) g on g.attr = l.b""",
        "joint as (select p.attr a, q.attr b, p.value x, q.value y, count(*)::double n from cells p join cells q on p.tid = q.tid and p.attr < q.attr group by all)",
    )


@query("a7_mutual_information", _nmi_sql("ln"))
def _(spark, d):
    return counts.mutual_information(_orders(spark, d)).select("left", "right", _round("nmi").alias("nmi"))


@query("a8_mutual_information_base2", _nmi_sql("log2"))
def _(spark, d):
    return counts.mutual_information(_orders(spark, d), base2=True).select("left", "right", _round("nmi").alias("nmi"))


_EVENT_BITS = "with e as (select event_type, dense_rank() over (order by event_type) - 1 v, event_id tid from events)"


def _oue_sql() -> str:
    p, q = randomizer.parameters(1.0)
    one = uniform_cut(tag("3", "'oue'", "0", "val // 4", "tid"), "val")
    return f"{_EVENT_BITS}, b as (select val, ({one} < case when v = val then {p!r}::double else {q!r}::double end)::int b from e, range(5) t(val)) select val::bigint as value, sum(b)::bigint ones, round_even((sum(b) - count(*) * {q!r}::double) / {p - q!r}::double, 6)::double estimate from b group by val"


@query("n10_unary_counts", _oue_sql())
def _(spark, d):
    events = read(spark, d, "events")
    code = encode.Categories.fit(events, F.col("event_type")).code(F.col("event_type"))
    wide = events.select(F.col("event_id").alias("tid"), code.cast("bigint").alias("a0"))
    sums = randomizer.column_sums(wide, {0: list(range(5))}, 1.0, 3)
    return sums.select("value", "ones", _round(randomizer.debiased(F.col("ones"), F.col("rows"), 1.0)).alias("estimate"))


def _bits_sql() -> str:
    p, q = randomizer.parameters(2.0)
    return on_orders(f"select 0 attr, val::bigint as value, sum(({uniform_cut(tag('4', chr(39) + 'oue' + chr(39), '0', 'val // 4', 'tid'), 'val')} < case when a0 = val then {p!r}::double else {q!r}::double end)::int)::bigint ones from ord, range(3) t(val) group by val")


@query("a10_unary_sums", _bits_sql())
def _(spark, d):
    wide = _orders(spark, d)
    return randomizer.column_sums(wide.select("tid", "a0"), {0: [0, 1, 2]}, 2.0, 4).select("attr", "value", "ones")


def _intersection_sql() -> str:
    parts = []
    for place, (a, v, eps) in enumerate(((0, 2, 6.0), (5, 3, 6.0))):
        p, q = randomizer.parameters(eps)
        u = uniform_cut(tag("8", "'bits'", "0", "tid"), str(place))
        parts.append(f"((({u} < case when a{a} = {v} then {p!r}::double else {q!r}::double end)::int - {q!r}::double) / {p - q!r}::double)")
    return on_orders(f"select round_even(least(greatest(sum({' * '.join(parts)}), 0), count(*)), 6)::double estimate from ord")


@query("n12_unary_intersection", _intersection_sql())
def _(spark, d):
    blocks = [(counts.matches(((0, 2),)), 6.0, "x"), (counts.matches(((5, 3),)), 6.0, "y")]
    wide = _orders(spark, d)
    return randomizer.intersections(wide, [blocks], wide.count(), 8).select(_round("e0").alias("estimate"))


def _estimates_sql() -> str:
    p, q = randomizer.parameters(4.0)
    x = f"((({uniform_cut(tag('9', chr(39) + 'bits' + chr(39), 'place // 4', 'tid'), 'place')} < case when c.value = i.value then {p!r}::double else {q!r}::double end)::int - {q!r}::double) / {p - q!r}::double)"
    items = "items as (select attr, value, row_number() over (order by printf('%02d=%04d', attr, value)) - 1 place from (select distinct x.attr attr, x.value as value from (select unnest(k) x from best)))"
    bits = f"bits as materialized (select i.attr, i.value, tid, {x} x from items i join cells c on c.attr = i.attr)"
    products = "products as (select t, tid, product(b.x) y from (select t, unnest(k) i from best) a join bits b on b.attr = a.i.attr and b.value = a.i.value group by t, tid)"
    return on_orders("select t as itemset, round_even(least(greatest(sum(y), 0), count(*)), 6)::double estimate from products group by t", *_candidate_ctes(2, 20), items, bits, products)


@query("n14_unary_estimates", _estimates_sql())
def _(spark, d):
    wide, best = _some_candidates(spark, d, 2, 20)
    found = candidates.collect_candidates(best)
    sets = [[(counts.matches((i,)), 4.0, f"{i[0]:02d}={i[1]:04d}") for i in c.itemset] for c in found]
    row = randomizer.intersections(wide, sets, wide.count(), 9).first()
    rows = [(itemsets.text(c.itemset), row[f"e{k}"]) for k, c in enumerate(found)]
    return spark.createDataFrame(rows, "itemset string, estimate double").withColumn("estimate", _round("estimate"))


def _unary_first_sql() -> str:
    share = 2.0 / CLIENTS / 2
    p, q = randomizer.parameters(share)
    bit = f"({uniform_cut(tag(str(SEED), chr(39) + 'oue' + chr(39), 'h.attr', 'h.place // 4', 'tid'), 'h.place')} < case when c.value = h.value then {p!r}::double else {q!r}::double end)::int"
    sums = f"select h.attr, h.value, least(greatest((sum({bit}) - count(*) * {q!r}::double) / {p - q!r}::double, 0), count(*)) x from cells c join (select *, row_number() over (partition by attr order by value) - 1 place from histogram) h on h.attr = c.attr group by h.attr, h.value"
    return on_orders(f"select client::int client, attr, value, round_even(x, 6)::double noisy from (select attr // 2 client, attr, value, x, row_number() over (partition by attr // 2 order by x desc, attr, value) r from ({sums})) where r <= 15")


@query("n13_unary_first_round", _unary_first_sql())
def _(spark, d):
    wide = _orders(spark, d)
    found = randomizer.first_round(wide, encode.domain_map(wide), _owners(spark), 2.0, CLIENTS, wide.count(), SEED, 15)
    return found.withColumn("noisy", _round("noisy"))


@query("n15_central_supports", on_orders(f"select t as itemset, least(greatest(round_even(n + {laplace('40 / 0.5', tag('2026', chr(39) + 'central' + chr(39), 'c'))}, 9), 0), (select count(*) from ord))::double estimate from (select b.t, coalesce(s.n, 0) n, row_number() over (order by b.score desc, b.k) - 1 c from best b left join sets s on s.t = b.t)", *_candidate_ctes(), oracle.itemset_counts(3, "pool")))
def _(spark, d):
    wide, best = _some_candidates(spark, d)
    found = candidates.collect_candidates(best)
    noisy = randomizer.central_estimates(counts.support_table(wide, [c.itemset for c in found]), 0.5, len(found), float(wide.count()), SEED)
    names = spark.createDataFrame([(k, itemsets.text(c.itemset)) for k, c in enumerate(found)], "candidate int, itemset string")
    return noisy.join(names, "candidate").select("itemset", "estimate")


@query("a11_products", on_orders("select t as itemset, round_even(score, 9)::double score, round_even(guess, 6)::double guess from every where size = 3", *_candidate_ctes(3)))
def _(spark, d):
    wide = _orders(spark, d)
    pool = candidates.frequent_items(counts.histogram(wide).select("attr", "value", F.col("n").cast("double").alias("noisy")), 12)
    rows = candidates.item_products(pool, wide.count(), 3, 3)
    return rows.select(itemsets.text_column(F.col("itemset")).alias("itemset"), _round("score", 9).alias("score"), _round("guess").alias("guess"))


def _runs(spark, d) -> DataFrame:
    """Runs made of the events table: dataset, axis, value, method, seed and two metrics."""
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("seed"))
    return e.agg(F.avg("value").alias("f1"), F.max("value").alias("mse")).select(F.lit("events").alias("dataset"), F.lit("k").alias("axis"), F.lit(1.0).alias("value"), "method", "seed", "f1", "mse")


_RUNS = "with runs as (select 'events' dataset, 'k' axis, 1.0::double as value, event_type as method, user_id % 4 seed, avg(value) f1, max(value) mse from events group by event_type, user_id % 4)"


@query("a12_summary", f"{_RUNS} select dataset, axis, value, method, count(*) seeds, " + ", ".join(f"round_even(avg({m}), 6)::double {m}_mean, round_even(coalesce(stddev_samp({m}), 0), 6)::double {m}_std" for m in ("f1", "mse")) + " from runs group by all")
def _(spark, d):
    out = metrics.summarize(_runs(spark, d), ["f1", "mse"])
    return out.select("dataset", "axis", "value", "method", "seeds", *(_round(c).alias(c) for c in ("f1_mean", "f1_std", "mse_mean", "mse_std")))


@query("a13_intervals", f"{_RUNS} select method, round_even(avg(f1), 6)::double f1_mean, round_even(3.182 * stddev_samp(f1) / 2, 6)::double f1_ci95 from runs group by method")
def _(spark, d):
    out = metrics.aggregate_rows(_runs(spark, d), ["method"], ["f1"])
    return out.select("method", _round("f1_mean").alias("f1_mean"), _round("f1_ci95").alias("f1_ci95"))


@query("a14_client_totals", on_orders("select client::int client, count(*) reported, round_even(max(n), 6)::double largest, round_even(sum(n), 6)::double total from noisy group by client", _NOISY))
def _(spark, d):
    return _noisy(spark, d)[1].groupBy("client").agg(F.count(F.lit(1)).alias("reported"), _round(F.max("noisy")).alias("largest"), _round(F.sum("noisy")).alias("total"))


@query("a15_cutoff_ties", on_orders("select n cutoff, count(*) ties from sets where n = (select n from sets order by n desc, k limit 1 offset 14) group by n", oracle.itemset_counts(2, "histogram")))
def _(spark, d):
    _, info = counts.top_itemsets(_orders(spark, d), 15, 2)
    return spark.createDataFrame([(info["cutoff_support"], info["cutoff_tie_count"])], "cutoff bigint, ties bigint")


def _top_table(spark, found) -> DataFrame:
    return spark.createDataFrame([(itemsets.text(s), n) for s, n in found], "itemset string, support bigint")


def _top_sql(max_size: int, k: int, min_size: int = 1) -> str:
    return on_orders(f"select t as itemset, n support from sets where size >= {min_size} order by n desc, k limit {k}", oracle.itemset_counts(max_size, "histogram"))


@query("k3_exact_topk", _top_sql(2, 15))
def _(spark, d):
    return _top_table(spark, counts.top_itemsets(_orders(spark, d), 15, 2)[0])


@query("k3_exact_topk_4", _top_sql(4, 25))
def _(spark, d):
    return _top_table(spark, counts.top_itemsets(_orders(spark, d), 25, 4)[0])


@query("k4_topk_pairs", _top_sql(3, 15, 2))
def _(spark, d):
    return _top_table(spark, counts.top_itemsets(_orders(spark, d), 15, 3, min_size=2)[0])


_LINES = """with line as materialized (select row_number() over () tid, (dense_rank() over (order by l_returnflag) - 1)::bigint a0, (dense_rank() over (order by l_linestatus) - 1)::bigint a1, l_linenumber::bigint a2, round(l_discount * 100)::bigint a3,
    round(l_tax * 100)::bigint a4, floor(l_quantity / 10)::bigint a5, (year(l_shipdate) - 1992)::bigint a6, (quarter(l_shipdate) - 1)::bigint a7 from lineitem), cells as materialized (""" + " union all ".join(f"select tid, {k} attr, a{k} as value from line" for k in range(8)) + "), histogram as (select attr, value, count(*) n from cells group by all), "


@query("k3_exact_topk_lineitem", _LINES + oracle.itemset_counts(2, "histogram") + " select t as itemset, n support from sets order by n desc, k limit 15")
def _(spark, d):
    return _top_table(spark, counts.top_itemsets(views.lineitem_view(spark, d), 15, 2)[0])


@query("k3_exact_topk_lineitem_4", _LINES + oracle.itemset_counts(4, "histogram") + " select t as itemset, n support from sets order by n desc, k limit 15")
def _(spark, d):
    return _top_table(spark, counts.top_itemsets(views.lineitem_view(spark, d), 15, 4)[0])


_EVENT_CELLS = "with ev as materialized (select event_id tid, (dense_rank() over (order by event_type) - 1)::bigint a0, hour(ts) // 6 a1, isodow(ts) - 1 a2, user_id % 8 a3, " + oracle.below("value", "edge.e") + f"::bigint a4 from events, (select {oracle.inner_edges('value', 'events')} e) edge), cells as materialized (" + " union all ".join(f"select tid, {k} attr, a{k} as value from ev" for k in range(5)) + "), histogram as (select attr, value, count(*) n from cells group by all), "


@query("k3_exact_topk_events", _EVENT_CELLS + oracle.itemset_counts(4, "histogram") + " select t as itemset, n support from sets order by n desc, k limit 15")
def _(spark, d):
    return _top_table(spark, counts.top_itemsets(views.events_view(spark, d), 15, 4)[0])


@query("j9_pool_topk", on_orders("select t as itemset, n support from sets order by n desc, k limit 10", "pool as (select attr, value, n from histogram order by n desc, attr, value limit 12)", oracle.itemset_counts(3, "pool")))
def _(spark, d):
    wide = _orders(spark, d)
    pool = {(r["attr"], r["value"]) for r in counts.histogram(wide).orderBy(F.desc("n"), "attr", "value").limit(12).collect()}
    return _top_table(spark, counts.top_itemsets(wide, 10, 3, allowed=pool)[0])


# Candidates, keys and budgets

_POOL = dict(source="noisy", pool=15, count=30)


def _noisy_candidates(spark, d, make=candidates.ranked_candidates, count: int | None = 30, size: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    wide, table = _noisy(spark, d)
    return wide, table, make(candidates.frequent_items(table, 15), float(wide.count()), count, 1, size)


def _shown(table: DataFrame) -> DataFrame:
    return table.select(itemsets.text_column(F.col("itemset")).alias("itemset"), _round("score", 9).alias("score"), _round("guess").alias("guess"))


_SHOWN = "select t as itemset, round_even(score, 9)::double score, round_even(guess, 6)::double guess from "


@query("k1_frequent_items", on_orders("select attr, value, n noisy from noisy order by n desc, attr, value limit 15", _NOISY))
def _(spark, d):
    return candidates.frequent_items(_noisy(spark, d)[1], 15)


@query("c1_candidates", on_orders(_SHOWN + "best", _NOISY, *_candidate_ctes(**_POOL)))
def _(spark, d):
    return _shown(_noisy_candidates(spark, d)[2])


@query("c2_all_candidates", on_orders(_SHOWN + "every", _NOISY, *_candidate_ctes(**_POOL)))
def _(spark, d):
    return _shown(_noisy_candidates(spark, d, count=None)[2])


@query("c3_joint_first", on_orders(_SHOWN + "(select *, row_number() over (partition by size = 1 order by score desc, k) r, count_if(size > 1) over () joints, count_if(size = 1) over () singles from every) where case when size = 1 then r <= least(singles, 30 - least(joints, 29)) else r <= least(joints, 30 - least(singles, 30 - least(joints, 29))) end", _NOISY, *_candidate_ctes(**_POOL)))
def _(spark, d):
    return _shown(_noisy_candidates(spark, d, candidates.joint_first_candidates)[2])


@query("k5_ranked_candidates", on_orders("select row_number() over (order by score desc, k)::int place, t as itemset from best", _NOISY, *_candidate_ctes(**_POOL)))
def _(spark, d):
    found = candidates.collect_candidates(_noisy_candidates(spark, d)[2])
    return spark.createDataFrame([(k + 1, itemsets.text(c.itemset)) for k, c in enumerate(found)], "place int, itemset string")


@query("k6_pruned_search", on_orders("select t as itemset, round_even(score, 9)::double score from best", _NOISY, *_candidate_ctes(**_POOL)))
def _(spark, d):
    wide, table = _noisy(spark, d)
    pool = [((r["attr"], r["value"]), r["noisy"]) for r in candidates.frequent_items(table, 15).collect()]
    found, _ = candidates.search(pool, float(wide.count()), 30, 1, 3)
    return spark.createDataFrame([(itemsets.text(c.itemset), c.score) for c in found], "itemset string, score double").withColumn("score", _round("score", 9))


@query("k8_estimate_ranking", on_orders("select row_number() over (order by guess desc, k)::int place, t as itemset from best", _NOISY, *_candidate_ctes(**_POOL)))
def _(spark, d):
    found = candidates.collect_candidates(_noisy_candidates(spark, d)[2], "guess")
    return spark.createDataFrame([(k + 1, itemsets.text(c.itemset)) for k, c in enumerate(found)], "place int, itemset string")


@query("c6_public_universe", on_orders(" union all ".join(f"select {name([f'c{k}.attr' for k in range(s)], [f'c{k}.value' for k in range(s)])} as itemset from histogram c0" + "".join(f" join histogram c{k} on c{k}.attr > c{k - 1}.attr" for k in range(1, s)) for s in (1, 2))))
def _(spark, d):
    domain = encode.domain_map(_orders(spark, d))
    return spark.createDataFrame([(itemsets.text(s),) for s in counts.universe(domain, 2, 10_000)], "itemset string")


@query("c7_preflight", on_orders("select (select count(*) from histogram) public_items, (select count(*) from (" + " union all ".join("select 1 from histogram c0" + "".join(f" join histogram c{k} on c{k}.attr > c{k - 1}.attr" for k in range(1, s)) for s in (1, 2, 3)) + ")) public_candidates, (select count(*) from ord) * (select count(*) from histogram) * 2536 ciphertext_bytes"))
def _(spark, d):
    wide = _orders(spark, d)
    out = wire.preflight(wide.count(), [len(v) for v in encode.domain_map(wide).values()], 3)
    return spark.createDataFrame([(out["public_items"], out["public_candidates"], out["ciphertext_bytes"])], "public_items bigint, public_candidates bigint, ciphertext_bytes bigint")


@query("c8_exact_pool_candidates", on_orders(_SHOWN + "best", *_candidate_ctes()))
def _(spark, d):
    return _shown(_some_candidates(spark, d)[1])


_KEYS = [_NOISY, *_candidate_ctes(**_POOL), _OWNED]


@query("r1_single_keys", on_orders("select distinct client::int client, '{a' || x.attr || '=' || x.value || '}' as key from (select client, unnest(part) x from owned)", *_KEYS))
def _(spark, d):
    return keys.key_table(_noisy_candidates(spark, d)[2], _owners(spark), keys.SINGLE).select("client", itemsets.text_column(F.col("key")).alias("key"))


@query("r2_local_keys", on_orders(f"select distinct client::int client, {_TEXT('part')} as key from owned", *_KEYS))
def _(spark, d):
    return keys.key_table(_noisy_candidates(spark, d)[2], _owners(spark), keys.LOCAL).select("client", itemsets.text_column(F.col("key")).alias("key"))


_MIXED = "mixed as (select client, k, sum_guess guess, row_number() over (partition by client order by sum_guess desc, k) r from (select client, k, total * list_reduce(list_transform(k, lambda x: x.part), lambda a, b: a * b) sum_guess from (select client, list({'attr': x.attr, 'value': x.value, 'part': p.part} order by x.attr) k from (select client, id, unnest(k) x from (select distinct client, k, row_number() over () id from (select distinct client, part k from owned union select distinct client, [y] from (select client, unnest(part) y from owned)))) join pool p on p.attr = x.attr and p.value = x.value group by client, id), total))"


@query("k7_mixed_keys", on_orders(f"select client::int client, {_TEXT('k')} as key, round_even(guess, 6)::double guess from mixed where r <= 6", *_KEYS, _MIXED))
def _(spark, d):
    wide, table, best = _noisy_candidates(spark, d)
    noisy = candidates.frequent_items(table, 15)
    chosen = keys.key_table(best, _owners(spark), keys.MIXED, noisy, float(wide.count()), 6)
    return chosen.select("client", itemsets.text_column(F.col("key")).alias("key"), _round("guess").alias("guess"))


def _key_query(mode: str, **how) -> Query:
    def run(spark, d):
        wide, table, best = _noisy_candidates(spark, d)
        found = candidates.collect_candidates(best)
        noisy = {(r["attr"], r["value"]): r["noisy"] for r in table.collect()}
        rows = [(c, itemsets.text(k)) for c, attrs in enumerate(PARTS) for k in keys.report_keys(found, attrs, mode, noisy=noisy, n=float(wide.count()), local=wide, **how)]
        return spark.createDataFrame(rows, "client int, key string")

    return run


query(
    "r3_top_joint_keys",
    on_orders(
        f"with j as (select client, part, sum(greatest(guess, 0)) * (len(part) - 1) gain, max(score) best from owned where len(part) > 1 group by client, part), "
        f"c as (select client, part from (select *, row_number() over (partition by client order by round_even(gain, 6) desc, greatest(best, 0) desc, part) r from j) where r <= 3), "
        f"k as (select client, part from c union select o.client, [x] from (select client, part, unnest(part) x from owned) o left join c on c.client = o.client and c.part = o.part where c.client is null) "
        f"select client::int client, {_TEXT('part')} as key from k",
        *_KEYS,
    ),
)(_key_query(keys.LOCAL_TOP, top=3))
query("r4_raw_single_keys", on_orders("select client::int client, '{a' || attr || '=' || value || '}' as key from (select client, h.attr, h.value, row_number() over (partition by client order by h.n desc, h.attr, h.value) r from (select distinct client, x.attr, x.value from (select client, unnest(part) x from owned)) u join histogram h on h.attr = u.attr and h.value = u.value) where r <= 3", *_KEYS))(_key_query(keys.RAW_SINGLE, limit=3))
query(
    "r5_raw_part_keys",
    on_orders(
        f"with u as (select distinct client, part from owned), n as (select u.client, u.part, coalesce(s.n, 0) n from u left join sets s on s.t = {_TEXT('u.part')}), "
        f"b as (select client, unnest(part) x from (select *, row_number() over (partition by client order by n desc, part) r from n) where r <= 3) "
        f"select distinct client::int client, '{{a' || x.attr || '=' || x.value || '}}' as key from b",
        *_KEYS, oracle.itemset_counts(2, "pool"),
    ),
)(_key_query(keys.RAW_PARTS, limit=3))
query("r6_mixed_keys", on_orders(f"select client::int client, {_TEXT('k')} as key from mixed where r <= 6", *_KEYS, _MIXED))(_key_query(keys.MIXED, limit=6))
_COVER = """uses as (select client, [x] key, w / len(part) use, len(part) = 1 needed from (select client, part, w, unnest(part) x from (select client, part, greatest(guess, 0) / (select count(*) from ord) w from owned))
    union all select client, part, greatest(guess, 0) / (select count(*) from ord) * (len(part) - 1), false from owned where len(part) > 1),
cover as (select client, key, sum(use) use, bool_or(needed) needed from uses group by client, key),
guessed as (select c.client, key, product(least(n, total) / total) part from (select client, key, unnest(key) x from cover) c, noisy, (select count(*)::double total from ord) where noisy.attr = x.attr and noisy.value = x.value group by c.client, key),
placed as (select client, key, row_number() over (partition by client order by case when needed then 0 when len(key) > 1 then 1 else 2 end, use desc, part desc, key) r from cover join guessed using (client, key))"""
query("r7_cover_keys", on_orders(f"select client::int client, {_TEXT('key')} as key from placed where r <= 6", *_KEYS, _COVER))(_key_query(keys.COVER, limit=6))


@query("r8_category_keys", on_orders("select distinct client::int client, '{a' || attr || '=' || v || '}' as key from (select client, x.attr attr, x.value::varchar v from (select client, unnest(part) x from owned) union all select client, x.attr, 'OTHER' from (select client, unnest(part) x from owned))", *_KEYS))
def _(spark, d):
    wide, _, best = _noisy_candidates(spark, d)
    found, domain = candidates.collect_candidates(best), encode.domain_map(wide)
    rows = [(c, itemsets.text(k)) for c, attrs in enumerate(PARTS) for k in keys.category_keys(found, attrs, domain, "fm_other")]
    return spark.createDataFrame(rows, "client int, key string")


@query("r9_public_keys", on_orders("with h as (select attr // 2 client, attr, value from histogram) select client::int client, '{a' || attr || '=' || value || '}' as key from h union all select a.client::int, '{a' || a.attr || '=' || a.value || ', a' || b.attr || '=' || b.value || '}' from h a join h b on a.client = b.client and a.attr < b.attr"))
def _(spark, d):
    domain = encode.domain_map(_orders(spark, d))
    return spark.createDataFrame([(c, itemsets.text(k)) for c, attrs in enumerate(PARTS) for k in keys.public_keys(domain, attrs)], "client int, key string")


@query("b2_weighted_budget", on_orders(f"select client::int client, {_TEXT('part')} as key, round_even(0.125 * w / sum(w) over (partition by client), 9)::double epsilon from (select distinct client, part, case when len(part) > 1 then 4.0 else 1.0 end w from owned)", *_KEYS))
def _(spark, d):
    table = keys.key_table(_noisy_candidates(spark, d)[2], _owners(spark), keys.LOCAL)
    weight = F.when(F.size("key") > 1, F.lit(4.0)).otherwise(F.lit(1.0))
    return budget.weighted_budget_table(table, 0.125, 1e-5, weight).select("client", itemsets.text_column(F.col("key")).alias("key"), _round("epsilon", 9).alias("epsilon"))


@query("b4_grouped_budget", on_orders(f"with g as (select distinct client, part, list_transform(part, lambda x: x.attr) a from owned) select client::int client, {_TEXT('part')} as key, round_even(0.125 / (select count(distinct a) from g h where h.client = g.client), 9)::double epsilon from g", *_KEYS))
def _(spark, d):
    table = keys.key_table(_noisy_candidates(spark, d)[2], _owners(spark), keys.LOCAL)
    return budget.grouped_budget_table(table, 0.125, 1e-5).select("client", itemsets.text_column(F.col("key")).alias("key"), _round("epsilon", 9).alias("epsilon"))


@query("b3_key_groups", on_orders("select client::int client, array_to_string(list_transform(part, lambda x: x.attr), ',') as attrs, count(distinct part) keys from owned group by all", *_KEYS))
def _(spark, d):
    table = keys.key_table(_noisy_candidates(spark, d)[2], _owners(spark), keys.LOCAL)
    attrs = F.array_join(F.transform("key", lambda x: x["attr"].cast("string")), ",")
    return table.groupBy("client", attrs.alias("attrs")).agg(F.count(F.lit(1)).alias("keys"))


@query("b1_equal_budget", "select round_even(0.5 / i, 12)::double epsilon, i::int keys from range(1, 6) t(i)")
def _(spark, d):
    return spark.createDataFrame([(budget.split_equal(0.5, 1e-5, i)[0], i) for i in range(1, 6)], "epsilon double, keys int").withColumn("epsilon", _round("epsilon", 12))


@query("b5_mode_budgets", "select * from (values ('grouped', 0.0625::double), ('equal', round_even(0.125 / 3, 12)::double), ('joint', round_even(0.125 * 2 / 4, 12)::double)) t(kind, epsilon)")
def _(spark, d):
    some = [((0, 1),), ((0, 2),), ((0, 1), (1, 3))]
    rows = [("grouped", budget.key_budgets(some, 0.125, 1e-5, True, 4.0)[some[0]][0]), ("equal", budget.key_budgets(some, 0.125, 1e-5, True, 0.0)[some[0]][0]), ("joint", budget.key_budgets(some, 0.125, 1e-5, False, 4.0, 2.0)[some[2]][0])]
    return spark.createDataFrame(rows, "kind string, epsilon double").withColumn("epsilon", _round("epsilon", 12))


@query("b6_phases", "select round_even(0.5 * 0.1 / 4, 12)::double epsilon_n, round_even(0.5 * 0.9 / 4, 12)::double epsilon_counts, round_even(0.5 / 4, 12)::double epsilon_reports")
def _(spark, d):
    p = budget.phases(1.0, 1e-5, 4, 0.5, 0.1)
    names = ("epsilon_n", "epsilon_counts", "epsilon_reports")
    return spark.createDataFrame([tuple(p[k] for k in names)], ", ".join(f"{k} double" for k in names)).select(*(_round(k, 12).alias(k) for k in names))


@query("b7_coordinate_epsilon", "select m::int m, round_even(0.125 / (4 * sqrt(m * ln(1 / 1e-5))), 12)::double eta from (values (64), (256), (2048)) t(m)")
def _(spark, d):
    rows = spark.createDataFrame([(64,), (256,), (2048,)], "m int")
    eta = F.lit(0.125) / (F.lit(4.0) * F.sqrt(F.col("m") * F.log(F.lit(1.0) / F.lit(1e-5))))
    return rows.select("m", _round(eta, 12).alias("eta"))


@query("b8_overlap_account", on_orders("with c as (select sum(2.0 * 2048 * bound * power(0.125 / bound / (4 * sqrt(2048 * ln(1 / (1e-5 / 4 / bound)))), 2)) c from (select client, count(distinct list_transform(part, lambda x: x.attr)) bound from owned group by client)), l as (select c, ln(1 / 1e-5) l from c), o as (select c, l, greatest(2, 1 + sqrt(l / c)) o from l) select round_even(c, 9)::double rdp_coefficient, round_even(o, 6)::double rdp_order, round_even(c * o + l / (o - 1), 6)::double rdp_epsilon from o", *_KEYS))
def _(spark, d):
    table = keys.key_table(_noisy_candidates(spark, d)[2], _owners(spark), keys.LOCAL)
    shares = budget.grouped_budget_table(table, 0.125, 1e-5 / 4)
    clients = shares.groupBy("client").agg(F.max("groups").alias("bound"), F.max(budget.coordinate_epsilon_column(F.col("epsilon"), F.col("delta"), 2048)).alias("coordinate"))
    out = budget.overlap_account_table(clients, 2048, 1e-5)
    return out.select(_round("rdp_coefficient", 9).alias("rdp_coefficient"), _round("rdp_order").alias("rdp_order"), _round("rdp_epsilon").alias("rdp_epsilon"))


@query("b9_overlap_bounds", on_orders("select client::int client, (count(distinct case when len(part) = 1 then part[1].attr end) + count(distinct case when len(part) > 1 then part end)) bound, count(distinct list_transform(part, lambda x: x.attr)) groups from owned group by client", *_KEYS))
def _(spark, d):
    found = candidates.collect_candidates(_noisy_candidates(spark, d)[2])
    rows = [(c, budget.overlap_bound(k), budget.group_bound(k)) for c, attrs in enumerate(PARTS) if (k := keys.report_keys(found, attrs, keys.LOCAL))]
    return spark.createDataFrame(rows, "client int, bound bigint, groups bigint")


_SPENDING = [(e, c, split, share) for e in (0.25, 1.0, 4.0) for c in (2, 4, 8) for split in (0.1, 0.5, 0.9) for share in (0.9, 1.0, 1.1)]


@query("b10_certificate", "select epsilon::double epsilon, clients::int clients, split::double split, share::double share, share <= 1 as within from (values " + ", ".join(map(str, _SPENDING)) + ") t(epsilon, clients, split, share)")
def _(spark, d):
    """Whether what clients really spend, a share of what their phases allow, stays in the budget."""
    rows = []
    for e, c, split, share in _SPENDING:
        allowed = budget.phases(e, 1e-5, c, split, 0.1)
        spent = {k: c * v * share for k, v in allowed.items() if k.startswith("epsilon")}
        rows.append((e, c, split, share, budget.certificate(spent, e)))
    return spark.createDataFrame(rows, "epsilon double, clients int, split double, share double, within boolean")


# Bins


@query("q1_even_bins", on_orders("select attr, value, ((row_number() over (partition by attr order by value) - 1) * least(4, count(*) over (partition by attr)) // count(*) over (partition by attr))::bigint bin from histogram"))
def _(spark, d):
    return binning.even_bins_table(_domain(_orders(spark, d)), 4)


def _mass_sql(rows: str, bins: str, most: int) -> str:
    """CTEs that end in placed (attr, value, bin): mass_bins of rows (attr, value, n); `bins`, at most `most`, is an expression of rows' columns and m, the values of an attribute."""
    steps = [
        f"p as (select attr, value, row_number() over o i, sum(greatest(n, 0)) over o c, count(*) over a m, sum(greatest(n, 0)) over a total, least({bins}, count(*) over a) b from {rows} window o as (partition by attr order by value rows unbounded preceding), a as (partition by attr))",
        "e0 as (select distinct attr, 0 i, 0.0::double c from p)",
    ]
    for k in range(1, most):
        share = f"e.c + (p.total - e.c) / (p.b - {k - 1})"
        steps.append(f"e{k} as (select p.attr, p.i, p.c from p join e{k - 1} e on p.attr = e.attr where p.b > {k} and p.i > e.i and p.i <= p.m - (p.b - {k}) qualify row_number() over (partition by p.attr order by abs(p.c - ({share})), p.i) = 1)")
    ends = " union all ".join(f"select attr, i from e{k}" for k in range(1, most))
    steps.append(f"placed as (select p.attr, p.value, case when any_value(total) > 0 then count(e.i) else any_value((p.i - 1) * b // m) end::bigint bin from p left join ({ends}) e on e.attr = p.attr and e.i < p.i group by p.attr, p.value)")
    return ", ".join(steps)


@query("k12_mass_bins", on_orders("select attr::int attr, value, bin from placed", _NOISY, _mass_sql("noisy", "4", 4)))
def _(spark, d):
    return binning.quantile_plan_table(_noisy(spark, d)[1], 4)


_ALONE = """ranked as (select n.attr, n.value, n.n, coalesce(score, 0) > 0 as good, row_number() over (partition by n.attr order by greatest(coalesce(score, 0), 0) desc, n.n desc, n.value) place, count(*) over (partition by n.attr) size
    from noisy n left join (select k[1].attr attr, k[1].value as value, score from best where len(k) = 1) s on s.attr = n.attr and s.value = n.value),
    alone as (select *, size <= 4 or good and place <= 2 as single from ranked), tail as (select *, (select count(*) from alone x where x.attr = alone.attr and x.single) taken from alone where not single)"""


@query("q3_protected_bins", on_orders("select attr::int attr, value, (dense_rank() over (partition by attr order by low) - 1)::bigint bin from (select attr, value, min(value) over (partition by attr, bin) low from (select attr, value, bin from placed union all select attr, value, -1 - value from alone where single))", _NOISY, *_candidate_ctes(**_POOL), _ALONE, _mass_sql("tail", "4 - taken", 4)))
def _(spark, d):
    wide, table, best = _noisy_candidates(spark, d)
    scores = {c.itemset[0]: c.score for c in candidates.collect_candidates(best) if len(c.itemset) == 1}
    noisy = {(r["attr"], r["value"]): r["noisy"] for r in table.collect()}
    plan = binning.protected_plan(encode.domain_map(wide), noisy, 4, scores)
    return spark.createDataFrame(binning.plan_rows(plan), "attr int, value bigint, bin bigint")


_BINS = "bins as (select attr, value, ((row_number() over (partition by attr order by value) - 1) * least(4, count(*) over (partition by attr)) // count(*) over (partition by attr))::bigint bin from histogram)"


@query("q4_binned_items", on_orders("select attr, bin, count(*) n from cells join bins using (attr, value) group by attr, bin", _BINS))
def _(spark, d):
    wide = _orders(spark, d)
    plan = binning.even_bins_table(_domain(wide), 4)
    return binning.binned_table(counts.histogram(wide), plan).groupBy("attr", "bin").agg(F.sum("n").alias("n"))


@query("q5_share_in_bin", on_orders("select attr, value, bin, round_even(case when t > 0 then n / t else 1.0 / c end, 9)::double share from (select attr, value, bin, n, sum(n) over (partition by attr, bin) t, count(*) over (partition by attr, bin) c from noisy join bins using (attr, value))", _NOISY, _BINS))
def _(spark, d):
    wide, table = _noisy(spark, d)
    out = binning.share_in_bin_table(table, binning.even_bins_table(_domain(wide), 4))
    return out.select("attr", "value", "bin", _round("share", 9).alias("share"))


# Sketches and estimators

_SMALL = 16


@query("n1_seeds", on_orders("select attr, value, substr(sha256(concat_ws('|', 2026, 'client_' || (attr // 2), attr, value)), 1, 16) seed from histogram"))
def _(spark, d):
    client = F.concat(F.lit("client_"), F.floor(F.col("attr") / 2).cast("string"))
    return counts.histogram(_orders(spark, d)).select("attr", "value", prf.seed_hex(SEED, client, F.col("attr"), F.col("value")).alias("seed"))


_RANKS = f"k as materialized (select j, {splitmix(f'j::uhugeint + {SEED}::uhugeint')} s from range({_SMALL}) t(j)), h as materialized (select tid, a0, a5, j, {splitmix('xor(tid::ubigint, s)')} h from ord, k), rk as materialized (select tid, a0, a5, j, least(greatest(ceil(-ln(1 - ((h >> 11)::double + 0.5) / 9007199254740992.0) / ln(2.0)), 1), 65535)::int rank from h), sk as materialized (" + " union all ".join(f"select '{k}' as key, j::int j, coalesce(max(case when {c} then rank end), 0)::int rank from rk group by j" for k, c in (("a0=2", "a0 = 2"), ("a5=3", "a5 = 3"), ("both", "a0 = 2 and a5 = 3"), ("none", "a0 = 77"))) + ")"


@query("n4_shared_ranks", on_orders("select tid, j::int j, rank from rk", _RANKS))
def _(spark, d):
    return sketch.rank_table(_orders(spark, d), _SMALL, SEED)


_MEMBERS = {"a0=2": ((0, 2),), "a5=3": ((5, 3),), "both": ((0, 2), (5, 3)), "none": ((0, 77),)}


def _sketches(spark, d) -> DataFrame:
    return sketch.sketch_table(_orders(spark, d), {k: counts.matches(s) for k, s in _MEMBERS.items()}, _SMALL, SEED)


@query("a6_max_sketch", on_orders("select key, j, rank from sk", _RANKS))
def _(spark, d):
    return _sketches(spark, d)


@query("n6_parameters", "select epsilon, ceil(1 / (exp(e) - 1))::bigint phantoms, ceil(-ln(1 - exp(-e)) / ln(2.0))::bigint floor from (select epsilon::double epsilon, epsilon / (4 * sqrt(16 * ln(1 / 1e-5))) e from (values (0.5), (2.0), (8.0)) t(epsilon))")
def _(spark, d):
    rows = spark.createDataFrame([(0.5,), (2.0,), (8.0,)], "epsilon double")
    phantoms, floor = sketch.parameter_columns(F.col("epsilon"), F.lit(1e-5), _SMALL)
    return rows.select("epsilon", phantoms.alias("phantoms"), floor.alias("floor"))


_P, _FLOOR = sketch.parameters(8.0, 1e-5, _SMALL)
_NOISE = f"ceil(-ln(1 - exp(ln({uniform(tag('2026', 'key', 'j'))}) / {_P})) / ln(2.0))"
_PRIVATE = f"pv as materialized (select key, j, rank, greatest(rank::double, {_NOISE}, {_FLOOR})::double alpha from sk)"


def _private(spark, d) -> DataFrame:
    return sketch.private_table(_sketches(spark, d), 8.0, 1e-5, _SMALL, SEED)


def _rows(spark, d) -> int:
    return _orders(spark, d).count()


@query("n7_phantom_ranks", on_orders(f"select key, j, {_NOISE}::bigint noise from sk", _RANKS))
def _(spark, d):
    return _sketches(spark, d).select("key", "j", sketch.phantom_max(F.lit(_P), 1.0, SEED, F.col("key"), F.col("j")).alias("noise"))


@query("n8_private_sketch", on_orders("select key, j, alpha from pv", _RANKS, _PRIVATE))
def _(spark, d):
    return _private(spark, d).select("key", "j", "alpha")


@query("e1_cardinality", on_orders(f"select key, round_even({_SMALL} * 0.7213 / (1 + 1.079 / {_SMALL}) / sum(power(2.0, -alpha)) - {_P}, 6)::double estimate from pv group by key", _RANKS, _PRIVATE))
def _(spark, d):
    return sketch.cardinality_table(_private(spark, d), _SMALL, _P).select("key", _round("estimate").alias("estimate"))


def _cdf(x: str) -> str:
    return f"ln(1 - power(2.0, -({x})))"


_GRID = "rows as (select count(*)::double n, greatest(50, ceil(count(*) / 1500.0)) w from ord), grid as (select (row_number() over (order by size) - 1) place, size from (select distinct least(i * w, n)::double size from (select n, w, unnest(range(0, ceil(n / w)::bigint + 1)) i from rows)))"
_SCORES = f"""scores as (select key, place, size, round_even(sum(times * case when alpha <= {_FLOOR} then high else high + ln(1 - least(exp(least(0.0, coalesce(low - high, '-inf'::double))), 1.0 - 1e-15)) end), 6) score from (select key, alpha, times, place, size, (size + {_P}) * {_cdf('alpha')} high,
    case when alpha > 1 then (size + {_P}) * {_cdf('alpha - 1')} end low from (select key, alpha, count(*) times from pv group by key, alpha), grid) group by key, place, size)"""


@query("e4_marginal_map", on_orders("select key, size estimate from (select *, row_number() over (partition by key order by score desc, place) r from scores) where r = 1", _RANKS, _PRIVATE, _GRID, _SCORES))
def _(spark, d):
    return sketch.marginal_map_table(_private(spark, d), float(_rows(spark, d)), _P, _FLOOR, 50, 1500)


@query("a9_likelihood", on_orders("select key, round_even(max(score), 4)::double best from scores group by key", _RANKS, _PRIVATE, _GRID, _SCORES))
def _(spark, d):
    sizes = sketch.grid(float(_rows(spark, d)), 50, 1500)

    def best(pdf):
        import pandas as pd

        scores = sketch.likelihood(pdf["alpha"].to_numpy(), _P, _FLOOR, sizes, 1.0)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "best": [round(float(scores.max()), 4)]})

    return _private(spark, d).groupBy("key").applyInPandas(best, "key string, best double")


@query("e3_log_cdf", f"select x::int x, round_even({_cdf('x')}, 9)::double log_cdf from range(1, 21) t(x)")
def _(spark, d):
    return spark.range(1, 21).select(F.col("id").cast("int").alias("x"), _round(sketch.log_cdf_column(F.col("id").cast("double")), 9).alias("log_cdf"))


@query("e2_size_grid", "select least(i * 10.0, 14998.0)::double size from range(1501) t(i) where i * 10 <= 15000")
def _(spark, d):
    return spark.createDataFrame([(float(x),) for x in sketch.grid(14998.0, 5, 1500)], "size double")


@query("e6_bounds", on_orders("with s as (select t, unnest(k) x from best where size > 1), c as (select t, n::double n from s join histogram h on h.attr = x.attr and h.value = x.value) select t as itemset, least(ceil(greatest(0, sum(n) - (count(*) - 1) * (select count(*)::double from ord))), floor(min(n)))::bigint lower, floor(min(n))::bigint as upper from c group by t", *_candidate_ctes()))
def _(spark, d):
    wide, best = _some_candidates(spark, d)
    items = best.where(F.size("itemset") > 1).select(itemsets.text_column(F.col("itemset")).alias("candidate"), F.explode("itemset").alias("x"))
    h = counts.histogram(wide)
    sizes = items.join(h, (F.col("x.attr") == h["attr"]) & (F.col("x.value") == h["value"])).select("candidate", F.col("n").alias("size"))
    return sketch.bounds_table(sizes, float(wide.count())).withColumnRenamed("candidate", "itemset")


@query("e8_complement_inverse", on_orders(f"select round_even(least(greatest((select count(*) from ord) - ({_SMALL} * 0.7213 / (1 + 1.079 / {_SMALL}) / sum(power(2.0, -alpha)) - {2 * _P}), 0), (select count(*) from ord)), 6)::double estimate from (select j, max(alpha) alpha from pv where key in ('a0=2', 'a5=3') group by j)", _RANKS, _PRIVATE))
def _(spark, d):
    merged = _private(spark, d).where(F.col("key").isin("a0=2", "a5=3")).groupBy("j").agg(F.max("alpha").alias("alpha")).withColumn("key", F.lit("union"))
    union = sketch.cardinality_table(merged, _SMALL, 2 * _P)
    n = F.lit(float(_rows(spark, d)))
    return union.select(_round(F.least(F.greatest(n - F.col("estimate"), F.lit(0.0)), n)).alias("estimate"))


def _reports(spark, d, m: int = 256, epsilon: float = 50.0) -> list[sketch.Report]:
    wide = _orders(spark, d)
    some = [((0, 2),), ((5, 3),), ((0, 2), (5, 3)), ((3, 1),)]
    clean = sketch.clean_sketches(wide, [counts.matches(s) for s in some], m, SEED)
    return [sketch.release(0, s, c, epsilon, 1e-5, 1.0, SEED + k) for k, (s, c) in enumerate(zip(some, clean, strict=True))]


@query("e14_joint_map")
def _(spark, d):
    a, b, _, c = _reports(spark, d)
    n = _rows(spark, d)
    rows = [("two", sketch.joint_map([a, b], n, 1.0, 5, 1500)), ("three", sketch.joint_map([a, b, c], n, 1.0, 5, 1500)), ("dense", sketch.joint_map([a, b], n, 1.0, 5, 1500, adaptive=False))]
    return spark.createDataFrame(rows, "blocks string, estimate double")


@query("e16_nested_map")
def _(spark, d):
    a, b, both, _ = _reports(spark, d)
    return spark.createDataFrame([(sketch.nested_map(a, b, both, _rows(spark, d), 1.0, 5, 1500),)], "estimate double")


_M, _BUDGET = 64, 50.0
_P256, _FLOOR256 = sketch.parameters(_BUDGET, 1e-5, _M)


def _released(members: dict[str, str]) -> list[str]:
    """alpha by j: the merged released sketches of keys, each with the SQL of its members and phantoms of its own seed."""
    ranks = f"kk as materialized (select j, {splitmix(f'j::uhugeint + {SEED}::uhugeint')} s from range({_M}) t(j)), hh as materialized (select a0, a5, j, {splitmix('xor(tid::ubigint, s)')} h from ord, kk), rr as materialized (select a0, a5, j, least(greatest(ceil(-ln(1 - ((h >> 11)::double + 0.5) / 9007199254740992.0) / ln(2.0)), 1), 65535)::int r from hh)"
    each = []
    for k, condition in enumerate(members.values()):
        noise = f"ceil(-ln(1 - exp(ln({uniform(tag(str(SEED + k), chr(39) + 'phantom' + chr(39), 'j'))}) / {_P256})) / ln(2.0))"
        each.append(f"select j, greatest(coalesce(max(case when {condition} then r end), 0)::double, any_value({noise}), {_FLOOR256}) alpha from rr group by j")
    return [ranks, "mg as materialized (select j, max(alpha)::double alpha from (" + " union all ".join(each) + ") group by j)"]


def _inverse_sql(keys: int) -> str:
    """The size of the union of so many keys by the inverse of the sketch."""
    return f"({_M} * 0.7213 / (1 + 1.079 / {_M}) / sum(power(2.0, -alpha)) - {keys * _P256})"


_WIDTH = "greatest(5, ceil(n / 1500))"
_UNION_MAP = f"""nn as (select count(*)::double n from ord), gr as (select distinct least(i * w, n)::double size from (select n, {_WIDTH} w, unnest(range(0, ceil(n / {_WIDTH})::bigint + 1)) i from nn)),
    sc as (select size, sum(times * case when alpha <= {_FLOOR256} then high else high + ln(1 - least(exp(least(0.0, coalesce(low - high, '-inf'::double))), 1.0 - 1e-15)) end) score from (select size, alpha, times, (size + {2 * _P256}) * ln(1 - power(2.0, -alpha)) high, case when alpha > 1 then (size + {2 * _P256}) * ln(1 - power(2.0, 1 - alpha)) end low
    from (select alpha, count(*) times from mg group by alpha), gr) group by size)"""


@query("e7_complement_map", on_orders(f"select n - (select size from sc order by score desc, size limit 1) map, round_even(least(greatest(n - (select {_inverse_sql(2)} from mg), 0), n), 6)::double inverse from nn", *_released({"a0=2": "a0 <> 2", "a5=3": "a5 <> 3"}), _UNION_MAP))
def _(spark, d):
    wide = _orders(spark, d)
    some = [((0, 2),), ((5, 3),)]
    clean = sketch.clean_sketches(wide, [~counts.matches(s) for s in some], _M, SEED)
    reports = [sketch.release(0, s, c, _BUDGET, 1e-5, 1.0, SEED + k, complement=True) for k, (s, c) in enumerate(zip(some, clean, strict=True))]
    n = wide.count()
    return spark.createDataFrame([(sketch.complement_map(reports, n, 1.0, 5, 1500), round(sketch.complement_inverse(reports, n, 1.0), 6))], "map double, inverse double")


_OTHERS = [((0, 0),), ((0, 1),), ((5, 0),), ((5, 1),), ((5, 2),)]


@query("e9_category_inverse", on_orders(f"select round_even(least(greatest(n - (select {_inverse_sql(len(_OTHERS))} from mg), 0), n), 6)::double estimate, n \"without\" from (select count(*)::double n from ord)", *_released({str(s): f"a{s[0][0]} = {s[0][1]}" for s in _OTHERS})))
def _(spark, d):
    wide = _orders(spark, d)
    clean = sketch.clean_sketches(wide, [counts.matches(s) for s in _OTHERS], _M, SEED)
    reports = [sketch.release(0, s, c, _BUDGET, 1e-5, 1.0, SEED + k) for k, (s, c) in enumerate(zip(_OTHERS, clean, strict=True))]
    n = wide.count()
    return spark.createDataFrame([(round(sketch.category_inverse(reports, n, 1.0), 6), sketch.category_inverse([], n, 1.0))], "estimate double, without double")


# Whole methods

_RUN = config.Protocol(m=256, epsilon=8.0)


def _method(method: str) -> Query:
    def run(spark, d):
        owned = protocol.prepare(_orders(spark, d), config.Config(protocol=_RUN))
        return protocol.as_table(spark, protocol.run_method(owned, _RUN, method)[0])

    return run


def _first_ctes(epsilon: float, epsilon_n: float) -> list[str]:
    """The first round's noisy counts and row number at a client's epsilons, and its candidates."""
    q = lambda x: f"'{x}'"
    client = "'client_' || (attr // 2)"
    noisy = f"first as materialized (select attr, value, greatest(round_even(n + {laplace(f'2 / {epsilon!r}', tag(str(SEED), client, q('round1'), 'attr', 'value'))}, 9), 0)::double n from histogram)"
    each = f"round_even((select count(*) from ord) + {laplace(repr(1.0 / epsilon_n), tag(str(SEED), q('client_') + ' || c', q('noisy_n')))}, 9)::double"
    return [noisy, f"guessed as materialized (select greatest(1.0, avg(x))::double n from (select {each} x from range({CLIENTS}) t(c)))", *_candidate_ctes(4, 30, "first", "n from guessed, (select 1", 15)]


def _first_sql() -> list[str]:
    return [x.replace("total as (select n from guessed, (select 1 total)", "total as (select n total from guessed)") for x in _first_ctes(_RUN.epsilon * 0.9 / CLIENTS, _RUN.epsilon * 0.1 / CLIENTS)]


_RANKED = "select (row_number() over (order by estimate desc, k))::int as \"rank\", t as itemset, round_even(estimate, 6)::double estimate, round_even(guess, 6)::double guess from "
_CENTRAL = [x.replace("total as (select n from guessed, (select 1 total)", "total as (select n total from guessed)") for x in _first_ctes(_RUN.epsilon * 0.5 * 0.9 / CLIENTS, _RUN.epsilon * 0.5 * 0.1 / CLIENTS)]
_METHOD_SQL = {"First-round": on_orders(_RANKED + "(select *, guess estimate from best)", *_first_sql())}

for _name, _key in (("MAP-M", "m1_map_m"), ("MAP-S", "m1_map_s"), ("MAP-L", "m1_map_l"), ("IE-Full", "m1_ie_full"), ("IE-Other", "m1_ie_other"), ("FO", "m2_fo"), ("First-round", "m3_first_round"), ("Second-round", "m4_second_round"), ("Items-only", "m4_items_only")):
    query(_key, _METHOD_SQL.get(_name))(_method(_name))


def _mode(mode: str, **more) -> Query:
    def run(spark, d):
        from dataclasses import replace

        p = replace(_RUN, modes=(mode,), **more)
        owned = protocol.prepare(_orders(spark, d), config.Config(protocol=p))
        return protocol.as_table(spark, protocol.two_round(owned, p, mode)[0])

    return run


query("m5_map_m_bin")(_mode(keys.BINNED, bins=4))
query("m5_map_m_binp")(_mode(keys.PROTECTED, bins=4))
query("m5_map_m_cover")(_mode(keys.COVER))
query("m5_map_l_top")(_mode(keys.LOCAL_TOP, top_joint=3))
query("m5_fm_inverse")(_mode(keys.SINGLE, estimator="fm_inverse"))
query("m5_bounds_only")(_mode(keys.SINGLE, estimator="map_bounds_only"))
query("m5_no_lower_bound")(_mode(keys.SINGLE, estimator="map_no_frechet"))


_CENTRAL_NOISE = laplace(f"30 / {_RUN.epsilon * 0.5!r}", tag(str(SEED), "'central'", "c"))


@query("m6_central", on_orders(_RANKED + f"(select k, t, guess, least(greatest(round_even(n + {_CENTRAL_NOISE}, 9), 0), (select total from total))::double estimate from (select b.*, coalesce(s.n, 0) n, row_number() over (order by b.score desc, b.k) - 1 c from best b left join sets s on s.t = b.t))", *_CENTRAL, oracle.itemset_counts(4, "pool")))
def _(spark, d):
    owned = protocol.prepare(_orders(spark, d), config.Config(protocol=_RUN))
    return protocol.as_table(spark, protocol.central(owned, _RUN))


def _audit_sql() -> str:
    """Metrics of the first round's candidates against the exact top 15 of all itemsets."""
    every = oracle.itemset_counts(4, "histogram")
    judged = f"""est as (select t, guess estimate, k from best), tops as (select t, k, n from sets order by n desc, k limit 15),
    truth as (select t, k, n from tops union select s.t, s.k, s.n from sets s join est using (t) union select e.t, e.k, 0 from est e left join sets s using (t) where s.t is null),
    rk as (select coalesce(a.t, b.t) t, a.n support, b.estimate, p, g from (select *, row_number() over (order by n desc, k) p from truth) a full join (select *, row_number() over (order by estimate desc, k) g from est) b on a.t = b.t),
    sums as (select 15.0::double top, least(15, count(g))::double predicted, count_if(p <= 15 and g <= 15)::double hit, count_if(p <= 15 and g is not null)::double covered, coalesce(sum(p) filter (p <= 15 and g <= 15), 0)::double places, avg(abs(estimate - support)) mae, sqrt(avg(power(estimate - support, 2))) rmse, (select count(*) from ord)::double total from rk)"""
    out = {
        "precision": "hit / predicted", "recall": "hit / top", "f1": "2 * hit / (top + predicted)", "jaccard": "hit / (top + predicted - hit)", "ncr": "(hit * (top + 1) - places) / (top * (top + 1) / 2)",
        "mae": "mae", "rmse": "rmse", "nmae": "mae / total", "nrmse": "rmse / total", "candidate_recall": "covered / top", "mse": "rmse * rmse", "frequency_mse": "rmse * rmse / (total * total)",
    }
    return on_orders("with " + judged + " " + " union all ".join(f"select '{m}' metric, round_even({e}, 6)::double as value from sums" for m, e in out.items()), *_first_sql(), every)


@query("v5_audit", _audit_sql())
def _(spark, d):
    owned = protocol.prepare(_orders(spark, d), config.Config(protocol=_RUN))
    scores = protocol.audit(owned, protocol.run_method(owned, _RUN, "First-round")[0], _RUN)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in scores.items()], "metric string, value double")


_SWEPT = {
    "epsilon": "[0.25, 0.5, 1, 2, 4]", "k": "[5, 10, 15, 20, 25]", "clients": "[2, 4, 8]", "sample_ratio": "[0.2, 0.4, 0.6, 0.8, 1]", "feature_ratio": "[0.2, 0.4, 0.6, 0.8, 1]",
    "domain_ratio": "[0.2, 0.4, 0.6, 0.8, 1]", "first_stage_pool": "[0.5, 0.75, 1, 1.5, 2]", "second_stage_pool": "[0.5, 0.75, 1, 1.5, 2]", "candidate_pool": "[1, 1.5, 2, 2.5, 5]",
    "budget_split": "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]", "mechanism": "[1]",
}


def _sweep_sql() -> str:
    points = " union all ".join(f"select {n} experiment, '{axis}' axis, unnest({values}::double[]) as value" for n, (axis, values) in enumerate(_SWEPT.items(), 1))
    of = lambda axis, kind, other: f"case when axis = '{axis}' then value::{kind} else {other} end"
    pool = lambda axis: f"case when axis = '{axis}' then greatest(1, round_even(15 * value, 0))::int else {of('k', 'int', '15')} end"
    return f"""select experiment, axis, value, seed::int seed, {of('k', 'int', '15')} k, {of('epsilon', 'double', '1.0::double')} epsilon, {of('clients', 'int', '4')} clients, {of('candidate_pool', 'double', '2.0::double')} multiplier,
    {of('budget_split', 'double', '0.5::double')} phase1_ratio, {of('sample_ratio', 'double', 'null')} sample_ratio, {of('feature_ratio', 'double', 'null')} feature_ratio, {of('domain_ratio', 'double', 'null')} domain_ratio,
    {pool('first_stage_pool')} report_limit, {pool('second_stage_pool')} upload_limit, seed::int sampling_seed, seed::int transform_seed,
    case when axis = 'mechanism' then 'First-round Second-round MAP-M' else 'MAP-M IE-Full IE-Other FO' end methods from ({points}), (values (2026), (2027)) s(seed)"""


@query("w3_sweep_cases", _sweep_sql())
def _(spark, d):
    rows = []
    for x in config.points(config.Config(), seeds=(2026, 2027), tables=("custom",)):
        p, t = x.config.protocol, x.config.data
        rows.append((x.number, x.axis, x.value, x.seed, p.k, p.epsilon, t.clients, p.multiplier, p.phase1_ratio, t.sample_ratio, t.feature_ratio, t.domain_ratio, p.report_limit, p.upload_limit, t.sampling_seed, t.transform_seed, " ".join(x.methods)))
    kinds = "experiment int, axis string, value double, seed int, k int, epsilon double, clients int, multiplier double, phase1_ratio double, sample_ratio double, feature_ratio double, domain_ratio double, report_limit int, upload_limit int, sampling_seed int, transform_seed int, methods string"
    return spark.createDataFrame(rows, kinds)


@query("w5_grid_cases")
def _(spark, d):
    """The cases of the large grid, with all axes that each belongs to, and the denser values."""
    rows = [(c.table, c.seed, "+".join(c.axes), dense, files.signature({"config": repr(c.config)})[:16]) for dense in (False, True) for c in config.grid_cases(config.Config(), dense=dense)]
    return spark.createDataFrame(rows, "dataset string, seed int, axes string, dense boolean, config string")


# Metrics and message sizes


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    """Exact supports of the exact-pool candidates, and noisy versions of them as estimates."""
    wide, best = _some_candidates(spark, d)
    found = candidates.collect_candidates(best)
    names = spark.createDataFrame([(k, [tuple(i) for i in c.itemset], c.guess) for k, c in enumerate(found)], "candidate int, itemset array<struct<attr:int,value:bigint>>, guess double")
    truth = counts.support_table(wide, [c.itemset for c in found]).join(names, "candidate")
    noise = prf.laplace(300.0, SEED, "judge", itemsets.text_column(F.col("itemset")))
    return truth.select("itemset", "support"), truth.select("itemset", _round(F.col("support") + noise, 9).alias("estimate"), "guess")


_JUDGED = [*_candidate_ctes(), oracle.itemset_counts(3, "pool"), f"tr as materialized (select b.k, b.t, b.size, b.guess, coalesce(s.n, 0) support from best b left join sets s on s.t = b.t), es as materialized (select *, round_even(support + {laplace('300.0', tag('2026', chr(39) + 'judge' + chr(39), 't'))}, 9)::double estimate from tr), rk as materialized (select *, row_number() over (order by support desc, k) p, row_number() over (order by estimate desc, k) g from es)"]
_R = lambda e, a: f"round_even({e}, 6)::double {a}"


@query("v1_ranking_metrics", on_orders(f"select {_R('b / 15', 'f1')}, {_R('b / (30.0 - b)', 'jaccard')}, {_R('(b * 16 - s) / 120.0', 'ncr')}, {_R('mae', 'mae')}, {_R('rmse', 'rmse')}, {_R('rmse / (select count(*) from ord)', 'nrmse')} from (select count_if(p <= 15 and g <= 15)::double b, sum(p) filter (p <= 15 and g <= 15) s, avg(abs(estimate - support)) mae, sqrt(avg(power(estimate - support, 2))) rmse from rk)", *_JUDGED))
def _(spark, d):
    out = metrics.evaluate(*_judged(spark, d), 15, _rows(spark, d))
    return out.select(*(_round(c).alias(c) for c in ("f1", "jaccard", "ncr", "mae", "rmse", "nrmse")))


@query("v2_metrics_by_size", on_orders(f"select size::int size, {_R('2 * b / (least(5, n) * 2)', 'f1')}, {_R('mae', 'mae')} from (select size, count(*) n, count_if(p <= 5 and g <= 5)::double b, avg(abs(estimate - support)) mae from (select *, row_number() over (partition by size order by support desc, k) p, row_number() over (partition by size order by estimate desc, k) g from es) group by size)", *_JUDGED).replace("rk as materialized (select *, row_number() over (order by support desc, k) p, row_number() over (order by estimate desc, k) g from es)", "rk as (select 1)"))
def _(spark, d):
    return metrics.by_size(*_judged(spark, d), 5, _rows(spark, d)).select("size", _round("f1").alias("f1"), _round("mae").alias("mae"))


@query("v3_errors_by_band", on_orders(f"select band, count(*) as \"count\", {_R('avg(abs(estimate - support))', 'mae')}, {_R('sqrt(avg(power(estimate - support, 2)))', 'rmse')} from (select *, case when support / total < 0.01 then '0-1%' when support / total < 0.05 then '1-5%' when support / total < 0.2 then '5-20%' else '20-100%' end band from rk, total) group by band", *_JUDGED))
def _(spark, d):
    out = metrics.by_band(*_judged(spark, d), _rows(spark, d))
    return out.select("band", "count", _round("mae").alias("mae"), _round("rmse").alias("rmse"))


@query("k9_spearman", on_orders(f"select {_R('corr(x, y)', 'spearman')} from (select rank() over (order by guess) + (count(*) over (partition by guess) - 1) / 2.0 x, rank() over (order by support) + (count(*) over (partition by support) - 1) / 2.0 y from rk)", *_JUDGED))
def _(spark, d):
    truth, estimates = _judged(spark, d)
    return metrics.spearman(truth.join(estimates, "itemset"), "guess", "support").select(_round("spearman").alias("spearman"))


@query("v4_recall_by_size", on_orders("select size::int size, count(*) true_top_count, count_if(g <= 20)::bigint recalled, round_even(count_if(g <= 20) / count(*), 6)::double recall from rk where p <= 15 group by size", *_JUDGED))
def _(spark, d):
    truth, estimates = _judged(spark, d)
    some = estimates.orderBy(F.desc("estimate"), "itemset").limit(20)
    return metrics.recall_by_size(truth, some, 15).select("size", "true_top_count", "recalled", _round("recall").alias("recall"))


@query("v6_tie_recall", on_orders("select round_even((count_if(g <= 15 and support > c) + least(count_if(g <= 15 and support = c), count_if(p <= 15 and support = c))) / 15, 6)::double tie_recall from rk, (select min(support) c from rk where p <= 15)", *_JUDGED))
def _(spark, d):
    truth, estimates = _judged(spark, d)
    some = estimates.orderBy(F.desc("estimate"), "itemset").limit(15).select("itemset")
    return metrics.tie_recall(truth, some, 15).select(_round("tie_recall").alias("tie_recall"))


@query("k11_k_sweep", on_orders(f"select n::int k, {_R('b / n', 'f1')}, {_R('(b * (n + 1) - s) / (n * (n + 1) / 2.0)', 'ncr')} from (select n, count_if(p <= n and g <= n)::double b, coalesce(sum(p) filter (p <= n and g <= n), 0) s from rk, (values (5), (10), (20)) t(n) group by n)", *_JUDGED))
def _(spark, d):
    return metrics.sweep_k(*_judged(spark, d), [5, 10, 20]).select("k", _round("f1").alias("f1"), _round("ncr").alias("ncr"))


@query("k10_rank_scores", on_orders("select t as itemset, (15 - p + 1)::int score from rk where p <= 15", *_JUDGED))
def _(spark, d):
    rows = metrics.ranked(*_judged(spark, d), 15).where("place <= 15")
    return rows.select(itemsets.text_column(F.col("itemset")).alias("itemset"), (F.lit(16) - F.col("place")).alias("score"))


@query("s14_mode_details", on_orders(f"select g::int as \"rank\", t as itemset, {_R('estimate', 'estimate')}, support, {_R('estimate - support', 'error')} from rk", *_JUDGED))
def _(spark, d):
    truth, estimates = _judged(spark, d)
    out = metrics.mode_details(estimates, truth)
    return out.select("rank", itemsets.text_column(F.col("itemset")).alias("itemset"), _round("estimate").alias("estimate"), "support", _round("error").alias("error"))


@query("w1_message_bytes", on_orders("select client::int client, u1 uplink1, down downlink, 0 bins, u2 uplink2, u1 + down + u2 total from (select client, u1, coalesce(u2, 0) u2, down from (select client, 2 + 8 + 24 + 4 + count(*) * 20 u1 from noisy group by client) left join (select client, 2 + 8 + 4 + sum(2 + len(part) * 12 + 24 + 1 + 4 + 2048 * 8)::bigint u2 from (select distinct client, part from owned) group by client) using (client), (select 4 + sum(2 + size * 12 + 8)::bigint down from best))", *_KEYS))
def _(spark, d):
    _, table, best = _noisy_candidates(spark, d)
    chosen = keys.key_table(best, _owners(spark), keys.LOCAL)
    return wire.total_table(wire.first_round_table(table), wire.second_round_table(chosen, 2048), wire.candidate_message(best, guess=True))


@query("w2_randomizer_bytes", "select (ceil(1000 / 8.0) + 8 * 4 + ceil(333 / 8.0) + 4 * (4 + (2 + 12 + 8) + (2 + 24 + 8) + 4 + 20 * 10))::bigint bytes")
def _(spark, d):
    size = wire.randomizer_bytes(1000, 333, 4, [((0, 1),), ((0, 1), (2, 3))], 10)
    return spark.createDataFrame([(size,)], "bytes bigint")


# Encrypted baselines


@query("cr1_circuit_supports", on_orders("select b.t as itemset, coalesce(s.n, 0) support, (select count(*) from ord) * (select count(*) from histogram) or_gates, (select count(*) from ord) * ceil(log2((select count(*) from ord) + 1.0))::bigint xor_gates from best b left join sets s on s.t = b.t", *_candidate_ctes(2, 20), oracle.itemset_counts(2, "pool")))
def _(spark, d):
    wide, best = _some_candidates(spark, d, 2, 20)
    found = candidates.collect_candidates(best)
    items = [(a, v) for a, vs in encode.domain_map(wide).items() for v in vs]
    names = spark.createDataFrame([(k, itemsets.text(c.itemset)) for k, c in enumerate(found)], "candidate int, itemset string")
    return circuits.circuit_supports(wide, items, [c.itemset for c in found]).join(names, "candidate").select("itemset", "support", "or_gates", "xor_gates")


@query("cr2_packed_operations", on_orders("with o as (select b.t, x.attr // 2 owner from (select t, unnest(k) x from best) b group by all), w as (select attr // 2 owner, count(*) items from histogram group by attr // 2), r as (select count(*) n, ceil(log2(count(*) + 1.0))::bigint width from ord) select t as itemset, (sum(items) * any_value(n))::bigint not_gates, (sum(items) * any_value(n))::bigint or_gates, ((sum(items) + count(*) - 1 + any_value(width)) * any_value(n))::bigint and_gates, (any_value(width) * any_value(n))::bigint xor_gates from o join w using (owner), r group by t", *_candidate_ctes(2, 20)))
def _(spark, d):
    wide, best = _some_candidates(spark, d, 2, 20)
    domain, n = encode.domain_map(wide), wide.count()
    items = {c: sum(len(domain[a]) for a in PARTS[c]) for c in range(CLIENTS)}
    found = candidates.collect_candidates(best)
    rows = [(itemsets.text(c.itemset), *circuits.packed_operations(n, c.itemset, partition.owner_map(PARTS), items)) for c in found]
    return spark.createDataFrame(rows, "itemset string, not_gates bigint, or_gates bigint, and_gates bigint, xor_gates bigint")


def _group_report_sql() -> str:
    def draw(*parts: str) -> str:
        u = uniform(tag("5", *parts, "tid"))
        return "(" + " + ".join(f"({u} >= {e}::double)::bigint" for e in (0.25, 0.5, 0.75)) + ")"

    cells = [f"case when {uniform(tag('5', chr(39) + 'use' + chr(39), str(a), 'tid'))} < 0.75 then {draw(chr(39) + 'latent' + chr(39), str(a // 4))} else {draw(chr(39) + 'own' + chr(39), str(a))} end" for a in range(8)]
    return f"""with cells as materialized (select tid, a, v from (select tid, unnest(range(8)) a, unnest([{', '.join(cells)}]) v from range(5000) t(tid))),
    h as (select a, v, count(*) / 5000.0 p from cells group by a, v), e as (select a, -sum(p * log2(p)) h, max(p) top from h group by a),
    j as (select l.a x, r.a y, l.v, r.v w, count(*) / 5000.0 p from cells l join cells r on l.tid = r.tid and l.a < r.a group by all),
    mi as (select x, y, sum(j.p * log2(j.p / (hx.p * hy.p))) / sqrt(any_value(ex.h) * any_value(ey.h)) nmi from j join h hx on hx.a = x and hx.v = j.v join h hy on hy.a = y and hy.v = w join e ex on ex.a = x join e ey on ey.a = y group by x, y)
    select round_even((select avg(h) from e), 6)::double entropy_bits, round_even((select avg(top) from e), 6)::double top_share, round_even(avg(nmi) filter (x // 4 = y // 4), 6)::double within_nmi, round_even(avg(nmi) filter (x // 4 <> y // 4), 6)::double across_nmi from mi"""


@query("a8_group_report", _group_report_sql())
def _(spark, d):
    wide = files.generate(spark, 5000, 8, 4, 4, 0.75, 0.0, 5)
    found = counts.group_report(wide, [a // 4 for a in range(8)])
    return found.select(*(_round(c).alias(c) for c in ("entropy_bits", "top_share", "within_nmi", "across_nmi")))


@query("cr5_homomorphic_sums", "select r_name region, count(*) n from region join nation on n_regionkey = r_regionkey group by r_name")
def _(spark, d):
    public, private = circuits.key_pair(256)
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.lit(1).alias("flag"))
    sums = circuits.homomorphic_sums(rows, ["region"], "flag", public).collect()  # a row for each region
    return spark.createDataFrame([(r["region"], private.decrypt(int(r["cipher"]))) for r in sums], "region string, n bigint")


@query("k13_frequency_classes", on_orders("select item, frequency, class, max(frequency) over (partition by class) - frequency deficit from (select item, frequency, least((row_number() over (order by frequency desc, item) - 1) // 4, greatest(count(*) over () // 4 - 1, 0)) class from (select 'item:' || attr || ':' || value item, n frequency from histogram))"))
def _(spark, d):
    h = counts.histogram(_orders(spark, d)).select(F.concat_ws(":", F.lit("item"), "attr", "value").alias("item"), F.col("n").alias("frequency"))
    return circuits.padding_table(h, 4)


@query("cr8_padding_rows", on_orders("select level, count(*) items from (select unnest(range(deficit)) level from (select max(frequency) over (partition by class) - frequency deficit from (select item, frequency, least((row_number() over (order by frequency desc, item) - 1) // 4, greatest(count(*) over () // 4 - 1, 0)) class from (select 'item:' || attr || ':' || value item, n frequency from histogram)))) group by level"))
def _(spark, d):
    h = counts.histogram(_orders(spark, d)).select(F.concat_ws(":", F.lit("item"), "attr", "value").alias("item"), F.col("n").alias("frequency"))
    return circuits.padding_rows(circuits.padding_table(h, 4)).select("level", F.size("items").cast("bigint").alias("items"))


@query("cr9_encrypted_mining", on_orders("select b.t as itemset, coalesce(s.n, 0) support from best b left join sets s on s.t = b.t", *_candidate_ctes(2, 8), oracle.itemset_counts(2, "pool")))
def _(spark, d):
    wide, best = _some_candidates(spark, d, 2, 8)
    found = candidates.collect_candidates(best)
    supports, _ = circuits.encrypted_mining(wide, [c.itemset for c in found], partition.owner_map(PARTS), 5, bits=256)
    return _top_table(spark, supports.items())


@query("cr11_hashed_rows", on_orders("select tid, sha256('secret|' || tid) htid from ord"))
def _(spark, d):
    return _orders(spark, d).select("tid", F.sha2(F.concat_ws("|", F.lit("secret"), F.col("tid").cast("string")), 256).alias("htid"))


# Streams


def _stream_folder(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return found or f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


_EVENTS = "with e as (select event_id tid, (dense_rank() over (order by event_type) - 1)::bigint a0, (user_id % 8)::bigint a1 from events)"


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    code = encode.Categories.fit(events, F.col("event_type")).code(F.col("event_type"))
    rows = incremental.source(spark, events, f"{d}/events*.parquet")
    return rows.select(F.col("event_id").alias("tid"), code.cast("bigint").alias("a0"), (F.col("user_id") % 8).cast("bigint").alias("a1"))


@query("st1_stream_histogram", f"{_EVENTS} select 0 attr, a0 as value, count(*) n from e group by a0 union all select 1, a1, count(*) from e group by a1")
def _(spark, d):
    return incremental.run_to_table(incremental.histogram(_event_stream(spark, d)), _stream_folder(spark))


_EVENT_RANKS = f"{_EVENTS}, k as materialized (select j, {splitmix(f'j::uhugeint + {SEED}::uhugeint')} s from range(8) t(j)), h as materialized (select tid, a0, a1, j, {splitmix('xor(tid::ubigint, s)')} h from e, k), rk as (select *, least(greatest(ceil(-ln(1 - ((h >> 11)::double + 0.5) / 9007199254740992.0) / ln(2.0)), 1), 65535)::int r from h)"


@query("st2_stream_sketch", f"{_EVENT_RANKS} select 'a0=1' as key, j::int j, max(r) as \"rank\" from rk where a0 = 1 group by j union all select 'both', j::int, max(r) from rk where a0 = 1 and a1 = 2 group by j")
def _(spark, d):
    members = {"a0=1": counts.matches(((0, 1),)), "both": counts.matches(((0, 1), (1, 2)))}
    return incremental.run_to_table(incremental.sketch(_event_stream(spark, d), members, 8, SEED), _stream_folder(spark))


@query("s8_archive_members", "select event_type, count(*) n, count(distinct user_id) users, sum(event_id)::bigint ids, round_even(sum(value), 6)::double total from events group by event_type")
def _(spark, d):
    """The events table written to ZIP archives of many CSV members, and read again as a table."""
    import uuid

    folder = f"{_stream_folder(spark)}/archives-{uuid.uuid4().hex[:12]}"
    columns = [("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double")]
    archives.write_archives(read(spark, d, "events").select(*(name for name, _ in columns)), folder, 2000)
    back = archives.read_archives(spark, folder, columns, partition_bytes=1 << 20)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.sum("event_id").alias("ids"), _round(F.sum("value")).alias("total"))


# Single supports, bits, probabilities and checks


@query("a1_support", on_orders("select count(*) support from ord where a0 = 2 and a3 = 1 and a5 = 3"))
def _(spark, d):
    return _orders(spark, d).agg(F.count_if(counts.matches(((0, 2), (3, 1), (5, 3)))).alias("support"))


def _bit_sql(truth: str, epsilon: float, place: str, *parts: str) -> str:
    p, q = randomizer.parameters(epsilon)
    return f"({uniform_cut(tag(*parts), place)} < case when {truth} then {p!r}::double else {q!r}::double end)::int"


@query("n9_unary_bits", on_orders(f"select tid, val::int as value, {_bit_sql('a3 = val', 1.5, 'val', '6', chr(39) + 'oue' + chr(39), '3', 'val // 4', 'tid')} bit from ord, range(5) t(val)"))
def _(spark, d):
    cells = _orders(spark, d).select("tid", "a3", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("value"))
    digests = randomizer.digest(6, "oue", F.floor(F.col("value") / randomizer.CUTS), 3, F.col("tid"))
    return cells.select("tid", "value", randomizer.cut_bit(digests, F.col("value"), F.col("a3") == F.col("value"), 1.5).alias("bit"))


@query("n11_membership_bits", on_orders(f"select tid, {_bit_sql('a0 = 2 and a5 = 3', 2.0, '0', '6', chr(39) + 'pair' + chr(39), '0', 'tid')} bit from ord"))
def _(spark, d):
    return _orders(spark, d).select("tid", randomizer.cut_bit(randomizer.digest(6, "pair", 0, F.col("tid")), 0, counts.matches(((0, 2), (5, 3))), 2.0).alias("bit"))


#: Observed ranks and intersection sizes at which probabilities are shown; sets of 60 and 50, 9 phantoms each, floor 2.
_SEEN, _SIZES, _SETS, _GHOSTS, _LOW = range(3, 9), (5.0, 20.0, 45.0), (60.0, 50.0), 9.0, 2.0


def _corner_sql(three: bool) -> str:
    f = lambda x: f"ln(1 - power(2.0, -greatest({x}, 1)))"
    corners = "(select * from (values (0), (1)) a(p), (values (0), (1)) b(q)" + (", (values (0), (1)) c(r)" if three else "") + ")"
    limits = ["x - p", "y - q"] + (["z - r"] if three else [])
    lowest = f"least({', '.join(limits)})"
    base = f"{_SETS[0] + _GHOSTS} * {f('x - p')} + {_SETS[1] + _GHOSTS} * {f('y - q')}" + (f" + {_GHOSTS} * {f('z - r')}" if three else "")
    term = f"{base} + s * ({f(lowest)} - {f('x - p')} - {f('y - q')})"
    legal = " and ".join(f"{x} >= {_LOW}" for x in limits)
    sign = "(case when (p + q" + (" + r" if three else "") + ") % 2 = 1 then -1 else 1 end)"
    names = "x, y" + (", z" if three else "")
    seen = "(select x, y" + (", z" if three else "") + f" from range({_SEEN[0]}, {_SEEN[-1] + 1}) a(x), range({_SEEN[0]}, {_SEEN[-1] + 1}) b(y)" + (f", range({_SEEN[0]}, {_SEEN[-1] + 1}) c(z)" if three else "") + ")"
    return f"""with t as (select {names}, s, {sign} sg, {term} v from {seen}, (values (5.0::double), (20.0), (45.0)) d(s), {corners} where {legal}), m as (select {names}, s, max(v) top from t group by all)
        select {", ".join(f"{n}::int {n}" for n in names.split(", "))}, s size, round_even(any_value(top) + ln(greatest(sum(sg * exp(v - top)), 2.2250738585072014e-308)), 5)::double log_p from t join m using ({names}, s) group by {names}, s
        having sum(sg * exp(v - top)) > 1e-9"""


def _corners(spark: SparkSession, three: bool) -> DataFrame:
    import itertools

    import numpy as np

    seen = np.array(list(itertools.product(_SEEN, repeat=3 if three else 2)), float)
    weights = np.array([_SETS[0] + _GHOSTS, _SETS[1] + _GHOSTS] + ([_GHOSTS] if three else []))
    found = sketch._differences(seen, np.full(seen.shape[1], _LOW), 1.0, lambda each: each @ weights, lambda each, common: common - each[:, :, 0] - each[:, :, 1], np.array(_SIZES))
    rows = [(*map(int, o), s, float(v)) for o, some in zip(seen, found, strict=True) for s, v in zip(_SIZES, some, strict=True) if v > -300]
    names = "x int, y int" + (", z int" if three else "")
    return spark.createDataFrame(rows, f"{names}, size double, log_p double").withColumn("log_p", _round("log_p", 5))


@query("e11_joint_probability", _corner_sql(False))
def _(spark, d):
    return _corners(spark, False)


@query("e15_nested_probability")
def _(spark, d):
    return _corners(spark, True)


@query("w4_audited_run")
def _(spark, d):
    row = protocol.run_case(_orders(spark, d), config.Config(protocol=_RUN), "MAP-S")
    return spark.createDataFrame([(k, str(v)) for k, v in row.items()], "field string, value string")


#: Budgets, splits, seeds and methods of the registered sweep.
_SWEPT = [(config.Config(protocol=config.Protocol(m=256, epsilon=e, phase1_ratio=split, seed=seed)), method) for e, split, seed in ((4.0, 0.5, SEED), (8.0, 0.3, SEED), (8.0, 0.5, SEED + 1)) for method in ("MAP-M", "IE-Other", "First-round")]


@query("w4_fused_sweep")
def _(spark, d):
    """Nine audited runs over the orders from shared scans: one histogram, a pass of sketches for each seed, one exact top."""
    rows = protocol.run_cases(_orders(spark, d), _SWEPT, dataset="orders")
    shown = [(r["method"], r["epsilon"], c.protocol.phase1_ratio, r["seed"], r["candidate_count"], r["report_keys"], *(round(float(r[x]), 9) for x in ("f1", "ncr", "rmse"))) for r, (c, _) in zip(rows, _SWEPT, strict=True)]
    return spark.createDataFrame(shown, "method string, epsilon double, phase1_ratio double, seed int, candidate_count int, report_keys int, f1 double, ncr double, rmse double")


_ENCRYPTED = on_orders("select b.t as itemset, coalesce(s.n, 0) support from best b left join sets s on s.t = b.t", *_candidate_ctes(2, 8), oracle.itemset_counts(2, "pool"))


@query("v7_encrypted_supports_match", _ENCRYPTED)
def _(spark, d):
    wide, best = _some_candidates(spark, d, 2, 8)
    some = [c.itemset for c in candidates.collect_candidates(best)]
    domain = encode.domain_map(wide)
    found, _ = circuits.circuit_mining(wide, some, partition.owner_map(PARTS), domain, 100)
    told = circuits.agreement(wide, found, 8, 2, domain)  # an error where a support isn't exact
    return _top_table(spark, found.items() if told["verified"] == len(some) else [])


@query("cr6_blinded_comparisons", "select n_nationkey, (n_nationkey > n_regionkey)::int greater from nation")
def _(spark, d):
    public, private = circuits.key_pair(256)
    compare = circuits.Comparison(public, private, 1000, 64)
    rows = read(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()  # a fixed table of 25 rows
    answers = compare.greater_all(public.encrypt_all([r["n_nationkey"] for r in rows]), [r["n_regionkey"] for r in rows])
    return spark.createDataFrame([(r["n_nationkey"], private.decrypt(x)) for r, x in zip(rows, answers, strict=True)], "n_nationkey int, greater int")


@query("cr7_border_checks", "select c as answer, i::int as owner, c = 'whole' as passed, 6 as required, (c = 'one missing')::int missing, (c = 'one too many')::int inserted from range(4) t(i), (values ('whole'), ('one missing'), ('one too many')) u(c)")
def _(spark, d):
    """What an owner says of the cloud's answer: as it is, without an itemset that is frequent, and with one that isn't."""
    rows = []
    for owner in range(CLIENTS):
        border = circuits.Border.of(owner, 3)
        good, bad, made = border.frequent, border.infrequent, border.rows * (border.threshold + 1)
        sets = {frozenset(s) for p in good | bad for n in range(1, len(p) + 1) for s in itertools.combinations(sorted(p), n)}
        whole = {s for s in sets if sum(s <= set(r) for r in made) > border.threshold}
        for answer, returned in (("whole", whole), ("one missing", whole - {min(good, key=sorted)}), ("one too many", whole | bad)):
            found = circuits.check_answer(good, bad, returned)
            rows.append((answer, owner, found["passed"], found["required"], found["missing"], found["inserted"]))
    return spark.createDataFrame(rows, "answer string, owner int, passed boolean, required int, missing int, inserted int")


@query("cr12_publication_gate", "select * from (values ('all', true), ('one missing', false), ('none', false)) t(requirements, publishable)")
def _(spark, d):
    rows = [("all", circuits.publishable({"a": True, "b": True})), ("one missing", circuits.publishable({"a": True, "b": False})), ("none", circuits.publishable({}))]
    return spark.createDataFrame(rows, "requirements string, publishable boolean")
