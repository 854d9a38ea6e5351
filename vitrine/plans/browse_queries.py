"""Browsing and searching: regions and nations stand for the category tree, customers and parts for products,
order lines for a product's ordered pictures."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.functions.sizes import envelope_text
from vitrine.functions.textclean import search_key
from vitrine.operators import browse, gram_index, ordered, reports, search
from vitrine.operators.classify import keep_same_main
from vitrine.plans.tables import ORACLES, Tables, query
from vitrine.rules import categories as C
from vitrine.session import ensure_checkpoint_dir
from vitrine.sources.feeds import unite

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
SQL_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
SHOWN = "c_acctbal > 0"


def _customers(t: Tables):
    return t.customer.withColumn("rendered", F.col("c_mktsegment") == "MACHINERY").withColumnRenamed("c_nationkey", "n_nationkey")


def _counts(t: Tables):
    return browse.category_counts(t.nation, _customers(t), "n_nationkey", SHOWN, "c_name", ["rendered", "c_name"])


SQL_COUNTS = """
select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey, count(c_custkey)::bigint as products,
       arg_min(c_name, struct_pack(r := c_mktsegment = 'MACHINERY', n := c_name)) as cover
from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 0
group by 1, 2, 3"""


@query(SQL_COUNTS)
def category_counts(t: Tables):
    return _counts(t).select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"), "products", "cover")


@query("""
select n_nationkey::bigint as n_nationkey, n_name, count(c_custkey)::bigint as products
from nation left join customer on c_nationkey = n_nationkey group by 1, 2""")
def counts_all_statuses(t: Tables):
    out = browse.category_counts(t.nation, _customers(t), "n_nationkey")
    return out.select(F.col("n_nationkey").cast("long"), "n_name", "products")


def _tree(t: Tables):
    counts = _counts(t).withColumnRenamed("n_regionkey", "r_regionkey")
    return browse.category_tree(counts, t.region, "r_regionkey", "n_nationkey")


SQL_TREE = f"""
with c as ({SQL_COUNTS})
select r_name, coalesce(sum(products), 0)::bigint as total, count(n_nationkey)::bigint as children,
       arg_min(cover, n_nationkey) filter (where cover is not null) as cover
from region left join c on c.n_regionkey = r_regionkey and products > 0 group by r_name"""


@query(SQL_TREE)
def category_tree(t: Tables):
    return _tree(t).select("r_name", "total", "children", "cover")


@query(f"""
select count(*)::bigint as spaces, sum(total)::bigint as total, sum(children)::bigint as subcategories
from ({SQL_TREE}) where total > 0""")
def catalogue_totals(t: Tables):
    return reports.catalogue_total(_tree(t))


@query("""
select r_name, n_name, c_custkey, c_name from customer
join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_acctbal > 0""")
def category_listing(t: Tables):
    leaves = t.nation.filter(F.col("n_regionkey").isNotNull())
    rows = browse.listing(_customers(t), leaves, "n_nationkey", SHOWN)
    spaces = leaves.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.join(spaces, "n_nationkey").select("r_name", "n_name", "c_custkey", "c_name")


@query("""
select n_nationkey::bigint as n_nationkey, case when r_name is null then n_name else r_name || ' › ' || n_name end as label
from nation left join region on r_regionkey = n_regionkey""")
def breadcrumbs(t: Tables):
    roots = t.region.select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    leaves = t.nation.select((F.col("n_nationkey") + 1000).alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    labelled = browse.breadcrumbs(roots.unionByName(leaves), "id", "parent", "name")
    return labelled.filter("assignable").select((F.col("id") - 1000).cast("long").alias("n_nationkey"), "label")


@query(f"""
select o_orderkey, o_orderstatus, c_mktsegment, (row_number() over (partition by o_orderkey order by {SQL_LINE_ORDER}) - 1)::bigint as position,
       l_partkey, l_quantity
from orders left join customer on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey
qualify l_partkey is not null
union all
select o_orderkey, o_orderstatus, c_mktsegment, null, null, null
from orders left join customer on c_custkey = o_custkey where o_orderkey not in (select l_orderkey from lineitem)""")
def product_detail(t: Tables):
    category = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    children = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", *LINE_ORDER)
    out = browse.detail(t.orders, [(category, "o_custkey")], children, "o_orderkey", LINE_ORDER)
    return out.select("o_orderkey", "o_orderstatus", "c_mktsegment", F.col("position").cast("long"), "l_partkey", "l_quantity")


@query("""
with s as (
  select a.p_partkey, b.p_partkey as sibling, row_number() over (partition by a.p_partkey order by b.p_name, b.p_partkey) - 1 as position
  from part a join (select *, row_number() over (partition by p_brand order by p_name, p_partkey) as r from part) b
    on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey and b.r <= 13)
select p_partkey, sibling, position::bigint as position from s where position < 12""")
def siblings_topn(t: Tables):
    out = browse.siblings(t.part, "p_brand", "p_name", "p_partkey", 12)
    return out.select("p_partkey", "sibling", F.col("position").cast("long"))


@query(f"""
select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, l_suppkey from lineitem
qualify row_number() over (partition by l_orderkey order by {SQL_LINE_ORDER}) = 1""")
def first_child(t: Tables):
    out = browse.first_child(t.lineitem, "l_orderkey", LINE_ORDER, ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey", "l_suppkey")


SQL_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substring('  ' || lower({0}) || ' ', i, 3)))"


def _sql_similarity(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"({shared} / (len({a}) + len({b}) - {shared})::double)"


@query(f"""
with k as (select *, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as key from part),
g as (select *, {SQL_GRAMS.format('key')} as kg, {SQL_GRAMS.format("'REDW'")} as qg from k),
s as (select *, {_sql_similarity('kg', 'qg')} as similarity, starts_with(key, 'REDW') as prefix from g)
select p_partkey, p_name, round(similarity, 6) as similarity, prefix from s
where p_name ilike '%red w%' or p_type ilike '%red w%' or prefix or similarity >= 0.3
order by prefix desc, s.similarity desc, p_name, p_partkey limit 60""")
def text_search(t: Tables):
    keyed = t.part.withColumn("key", search_key(F.col("p_name")))
    keyed = keyed.withColumn("code", F.concat_ws("|", "p_name", F.format_string("%012d", "p_partkey")))
    found = search.text_search(keyed, "red w", ["p_name", "p_type"], "code", "key")
    return found.select("p_partkey", "p_name", F.round("similarity", 6).alias("similarity"), "prefix")


@query(f"""
with keys as (select distinct regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as key from part),
terms as (select distinct upper(unnest(string_split(p_name, ' '))) as term from part),
s as (select term, key, {_sql_similarity(SQL_GRAMS.format('key'), SQL_GRAMS.format('term'))} as similarity from terms, keys)
select term, key, round(similarity, 6) as similarity, row_number() over (partition by term order by s.similarity desc, key)::bigint as rank
from s where s.similarity >= 0.3 qualify rank <= 60""")
def trigram_match(t: Tables):
    items = t.part.select(search_key(F.col("p_name")).alias("key"))
    terms = t.part.select(F.explode(F.split(F.upper("p_name"), " ")).alias("term"))
    best = search.best_matches(search.trigram_matches(items, terms, "key", "term"), "term", "key")
    return best.select("term", "key", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long"))


def _gram_index(t: Tables):
    """Index of all parts, as the first import and a later one leave it."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/gram-index-{uuid.uuid4().hex}"
    keyed = t.part.withColumn("key", search_key(F.col("p_name"))).withColumn("code", F.concat_ws("|", "p_name", F.format_string("%012d", "p_partkey")))
    for late in (False, True):
        gram_index.write_index(keyed.filter((F.col("p_size") > 40) == late), "p_partkey", "key", ["p_name", "p_type", "code"], folder)
    return folder, keyed


@query(ORACLES["text_search"])
def indexed_text_search(t: Tables):
    """The rows of text_search, from the lists of its trigrams."""
    folder, keyed = _gram_index(t)
    found = gram_index.indexed_text_search(folder, keyed, "p_partkey", "red w", ["p_name", "p_type"], "code", "key")
    return found.select("p_partkey", "p_name", F.round("similarity", 6).alias("similarity"), "prefix")


@query(ORACLES["trigram_match"])
def indexed_trigram_match(t: Tables):
    """The rows of trigram_match, from the lists of the terms' rarest trigrams."""
    folder, keyed = _gram_index(t)
    terms = t.part.select(F.explode(F.split(F.upper("p_name"), " ")).alias("term"))
    best = search.best_matches(gram_index.indexed_matches(t.spark, folder, keyed, "p_partkey", "key", terms, "term"), "term", "key")
    return best.select("term", "key", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long"))


@query("""
select p_type as material, count(*)::bigint as n, arg_min(p_name, struct_pack(a := p_size > 25, b := p_name, c := p_partkey)) as cover
from part where p_type is not null group by p_type""")
def material_counts(t: Tables):
    rows = t.part.filter(F.col("p_type").isNotNull()).withColumn("rendered", F.col("p_size") > 25)
    cover = F.min_by("p_name", F.struct("rendered", "p_name", "p_partkey"))
    return rows.groupBy(F.col("p_type").alias("material")).agg(F.count(F.lit(1)).alias("n"), cover.alias("cover"))


@query("select p_brand, p_type, count(*)::bigint as n from part group by 1, 2")
def material_by_category(t: Tables):
    return browse.grouped_counts(t.part, ["p_brand", "p_type"])


@query("""
select user_id from events group by user_id
having bool_or(event_type = 'view') and bool_or(event_type = 'purchase') and bool_or(event_type = 'signup')""")
def facet_and(t: Tables):
    return browse.owners_with_all(t.events, "user_id", "event_type", ["view", "purchase", "signup"])


SIZE_BANDS = [("< 10", 0, 9), ("10-20", 10, 20), ("21-30", 21, 30), ("31-40", 31, 40), ("> 40", 41, 1_000_000)]
SQL_BAND = ("case when p_size between 0 and 9 then '< 10' when p_size between 10 and 20 then '10-20' when p_size between 21 and 30 "
            "then '21-30' when p_size between 31 and 40 then '31-40' when p_size between 41 and 1000000 then '> 40' end")


@query(f"select {SQL_BAND} as band, p_type, count(*)::bigint as n from part group by 1, 2")
def facet_bands(t: Tables):
    banded = t.part.withColumn("band", browse.band_of(F.col("p_size"), SIZE_BANDS))
    return browse.grouped_counts(banded, ["band", "p_type"])


WORDS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]


@query("""
with d(position, value) as (values (0, 'anvil'), (1, 'bolt'), (2, 'gear'), (3, 'gizmo'), (4, 'plate'), (5, 'ring'), (6, 'rod'), (7, 'widget'))
select value, d.position::bigint as position, count(*)::bigint as n from d
join (select unnest(string_split(p_name, ' ')) as value from part) using (value) group by 1, 2""")
def facet_counts(t: Tables):
    out = browse.facet_presence(t.part.withColumn("values", F.split("p_name", " ")), "values", WORDS)
    return out.select("value", F.col("position").cast("long"), "n")


@query("""
select p_partkey, p_name, p_size::bigint as p_size, (select count(*) from part where p_name ilike '%ring%' and p_size >= 10)::bigint as total,
       greatest(1, ceil((select count(*) from part where p_name ilike '%ring%' and p_size >= 10) / 50.0))::bigint as pages
from part where p_name ilike '%ring%' and p_size >= 10 order by p_size desc, p_name, p_partkey limit 50 offset 50""")
def filtered_page(t: Tables):
    conditions = [F.ilike(F.col("p_name"), F.lit("%ring%")), F.col("p_size") >= 10]
    order = [*browse.facet_order("width-desc", "p_name", "p_size"), "p_partkey"]
    out = browse.filtered_page(t.part, conditions, order, page=2)
    return out.select("p_partkey", "p_name", F.col("p_size").cast("long"), "total", "pages")


@query("select p_partkey, lead(p_partkey) over (order by p_name, p_partkey) as next_key from part")
def keyset_next(t: Tables):
    out = ordered.with_neighbours(t.part.select("p_name", "p_partkey"), [], ["p_name", "p_partkey"], F.col("p_partkey"), prev=None, next="next_key")
    return out.select("p_partkey", "next_key")


@query("""
select p_name, p_partkey from part where (p_name, p_partkey) > ('hot ring', 100) order by p_name, p_partkey limit 1""")
def keyset_after(t: Tables):
    return browse.keyset_next(t.part, ["p_name", "p_partkey"], ["hot ring", 100], ["p_name", "p_partkey"])


@query("select p_partkey from part order by p_partkey limit 24")
def slug_sample(t: Tables):
    return browse.slug_sample(t.part.select("p_partkey"), ["p_partkey"])


@query("select o_orderstatus, count(*)::bigint as n from orders group by 1")
def status_counts(t: Tables):
    return browse.grouped_counts(t.orders, ["o_orderstatus"])


def flagged_documents(t: Tables):
    """Documents with warning flags from their labels and length; English ones count as checked by a person."""
    rows = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")
    flag_set = F.array_compact(F.array(
        F.when(F.col("quality").isNull(), "no-category"), F.when(F.col("quality") == 0, "dims-suspect"),
        F.when(F.col("toxic") == 1, "no-image"), F.when(F.col("n_chars") < 500, "no-dimensions"),
        F.when(F.col("source") == "src0", "ocr-import")))
    return rows.withColumn("flags", flag_set).withColumn("edited_at", F.when(F.col("lang") == "en", F.lit("2024-01-01").cast("timestamp")))


SQL_FLAGGED = """
flagged as (
  select doc_id, lang, source, n_chars, lang = 'en' as edited, list_filter([
    case when quality is null then 'no-category' end, case when quality = 0 then 'dims-suspect' end,
    case when toxic = 1 then 'no-image' end, case when n_chars < 500 then 'no-dimensions' end,
    case when source = 'src0' then 'ocr-import' end], lambda x: x is not null) as flags
  from documents left join labels using (doc_id)),
counted as (select flag, count(*)::bigint as total, count(*) filter (where not edited)::bigint as open
  from (select edited, unnest(flags) as flag from flagged) group by flag)"""


@query(f"with {SQL_FLAGGED} select * from counted")
def flag_counts(t: Tables):
    return browse.flag_counts(flagged_documents(t), "flags", "edited_at")


@query(f"""
with {SQL_FLAGGED}, known(flag, position) as (values ('category-guessed', 1), ('no-category', 2), ('no-image', 3), ('no-code', 4),
  ('dims-suspect', 5), ('category-from-code', 6), ('no-dimensions', 7), ('dims-fixed', 8), ('ocr-import', 9), ('image-from-render', 10))
select flag, total, open, position::bigint as position,
  case when flag in ('ocr-import', 'image-from-render') then 0 else open end::bigint as counted_open
from counted join known using (flag) where total > 0""")
def review_queue(t: Tables):
    counts = browse.flag_counts(flagged_documents(t), "flags", "edited_at")
    out = browse.review_queue(counts, C.FLAG_ORDER, C.INFORMATIONAL_FLAGS)
    return out.select("flag", "total", "open", F.col("position").cast("long"), "counted_open")


def _sql_cm(x: str) -> str:
    return f"regexp_replace(format('{{:,.1f}}', {x} / 10.0), '\\.0$', '')"


def _sql_span(lo: str, hi: str, axis: str) -> str:
    return f"case when {hi} <> 0 then case when {lo} <> {hi} then {_sql_cm(lo)} || '–' else '' end || {_sql_cm(hi)} || '{axis}' end"


@query(f"""
with e as (
  select l_orderkey, (min(l_quantity) * 100)::bigint as w0, (max(l_quantity) * 100)::bigint as w1, min(l_linenumber)::bigint * 105 as d0,
         max(l_linenumber)::bigint * 105 as d1, floor(min(l_extendedprice) / 10)::bigint as h0, floor(max(l_extendedprice) / 10)::bigint as h1
  from lineitem group by l_orderkey)
select l_orderkey, concat_ws(' x ', {_sql_span('w0', 'w1', 'W')}, {_sql_span('d0', 'd1', 'D')}, {_sql_span('h0', 'h1', 'H')}) || ' cm' as size_text
from e""")
def size_text(t: Tables):
    mm = lambda c: c.cast("long")
    env = t.lineitem.groupBy("l_orderkey").agg(
        mm(F.min("l_quantity") * 100).alias("w0"), mm(F.max("l_quantity") * 100).alias("w1"),
        mm(F.min("l_linenumber") * 105).alias("d0"), mm(F.max("l_linenumber") * 105).alias("d1"),
        mm(F.floor(F.min("l_extendedprice") / 10)).alias("h0"), mm(F.floor(F.max("l_extendedprice") / 10)).alias("h1"))
    text = envelope_text(*[F.col(c) for c in ("w0", "w1", "d0", "d1", "h0", "h1")])
    return env.select("l_orderkey", text.alias("size_text"))


@query("""
select p_partkey, lag(p_partkey) over w as prev_key, lead(p_partkey) over w as next_key
from part window w as (partition by p_brand order by p_name, p_partkey)""")
def neighbours(t: Tables):
    out = ordered.with_neighbours(t.part.select("p_brand", "p_name", "p_partkey"), ["p_brand"], ["p_name", "p_partkey"],
                                  F.col("p_partkey"), "prev_key", "next_key")
    return out.select("p_partkey", "prev_key", "next_key")


SQL_RANGE = ("case when p_name like '%ring' then 'A-1' when p_name like '%rod' then 'A-2' when p_name like '%bolt' then 'B-1' "
             "when p_name like '%gear' then 'B-2' end")


def _ranged(t: Tables):
    noun = F.element_at(F.split("p_name", " "), -1)
    code = F.when(noun == "ring", "A-1").when(noun == "rod", "A-2").when(noun == "bolt", "B-1").when(noun == "gear", "B-2")
    also = F.when(F.col("p_size") > 40, F.array(F.lit("A-2"), F.lit("B-2"))).when(F.col("p_size") > 30, F.array(F.lit("A-1"))).otherwise(F.array().cast("array<string>"))
    return t.part.withColumn("range", code).filter(F.col("range").isNotNull()).withColumn("also", also)


@query(f"""
with items as (select p_partkey, p_name, p_size, {SQL_RANGE} as range,
  case when p_size > 40 then ['A-2', 'B-2'] when p_size > 30 then ['A-1'] else [] end as also from part),
listed as (select range as page_range, p_partkey, true as own from items where range is not null
  union all select unnest(list_filter(also, lambda a: a <> range and a[1] = range[1])), p_partkey, false from items where range is not null)
select page_range, p_partkey, own, row_number() over (partition by page_range, own order by p_partkey)::bigint as position from listed""")
def catalogue_order(t: Tables):
    main_of = {"A-1": "A", "A-2": "A", "B-1": "B", "B-2": "B"}
    items = _ranged(t).withColumn("also", keep_same_main(F.col("range"), F.col("also"), main_of))
    listed = browse.own_and_cross_listed(items, "range", "also").select("page_range", "p_partkey", "own")
    return ordered.number_rows(listed, ["page_range", "own"], ["p_partkey"], "position")


@query(f"""
with tax(range, main) as (values ('A-1', 'A'), ('A-2', 'A'), ('B-1', 'B'), ('B-2', 'B'), ('C-1', 'C')),
items as (select p_partkey, p_brand, p_size, {SQL_RANGE} as range from part)
select main, count(p_partkey)::bigint as n, arg_min(p_brand, struct_pack(a := tax.range, b := p_partkey)) filter (where p_size > 10 and p_partkey is not null) as cover
from tax left join items on items.range = tax.range group by main""")
def contents_tiles(t: Tables):
    taxonomy = t.spark.createDataFrame([("A-1", "A"), ("A-2", "A"), ("B-1", "B"), ("B-2", "B"), ("C-1", "C")], "range string, main string")
    items = _ranged(t).withColumn("thumb", F.when(F.col("p_size") > 10, F.col("p_brand")))
    return browse.contents_tiles(items, taxonomy, "range", "main", "thumb", ["range", "p_partkey"])


@query("""
select s_suppkey, case when n_name is null then s_name else n_name || ' · ' || s_name end as label from supplier left join nation on n_nationkey = s_nationkey""")
def listing_entry(t: Tables):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("s_suppkey", browse.entry_label(F.col("n_name"), F.col("s_name"), F.col("n_name") == F.col("s_name")).alias("label"))


@query("""
select n_regionkey::bigint as n_regionkey, c_mktsegment, min(c_custkey)::bigint as position, count(*)::bigint as ranges
from customer join nation on n_nationkey = c_nationkey group by 1, 2""")
def range_groups(t: Tables):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = browse.group_ranges(joined, "n_regionkey", "c_mktsegment", "c_custkey")
    return out.select(F.col("n_regionkey").cast("long"), "c_mktsegment", "position", "ranges")


@query("""
select page_id, case when url like 'http%' then 'web' else 'sheet' end as kind, replace(url, 'http://', 'https://') as href
from pages where url like 'http%'
union all select page_id, 'sheet', null from pages where url not like 'http%'""")
def source_links(t: Tables):
    link = browse.source_link(F.col("url"), F.lit(1))
    return t.pages.select("page_id", link["kind"].alias("kind"), F.regexp_replace(link["href"], "http://", "https://").alias("href"))


@query("""
with e as (
  select 'orders' as feed, o_orderkey as id, o_custkey as owner, o_orderstatus as label from orders
  union all select 'parts', p_partkey, null, p_name from part)
select feed, coalesce(n_name, '—') as category, id, label, case when feed = 'parts' then length(label) end::bigint as extra
from e left join customer on c_custkey = owner left join nation on n_nationkey = c_nationkey""")
def nested_export(t: Tables):
    """Feeds united with a fixed feed order, placed in their category; one row per product, not one nested document."""
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("label"))
    parts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.length("p_name").cast("long").alias("extra"))
    feeds = unite([("orders", orders), ("parts", parts)])
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("owner"), "n_name")
    return feeds.join(places, "owner", "left").select("feed", F.coalesce("n_name", F.lit("—")).alias("category"), "id", "label", "extra")



# Customers as products of an editor's list: segments are brands, regions with their nations the category tree, orders the pictures.
def _editor_tables(t: Tables):
    key = F.col("c_custkey")
    flags = F.array_compact(F.array(F.when(F.col("c_acctbal") < 2000, "no-dimensions"), F.when(key % 3 == 0, "ocr-import")))
    products = t.customer.select(
        key.alias("id"), F.concat(F.lit("s"), key).alias("slug"), F.col("c_mktsegment").alias("brand_id"), F.col("c_nationkey").alias("category_id"),
        F.col("c_name").alias("code"), F.col("c_mktsegment").alias("type_th"), F.lower("c_name").alias("type_en"), F.when(F.col("c_acctbal") > 0, "published").otherwise("review").alias("status"),
        flags.alias("flags"), F.when(key % 5 == 0, F.timestamp_seconds(key)).alias("edited_at"), F.timestamp_seconds(F.lit(1_700_000_000) + key * 7919 % 400).alias("updated_at"))
    brands = t.customer.select(F.col("c_mktsegment").alias("id"), F.lower("c_mktsegment").alias("slug"), F.col("c_mktsegment").alias("name")).distinct()
    region = t.region.select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.lower("r_name").alias("slug"), F.col("r_name").alias("name_th"))
    nation = t.nation.select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("parent_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name_th"))
    images = t.orders.select(F.col("o_custkey").alias("product_id"), F.col("o_orderkey").cast("string").alias("thumb_url"), F.col("o_orderdate").alias("sort"))
    return products, brands, region.unionByName(nation), images


_SQL_EDITOR = """
with p as (select c_custkey as id, 's' || c_custkey as slug, c_name as code, c_mktsegment as type_th, case when c_acctbal > 0 then 'published' else 'review' end as status,
  list_filter([case when c_acctbal < 2000 then 'no-dimensions' end, case when c_custkey % 3 = 0 then 'ocr-import' end], lambda x: x is not null) as flags,
  case when c_custkey % 5 = 0 then c_custkey end as edited, 1700000000 + c_custkey * 7919 % 400 as updated, c_mktsegment as brand, n_name as category, r_name
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
f as (select * from p where {where}),
i as (select o_custkey, arg_min(o_orderkey::varchar, struct_pack(a := o_orderdate, b := o_orderkey::varchar)) as thumb from orders group by 1)
select slug, code, type_th, status, array_to_string(flags, ',') as flags, edited, updated, brand, category, thumb,
  (select count(*) from f)::bigint as total, greatest(1, ceil((select count(*) from f) / {size}.0))::bigint as pages
from f left join i on o_custkey = id order by {order} limit {size} offset {offset}"""


def _shown(found):
    at = lambda c: F.unix_seconds(c).alias(c.removesuffix("_at"))
    return found.select("slug", "code", "type_th", "status", F.array_join("flags", ",").alias("flags"), at("edited_at"), at("updated_at"), "brand", "category", "thumb", "total", "pages")


@query(_SQL_EDITOR.format(where="r_name = 'ASIA' and list_contains(flags, 'ocr-import') and edited is null and status = 'published'", order="updated desc, slug", size=10, offset=10))
def admin_list_updated(t: Tables):
    """Second page of the unchecked products of a category tree with a flag, latest first."""
    wanted = browse.ListFilter(status="published", category="asia", flag="ocr-import", open=True, page=2, sort="updated")
    return _shown(browse.admin_list(*_editor_tables(t), wanted, size=10))


@query(_SQL_EDITOR.format(where="brand = 'MACHINERY' and (code ilike '%er#%1%' or type_th ilike '%er#%1%' or lower(code) ilike '%er#%1%')", order="code, slug", size=10, offset=0))
def admin_list_brand(t: Tables):
    """First page of a brand's products whose code or type has a pattern, by code."""
    return _shown(browse.admin_list(*_editor_tables(t), browse.ListFilter(brand="machinery", q="er#%1"), size=10))


@query("""
select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, count(*) over ()::bigint as total, greatest(1, ceil(count(*) over () / 50.0))::bigint as pages from
  (select *, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as r from lineitem where l_discount < 0.09)
qualify r > (select count(*) * 9 // 10 from lineitem where l_discount < 0.09) // 50 * 50 order by r limit 50""")
def deep_page(t: Tables):
    """A page nine tenths down all order lines, most expensive first, located by ranges."""
    rows = t.lineitem.filter(F.col("l_discount") < 0.09).withColumn("id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    out = browse.filtered_page(rows, [], order, page=rows.count() * 9 // 10 // 50 + 1, key="id")
    return out.select("l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey", "total", "pages")
