"""Duplicates, identifiers, merging and audits. Snapshots are derived from the tables: customers with a
negative balance stand for rows a person edited, market segments for what an import brings."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.functions import textclean
from vitrine.operators import identity, merge
from vitrine.operators.ordered import number_rows
from vitrine.plans.browse_queries import LINE_ORDER, SQL_LINE_ORDER
from vitrine.plans.tables import Tables, query

NOW = "2024-06-01"
EDITED = "2024-01-01"

# ---------------------------------------------------------------- duplicates and identifiers

SQL_LINEAGE = r"""
keyed as (select p_partkey, p_brand, p_brand = 'Brand#1' as alone, regexp_replace(upper(p_name), '[\s\-_/.]+', '', 'g') as key, p_type from part),
firsts as (select *, min(p_partkey) over (partition by key, p_type) as first_key from keyed),
lineage as (select p_partkey, p_brand, max(case when alone or p_partkey = first_key then p_partkey end) over (partition by key, p_type order by p_partkey rows unbounded preceding) as keeper from firsts)"""


def _lineage(t: Tables):
    rows = t.part.select("p_partkey", "p_brand", "p_type", textclean.dedupe_key(F.col("p_name")).alias("key"))
    return identity.dedupe_lineage(rows, ["key", "p_type"], "p_partkey", F.col("p_brand") == "Brand#1")


@query(f"with {SQL_LINEAGE} select p_partkey, keeper from lineage")
def dedupe_lineage(t: Tables):
    return _lineage(t).select("p_partkey", "keeper")


@query(f"""
with {SQL_LINEAGE} select l.keeper, (count(*) - 1)::bigint as also_sources, count(*) filter (where l.p_brand <> k.p_brand)::bigint as also_brands
from lineage l join part k on k.p_partkey = l.keeper group by l.keeper""")
def dedupe_summary(t: Tables):
    return identity.keepers_with_counts(_lineage(t), "p_partkey", "p_brand")


@query(r"""
with b as (select p_partkey, trim(lower(regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9]+', '-', 'g')), '-') as base from part),
n as (select *, row_number() over (partition by base order by p_partkey) as n from b)
select p_partkey, case when n = 1 then base else base || '-' || n end as slug from n""")
def slug_numbering(t: Tables):
    rows = t.part.select("p_partkey", textclean.slugify(F.concat_ws(" ", "p_brand", "p_name")).alias("base"))
    return identity.number_slugs(rows, "base", ["p_partkey"]).select("p_partkey", "slug")


@query("""
with items as (select p_partkey::varchar as slug, p_type as range, p_name, p_partkey from part),
seen as (select p_partkey, case when p_brand = 'Brand#3' then 'PROMO' else p_type end as range from part where p_size < 25),
reg as (select p_partkey::varchar as slug, range || '-' || lpad(n::varchar, greatest(2, length(n::varchar))::int, '0') as code, range, n
  from (select *, row_number() over (partition by range order by p_partkey) as n from seen)),
used as (select range, max(n) as used from reg group by range),
joined as (select items.*, reg.code as old, reg.range as old_range from items left join reg using (slug)),
fresh as (select *, row_number() over (partition by range order by p_name, p_partkey) as n from joined where old is null or old_range <> range)
select slug, old as cat_code from joined where old is not null and old_range = range
union all select slug, range || '-' || lpad((coalesce(used, 0) + n)::varchar, greatest(2, length((coalesce(used, 0) + n)::varchar))::int, '0') from fresh left join used using (range)""")
def stable_codes(t: Tables):
    items = t.part.select(F.col("p_partkey").cast("string").alias("slug"), F.col("p_type").alias("range"), "p_name", "p_partkey")
    seen = t.part.filter(F.col("p_size") < 25).withColumn("range", F.when(F.col("p_brand") == "Brand#3", "PROMO").otherwise(F.col("p_type")))
    numbered = number_rows(seen, ["range"], ["p_partkey"], "n")
    padded = F.when(F.col("n") < 10, F.concat(F.lit("0"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string"))
    registry = numbered.select(F.col("p_partkey").cast("string").alias("slug"), F.concat_ws("-", "range", padded).alias("code"))
    out, _ = identity.assign_codes(items, registry, ["p_name", "p_partkey"])
    return out.select("slug", "cat_code")


@query("""
with lines as (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents),
d as (select line, count(distinct doc_id)::bigint as files from lines where line <> '' group by line) select * from d where files >= 4""")
def doc_frequency(t: Tables):
    lines = t.documents.select("doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line") != "")
    return identity.decorations(lines, "line", "doc_id", 4)


@query("""
with lines as (select source, unnest(string_split(text, chr(10))) as line from documents),
v as (select source, line, count(*)::bigint as votes from lines where line <> '' group by 1, 2),
s as (select line, count(*)::bigint as folders from v group by 1)
select source, line, folders, votes from v join s using (line)
qualify row_number() over (partition by source order by folders, -votes, line) = 1""")
def folder_vote(t: Tables):
    lines = t.documents.select("source", "text").select("source", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line") != "")
    return identity.vote_per_folder(lines, "source", "line")


@query("""
with bits as (select vec_id, label, list_transform(embedding::double[], lambda x: x > list_sum(embedding::double[]) / len(embedding)) as b from embeddings),
k1 as (select label, arg_min(vec_id, vec_id) as id1, arg_min(b, vec_id) as b1 from bits group by label),
c2 as (select bits.*, id1, b1 from bits join k1 using (label) where vec_id > id1 and len(list_filter(range(1, len(b) + 1), lambda i: b[i] <> b1[i])) >= len(b) * 0.1),
k2 as (select label, arg_min(vec_id, vec_id) as id2, arg_min(b, vec_id) as b2 from c2 group by label),
c3 as (select c2.*, id2 from c2 join k2 using (label) where vec_id > id2 and len(list_filter(range(1, len(b) + 1), lambda i: b[i] <> b2[i])) >= len(b) * 0.1)
select label::bigint as label, 0::bigint as position, id1 as vec_id from k1 union all select label, 1, id2 from k2 union all select label, 2, min(vec_id) from c3 group by label""")
def near_duplicate(t: Tables):
    out = identity.distinct_fingerprints(t.dealt("embeddings", "vec_id"), "label", "vec_id", "embedding")
    return out.select(F.col("label").cast("long"), F.col("position").cast("long"), "vec_id")


@query("""
with found as (select page_id * 2 as ordinal, url from pages union all select page_id * 2 + 1, string_split(url, '?')[1] || '?pg=2' from pages),
c as (select string_split(url, '?')[1] as canonical, arg_min(url, ordinal) as url from found group by 1)
select canonical, url from c where canonical not in (select string_split(url, '?')[1] from pages where url like '%.org/%')""")
def url_dedupe(t: Tables):
    copies = t.pages.select((F.col("page_id") * 2 + 1).alias("ordinal"), F.concat(textclean.canonical_url(F.col("url")), F.lit("?pg=2")).alias("url"))
    found = t.pages.select((F.col("page_id") * 2).alias("ordinal"), "url").unionByName(copies)
    done = t.pages.filter(F.col("url").contains(".org/")).select("url")
    return identity.crawl_frontier(found, done, "url", "ordinal").select("canonical", "url")


@query("""
select page_id, substring(sha1(url), 1, 16) || coalesce(nullif(regexp_extract(url, '(?i)\\.(jpe?g|png|webp)'), ''), '.jpg') as name from pages""")
def media_names(t: Tables):
    return t.pages.select("page_id", textclean.media_name(F.col("url")).alias("name"))


@query("""
select doc_id from documents where doc_id not in (select doc_id from labels)""")
def missing_results(t: Tables):
    return identity.missing_only(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query(r"""
with e as (select trim(lower(regexp_replace(p_brand || ' ' || p_name || ' ' || p_size, '[^A-Za-z0-9]+', '-', 'g')), '-') as slug from part),
n as (select s_suppkey, 'brand-' || s_nationkey || '-' || (case when s_acctbal > 5000 then 'red-bolt-1' else 'blue' end) as base from supplier),
b as (select distinct base from n),
taken as (select base, count(slug) as taken, coalesce(bool_or(slug = base), false) as exact from b left join e on starts_with(slug, base) group by base),
used as (select base, max(try_cast(substr(slug, length(base) + 2) as bigint)) as highest from b join (select slug from e union all select base from b) on starts_with(slug, base || '-')
  and regexp_full_match(substr(slug, length(base) + 2), '[0-9]{1,15}') group by base),
numbered as (select *, row_number() over (partition by base order by s_suppkey) as nth from n)
select s_suppkey, case when nth = 1 and not exact then base else base || '-' || (greatest(taken, coalesce(highest, 0)) + nth) end as slug
from numbered join taken using (base) left join used using (base)""")
def new_rows(t: Tables):
    existing = t.part.select(textclean.slugify(F.concat_ws(" ", "p_brand", "p_name", "p_size")).alias("slug"))
    base = F.concat(F.lit("brand-"), F.col("s_nationkey"), F.lit("-"), F.when(F.col("s_acctbal") > 5000, "red-bolt-1").otherwise("blue"))
    rows = t.supplier.select("s_suppkey", base.alias("base"))
    return identity.free_slugs(rows, existing, "base", ["s_suppkey"]).select("s_suppkey", "slug")


# ---------------------------------------------------------------- merging


def _snapshot(t: Tables):
    edited = F.when(F.col("c_acctbal") < 0, F.lit(EDITED).cast("timestamp"))
    rows = t.customer.filter(F.col("c_mktsegment") != "BUILDING")
    return rows.select("c_custkey", "c_name", "c_acctbal", edited.alias("edited_at"), F.lit(None).cast("timestamp").alias("updated_at"))


def _import(t: Tables):
    rows = t.customer.filter(F.col("c_mktsegment") != "MACHINERY")
    return rows.select("c_custkey", F.upper("c_name").alias("c_name"), F.round(F.col("c_acctbal") * 2, 2).alias("c_acctbal"))


SQL_SIDES = """
old as (select c_custkey, c_name, c_acctbal, c_acctbal < 0 as locked from customer where c_mktsegment <> 'BUILDING'),
new as (select c_custkey, upper(c_name) as c_name, round(c_acctbal * 2, 2) as c_acctbal from customer where c_mktsegment <> 'MACHINERY')"""


@query(f"""
with {SQL_SIDES}
select c_custkey, case when new.c_custkey is not null and not coalesce(locked, false) then new.c_name else old.c_name end as c_name,
  case when new.c_custkey is not null and not coalesce(locked, false) then new.c_acctbal else old.c_acctbal end as c_acctbal,
  case when old.c_custkey is null then 'inserted' when new.c_custkey is not null and locked then 'kept' when new.c_custkey is not null then 'updated'
       when locked then 'untouched' else 'removed' end as action
from old full join new using (c_custkey)""")
def guarded_upsert(t: Tables):
    out = merge.guarded_upsert(_snapshot(t), _import(t), ["c_custkey"], stamp="updated_at", now=F.lit(NOW).cast("timestamp"), drop_stale=True)
    return out.select("c_custkey", "c_name", "c_acctbal", "action")


@query(f"""
with {SQL_SIDES}
select case when old.c_custkey is null then 'inserted' when new.c_custkey is not null and locked then 'kept' when new.c_custkey is not null then 'updated'
       when locked then 'untouched' else 'removed' end as action, count(*)::bigint as rows from old full join new using (c_custkey) group by 1""")
def load_metrics(t: Tables):
    return merge.load_metrics(merge.guarded_upsert(_snapshot(t), _import(t), ["c_custkey"], drop_stale=True))


@query(f"""
with {SQL_SIDES} select c_custkey, coalesce(new.c_name, old.c_name) as name_all, coalesce(old.c_name, new.c_name) as name_kept from old full join new using (c_custkey)""")
def plain_upserts(t: Tables):
    old, new = _snapshot(t).select("c_custkey", "c_name"), _import(t).select("c_custkey", "c_name")
    every = merge.upsert(old, new, ["c_custkey"]).withColumnRenamed("c_name", "name_all")
    kept = merge.insert_only(old, new, ["c_custkey"]).withColumnRenamed("c_name", "name_kept")
    return every.join(kept, "c_custkey")


@query(f"with {SQL_SIDES} select c_custkey from old where not locked and c_custkey not in (select c_custkey from new)")
def stale_delete(t: Tables):
    return merge.stale_rows(_snapshot(t), _import(t), ["c_custkey"]).select("c_custkey")


@query("""
with old as (select l_orderkey as parent, l_partkey as url, max(l_suppkey) as vector from lineitem where l_returnflag <> 'A' group by 1, 2),
new as (select distinct l_orderkey as parent, l_partkey as url from lineitem where l_returnflag <> 'R'),
touched as (select o_orderkey as parent from orders where o_orderstatus <> 'P')
select parent, url, vector from old where parent not in (select parent from touched)
union all select new.parent, new.url, old.vector from new semi join touched using (parent) left join old using (parent, url)""")
def child_carry_over(t: Tables):
    parts = t.lineitem.withColumnsRenamed({"l_orderkey": "parent", "l_partkey": "url"})
    old = parts.filter(F.col("l_returnflag") != "A").groupBy("parent", "url").agg(F.max("l_suppkey").alias("vector"))
    touched = t.orders.filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("parent"))
    new = parts.filter(F.col("l_returnflag") != "R").select("parent", "url").distinct().join(touched, "parent", "left_semi")
    return merge.replace_children(old, new.withColumn("vector", F.lit(None).cast("long")), touched, "parent", "url", "vector")


@query("""
select c_custkey, case when c_acctbal >= 0 then case when c_acctbal > 5000 then 'high' else 'low' end else c_mktsegment end as c_mktsegment from customer""")
def derived_refresh(t: Tables):
    rows = t.customer.withColumn("edited_at", F.when(F.col("c_acctbal") < 0, F.lit(EDITED).cast("timestamp")))
    out = merge.refresh_derived(rows, "c_mktsegment", F.when(F.col("c_acctbal") > 5000, "high").otherwise("low"))
    return out.select("c_custkey", "c_mktsegment")


@query("""
with edits as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'publish' when '2-HIGH' then 'hide' when '3-MEDIUM' then 'category' else 'checked' end as op,
  case when o_totalprice > 250000 then o_custkey end as cat from orders where o_orderpriority <> '5-LOW')
select o_orderkey, case op when 'publish' then 'published' when 'hide' then 'hidden' else o_orderstatus end as status,
  case when op = 'category' then cat else 0 end::bigint as category, op is not null as edited
from orders left join (select * from edits where op <> 'category' or cat is not null) using (o_orderkey)""")
def bulk_edit(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).cast("long").alias("category"), F.lit(None).cast("timestamp").alias("edited_at"))
    op = F.when(F.col("o_orderpriority") == "1-URGENT", "publish").when(F.col("o_orderpriority") == "2-HIGH", "hide").when(
        F.col("o_orderpriority") == "3-MEDIUM", "category").otherwise("checked")
    edits = t.orders.filter(F.col("o_orderpriority") != "5-LOW").select("o_orderkey", op.alias("op"), F.when(F.col("o_totalprice") > 250000, F.col("o_custkey")).alias("category_id"))
    out = merge.bulk_edit(rows, edits, "o_orderkey", "status", "category", "edited_at", F.lit(NOW).cast("timestamp"))
    return out.select("o_orderkey", "status", "category", F.col("edited_at").isNotNull().alias("edited"))


@query("""
with edits as (select l_orderkey as o_orderkey, l_linenumber as edit_no, case when l_returnflag = 'R' then 'hide' when l_returnflag = 'A' then 'publish' else 'category' end as op,
  case when l_quantity > 5 then l_suppkey end as cat from lineitem),
s as (select o_orderkey, (max(struct_pack(a := edit_no, v := op))).v as op from edits where op <> 'category' group by 1),
c as (select o_orderkey, (max(struct_pack(a := edit_no, v := cat))).v as cat from edits where op = 'category' and cat is not null group by 1)
select o_orderkey, case op when 'publish' then 'published' when 'hide' then 'hidden' else o_orderstatus end as status, coalesce(cat, 0)::bigint as category,
  op is not null or cat is not null as edited from orders left join s using (o_orderkey) left join c using (o_orderkey)""")
def repeated_edits(t: Tables):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).cast("long").alias("category"), F.lit(None).cast("timestamp").alias("edited_at"))
    op = F.when(F.col("l_returnflag") == "R", "hide").when(F.col("l_returnflag") == "A", "publish").otherwise("category")
    edits = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), op.alias("op"), F.col("l_linenumber").alias("at"),
                              F.when(F.col("l_quantity") > 5, F.col("l_suppkey")).alias("category_id"))
    out = merge.bulk_edit(rows, edits, "o_orderkey", "status", "category", "edited_at", F.lit(NOW).cast("timestamp"), order="at")
    return out.select("o_orderkey", "status", "category", F.col("edited_at").isNotNull().alias("edited"))


@query("""
select l_suppkey, count(*)::bigint as rows from lineitem group by 1 having count(*) > 1""")
def repeated_import_keys(t: Tables):
    return merge.repeated_keys(t.lineitem.select("l_suppkey", "l_partkey"), ["l_suppkey"])


@query(f"""
select s_suppkey, s_name, s_suppkey in (select l_suppkey from lineitem where l_returnflag = 'R' and l_linenumber = 1) or s_acctbal < 0 as edited from supplier""")
def stamped_products(t: Tables):
    pictures = t.lineitem.select(F.col("l_suppkey").alias("product_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").alias("picture"))
    changed = pictures.filter("picture.l_returnflag = 'R' and picture.l_linenumber = 1")
    products = t.supplier.select("s_suppkey", "s_name", F.when(F.col("s_acctbal") < 0, F.lit(EDITED).cast("timestamp")).alias("edited_at"))
    out = merge.stamp_touched(products, pictures, changed, "product_id", "picture", "s_suppkey", "edited_at", F.lit(NOW).cast("timestamp"))
    return out.select("s_suppkey", "s_name", F.col("edited_at").isNotNull().alias("edited"))


@query(f"""
select l_orderkey, l_partkey, l_suppkey, l_extendedprice, (row_number() over (partition by l_orderkey order by {SQL_LINE_ORDER}) - 1)::bigint as sort from lineitem where l_returnflag <> 'R'""")
def renumber_children(t: Tables):
    left = t.lineitem.filter(F.col("l_returnflag") != "R")
    return merge.renumber(left, "l_orderkey", LINE_ORDER).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "sort")


@query("""
with p as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_partkey) - 1 as pos from part),
m as (select arg_min(p_partkey, struct_pack(a := -p_size, b := p_partkey)) as p_partkey, case when p_brand > 'Brand#15' then -1 else 1 end as dir from part group by p_brand),
d as (select p.*, dir from p left join m using (p_partkey)),
n as (select *, lag(pos) over w as prev_pos, lead(pos) over w as next_pos, lag(dir) over w as prev_dir, lead(dir) over w as next_dir from d window w as (partition by p_brand order by pos))
select p_partkey, p_brand, (case when dir = -1 and prev_pos is not null then pos - 1 when dir = 1 and next_pos is not null then pos + 1
  when next_dir = -1 then pos + 1 when prev_dir = 1 then pos - 1 else pos end)::bigint as sort from n""")
def move_children(t: Tables):
    picked = t.part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(-F.col("p_size"), F.col("p_partkey"))).alias("p_partkey"))
    moves = picked.select("p_partkey", F.when(F.col("p_brand") > "Brand#15", -1).otherwise(1).alias("direction"))
    rows = t.part.select("p_partkey", "p_brand", F.col("p_partkey").alias("sort"))
    return merge.move_children(rows, moves, "p_brand", "p_partkey").select("p_partkey", "p_brand", "sort")


@query("""
select p_partkey, array_to_string(list_filter([
  case when length(trim(p_name)) > 9 then 'p_name: too long' end, case when p_type not in ('PROMO', 'SMALL', 'LARGE') then 'p_type: not allowed' end,
  case when not (p_size - 3 >= 0 and p_size - 3 <= 40) then 'size: bad range' end, case when len(string_split(p_brand, '1')) > 1 then 'brand: too many' end], lambda x: x is not null), '; ') as violations
from part""")
def validation(t: Tables):
    issues = [merge.text_issue(F.col("p_name"), "p_name", 9, True), merge.choice_issue(F.col("p_type"), "p_type", ["PROMO", "SMALL", "LARGE"]),
              merge.range_issue(F.array(F.col("p_size") - 3, F.lit(40)), "size", 100_000), merge.size_issue(F.split("p_brand", "1"), "brand", 1)]
    return merge.with_violations(t.part, issues).select("p_partkey", F.array_join("violations", "; ").alias("violations"))


@query("""
select vec_id, case when len(embedding) <> 64 then 'invalid embedding' end as issue from embeddings""")
def vector_validation(t: Tables):
    return t.embeddings.select("vec_id", merge.vector_issue(F.col("embedding"), 64).alias("issue"))


# ---------------------------------------------------------------- audits

SQL_LISTING = """
listing as (select o_orderkey as slug, o_custkey as code, case o_orderstatus when 'F' then 'A-1' when 'O' then 'A-2' else 'B-1' end as range,
  case when o_totalprice > 400000 then ['A-2'] when o_totalprice > 300000 then ['B-1', 'A-1'] else [] end as also from orders),
products as (select l_orderkey as slug, case when bool_or(l_returnflag = 'R') then 'review' else 'published' end as status from lineitem group by 1)"""


@query(f"""
with {SQL_LISTING}, cross_listed as (select slug, range, unnest(also) as a from listing)
select slug, 'unknown product' as issue from listing where slug not in (select slug from products)
union all select slug, 'not published' from listing join products using (slug) where status <> 'published'
union all select slug, 'repeated code' from listing where code in (select code from listing group by code having count(*) > 1)
union all select distinct slug, 'bad cross-listing' from cross_listed where a = range or a[1] <> range[1]""")
def integrity_audit(t: Tables):
    status = F.col("o_orderstatus")
    also = F.when(F.col("o_totalprice") > 400000, F.array(F.lit("A-2"))).when(F.col("o_totalprice") > 300000, F.array(F.lit("B-1"), F.lit("A-1"))).otherwise(F.array().cast("array<string>"))
    listing = t.orders.select(F.col("o_orderkey").alias("slug"), F.col("o_custkey").alias("code"),
                              F.when(status == "F", "A-1").when(status == "O", "A-2").otherwise("B-1").alias("range"), also.alias("also"))
    products = t.lineitem.groupBy(F.col("l_orderkey").alias("slug")).agg(
        F.when(F.max((F.col("l_returnflag") == "R").cast("int")) == 1, "review").otherwise("published").alias("status"))
    taxonomy = t.spark.createDataFrame([("A-1", "A"), ("A-2", "A"), ("B-1", "B")], "range string, main string")
    return merge.audit_listing(listing, products, taxonomy)


@query("""
with l as (select doc_id::varchar as key, md5(text) as md5 from documents where lang <> 'de'),
r as (select doc_id::varchar as key, case when source = 'src3' then 'old' else md5(text) end as md5 from documents where lang <> 'fr' union all select 'healthcheck.txt', '0')
select key, case when l.md5 is not null and l.md5 is distinct from r.md5 then 'upload' when l.md5 is null and key <> 'healthcheck.txt' then 'delete' else 'keep' end as action
from l full join r using (key)""")
def manifest_diff(t: Tables):
    rows = t.documents.select(F.col("doc_id").cast("string").alias("key"), F.md5("text").alias("md5"), "lang", "source")
    local = rows.filter(F.col("lang") != "de").select("key", "md5")
    remote = rows.filter(F.col("lang") != "fr").select("key", F.when(F.col("source") == "src3", "old").otherwise(F.col("md5")).alias("md5"))
    check = t.spark.createDataFrame([("healthcheck.txt", "0")], "key string, md5 string")
    return merge.manifest_diff(local, remote.unionByName(check))



@query("""
with p as (select l_orderkey, l_partkey, l_partkey % 7 as digest, l_extendedprice,
  row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_shipdate, l_extendedprice) as place from lineitem)
select l_orderkey, digest, min(place)::bigint as place, arg_min(l_partkey, place) as l_partkey from p where l_extendedprice >= 20000 and digest <> 3 group by 1, 2""")
def exact_repeats(t: Tables):
    """Lines as pictures of their order's page: cheap ones are no photos, one digest is a letterhead, of equal digests the first one stays."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = t.lineitem.withColumns({"place": F.row_number().over(w).cast("long"), "digest": F.col("l_partkey") % 7})
    letterhead = rows.filter("digest = 3").select("digest").distinct()
    found = identity.page_photos(rows.select("l_orderkey", "digest", "place", "l_partkey", "l_extendedprice"), ["l_orderkey"], "digest", "place", letterhead,
                                 F.col("l_extendedprice") >= 20000)
    return found.select("l_orderkey", "digest", "place", "l_partkey")
