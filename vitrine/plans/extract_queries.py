"""Structure from text, sizes, word boxes and vectors. Sheets and pages are laid out from part columns,
because the given documents hold no label lines."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.functions import sizes
from vitrine.operators import extract, ordered, similar, vector_index
from vitrine.functions.vectors import unit_vector
from vitrine.plans.tables import Tables, query
from vitrine.session import ensure_checkpoint_dir

# ---------------------------------------------------------------- markup


@query("""
with m as (select page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) as hrefs from pages),
p as (select page_id, unnest(hrefs) as href, generate_subscripts(hrefs, 1) - 1 as position from m)
select page_id, position::bigint as position, href from p where regexp_matches(href, '^/[A-Za-z]') and not regexp_matches(href, 'CONTACT|the')""")
def page_links(t: Tables):
    out = extract.links(t.pages, ["page_id"], "html", "^/[A-Za-z]", "CONTACT|the")
    return out.select("page_id", F.col("position").cast("long"), "href")


@query(r"""
with m as (select page_id, regexp_extract_all(html, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1) as blocks from pages),
c as (select page_id, list_filter(list_transform(blocks, lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(b, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') as paras from m),
u as (select page_id, unnest(paras) as paragraph, generate_subscripts(paras, 1) - 1 as position from c)
select page_id, position::bigint as position, paragraph from u""")
def page_paragraphs(t: Tables):
    out = extract.paragraphs(t.pages, ["page_id"], "html")
    return out.select("page_id", F.col("position").cast("long"), "paragraph")


# ---------------------------------------------------------------- sheets


def _sheets(t: Tables):
    text = lambda *parts: F.concat(*[F.lit(p) if p.startswith(" ") or p.endswith(" ") or ":" in p or p in ("xx",) else F.col(p).cast("string") for p in parts])
    lines = F.array_compact(F.array(
        F.lit("ACME CO.,LTD Tel. : 02"), F.lit("stray line before the first field"),
        F.when(F.col("p_type") != "PROMO", text("Type : ", "p_name")),
        F.when(F.col("p_type") != "SMALL", text("1. Code: ", "p_brand")),
        F.when(F.col("p_size") > 25, F.lit("wrapped code is dropped")),
        text("Size : ", "p_size", " x ", "p_size", " cm"),
        F.when(F.col("p_size") > 40, text(" or ", "p_partkey")),
        F.when(F.col("p_size") > 30, text(": second ", "p_size")),
        text("Frame : ", "p_type"), text("  wrapped   ", "p_name"), text(": ", "p_brand"), F.lit("45 x 60"), F.lit("Empty : "),
        F.when(F.col("p_size") <= 10, text("filled ", "p_size")),
        F.lit("Specification"), F.lit("loose text after the heading"),
        F.when(F.col("p_size") > 5, F.lit("Feature :")), F.when(F.col("p_size") > 5, text(" first ", "p_name")), F.when(F.col("p_size") > 5, text(": second ", "p_brand")),
        F.lit("Remark : note "), text(" number ", "p_partkey")))
    return t.dealt("part", "p_partkey").select("p_partkey", F.posexplode(lines).alias("line_no", "line"))


SQL_SHEETS = """
with p as (select *, p_size::varchar as s from part)
select p_partkey, case when p_type <> 'SMALL' then p_brand end as code, case when p_type <> 'PROMO' then p_name || case when p_type = 'SMALL' and p_size > 25 then ' wrapped code is dropped' else '' end end as type, 'note number ' || p_partkey as note,
  'Size=' || s || ' x ' || s || ' cm' || case when p_size > 40 then ' or ' || p_partkey else '' end || case when p_size > 30 then '|Size=second ' || s else '' end as sizes,
  'Frame=' || p_type || ' wrapped ' || p_name || ';' || p_brand || case when p_size <= 10 then '|Empty=filled ' || s else '' end as specs,
  case when p_size > 5 then 'first ' || p_name || '|second ' || p_brand else '' end as features, 'Specification' as sections
from p"""


@query(SQL_SHEETS)
def block_extract(t: Tables):
    out = extract.parse_sheets(_sheets(t), ["p_partkey"])
    pairs = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["label"], F.lit("="), s["value"])), "|")
    specs = F.array_join(F.transform("specs", lambda s: F.concat(s["label"], F.lit("="), F.array_join(s["values"], ";"))), "|")
    return out.select("p_partkey", "code", "type", "note", pairs("sizes").alias("sizes"), specs.alias("specs"),
                      F.array_join("features", "|").alias("features"), F.array_join("sections", "|").alias("sections"))


def _web_pages(t: Tables):
    size = F.col("p_size").cast("string")
    lines = F.array_compact(F.array(
        F.lit("Menu"), F.col("p_name"), F.lit("an introduction"), F.col("p_type"), F.lit("Download"),
        F.lit("Material"), F.lit("Seat"), F.lit(":"), F.col("p_type"), F.col("p_brand"), F.lit("Colour"), F.lit("Leg"), F.lit(":"), F.lit("black"),
        F.concat(F.lit("Dimension : "), F.col("p_brand")), F.lit("Width"), F.lit(":"), F.concat(size, F.lit("0   mm")),
        F.when(F.col("p_size") > 20, F.lit("Depth")), F.when(F.col("p_size") > 20, F.lit(":")), F.when(F.col("p_size") > 20, F.concat(size, F.lit(" - 99 cm"))),
        F.when(F.col("p_size") > 30, F.lit("Overall")), F.when(F.col("p_size") > 30, F.lit(":")), F.when(F.col("p_size") > 30, F.concat(F.lit("1,200 x "), size, F.lit(" x 7.5 cm"))),
        F.when(F.col("p_size") < 10, F.lit("Dimension")),
        F.lit("Other"), F.lit("Lock"), F.lit(":"), F.lit("yes"), F.lit("เรื่องน่าสนใจ"), F.lit("Seat"), F.lit(":"), F.lit("ignored")))
    return t.dealt("part", "p_partkey").select("p_partkey", "p_name", F.array_join(lines, "\n").alias("text"))


@query("""
select p_partkey, section, label, value from part, lateral (values ('material', 'Seat', p_type || ' ' || p_brand), ('colour', 'Leg', 'black'), ('other', 'Lock', 'yes')) v(section, label, value)""")
def section_parse(t: Tables):
    blocks = extract.parse_blocks(_web_pages(t), ["p_partkey"], "text", "p_name")
    return extract.spec_rows(blocks, ["p_partkey"]).select("p_partkey", "section", "label", "value")


@query("""
select p_partkey, p_brand as label, 'w=' || p_size || '0-' || p_size || '0' as axes from part where p_size <= 20
union all select p_partkey, p_brand, 'd=' || p_size * 10 || '-990,w=' || p_size || '0-' || p_size || '0' from part where p_size > 20
union all select p_partkey, p_brand || ' · Overall', 'd=' || p_size * 10 || '-' || p_size * 10 || ',h=75-75,w=12000-12000' from part where p_size > 30""")
def section_sizes(t: Tables):
    blocks = extract.parse_blocks(_web_pages(t), ["p_partkey"], "text", "p_name")
    out = extract.size_sets(blocks, ["p_partkey"])
    shown = [F.concat(F.lit(f"{a}="), F.array_join(F.col(f"mm.{a}").cast("array<string>"), "-")) for a in ("d", "h", "w")]
    return out.select("p_partkey", "label", F.concat_ws(",", *shown).alias("axes"))


@query("""select p_partkey, 'an introduction' || chr(10) || p_type as summary from part""")
def introductions(t: Tables):
    return extract.introduction(_web_pages(t), ["p_partkey"], "text", "p_name")


@query(r"""
with body as (select page_id, position, paragraph, row_number() over (partition by page_id order by position) as r from (
  select page_id, unnest(paras) as paragraph, generate_subscripts(paras, 1) as position from (select page_id, regexp_extract_all(html, '<(?:li><a|p)(?: [^>]*)?>([^<]*)</(?:a|p)>', 1) as paras from pages)) where trim(paragraph) <> ''),
n as (select *, lead(paragraph) over (partition by page_id order by position) as nxt from body where r > 1),
c as (select *, row_number() over (partition by page_id order by position) as k, length(paragraph) <= 28 and not regexp_matches(paragraph, '\d\d') and length(nxt) > length(paragraph) as cand from n),
o as (select *, k - coalesce(max(case when not coalesce(cand, false) then k end) over (partition by page_id order by k rows unbounded preceding), 0) - 1 as off from c),
l as (select *, coalesce(cand, false) and off % 2 = 0 as lab from o),
u as (select *, coalesce(lag(lab) over (partition by page_id order by k), false) as used from l)
select page_id, (position - 1)::bigint as position, case when lab then 'pair' else 'feature' end as kind, case when lab then paragraph end as label, case when lab then nxt else paragraph end as value from u where not used""")
def paragraph_pairs(t: Tables):
    found = F.regexp_extract_all("html", F.lit("<(?:li><a|p)(?: [^>]*)?>([^<]*)</(?:a|p)>"), F.lit(1))
    paras = t.pages.select("page_id", F.posexplode(found).alias("position", "paragraph")).filter(F.trim("paragraph") != "")
    out = extract.pair_paragraphs(paras, ["page_id"])
    return out.select("page_id", F.col("position").cast("long"), "kind", "label", "value")


# ---------------------------------------------------------------- sizes


def _size_texts(t: Tables):
    n = F.col("p_size")
    text = (
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("W "), n, F.lit(" x D "), n, F.lit("-"), n + 9, F.lit(" x H "), n * 2, F.lit(" cm")))
        .when(F.col("p_type") == "SMALL", F.concat(n * 20, F.lit(" x "), n * 30, F.lit(" x 750 mm")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("1."), n, F.lit(" x 0.6 x 0,75")))
        .when(F.col("p_type") == "MEDIUM", F.concat(n * 11, F.lit(" * "), n * 7))
        .when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Width: "), n * 100, F.lit(" Height "), n * 3, F.lit(" cm"))).otherwise("no size"))
    return t.dealt("part", "p_partkey").select("p_partkey", "p_type", "p_size", text.alias("text"))


# In "Width: 100" the height keyword "h" matches first, so that text gives the same width and height.
SQL_SIZES = """
raw as (select p_partkey, p_type, p_size::bigint as n from part),
mm as (select p_partkey, p_type, n,
  case p_type when 'PROMO' then n * 10 when 'SMALL' then n * 20 when 'LARGE' then round_even(('1.' || n)::double * 1000, 0)::bigint when 'MEDIUM' then n * 11 * f when 'ECONOMY' then n * 1000 end as w,
  case p_type when 'PROMO' then n * 10 when 'SMALL' then n * 30 when 'LARGE' then 600 when 'MEDIUM' then n * 7 * f end as d0,
  case p_type when 'PROMO' then (n + 9) * 10 when 'SMALL' then n * 30 when 'LARGE' then 600 when 'MEDIUM' then n * 7 * f end as d1,
  case p_type when 'PROMO' then n * 20 when 'SMALL' then 750 when 'LARGE' then 750 when 'ECONOMY' then n * 1000 end as h
  from (select *, case when n * 11 > 400 then 1 else 10 end as f from raw))"""


@query(f"with {SQL_SIZES} select p_partkey, w, d0, d1, h from mm")
def size_parse(t: Tables):
    out = sizes.with_parsed_size(_size_texts(t), "text", "mm")
    n = lambda c: c.cast("long")
    return out.select("p_partkey", n(F.col("mm.w")[0]).alias("w"), n(F.col("mm.d")[0]).alias("d0"), n(F.col("mm.d")[1]).alias("d1"), n(F.col("mm.h")[0]).alias("h"))


def _sql_bad(axis: str, lo: str, hi: str) -> str:
    low, high = sizes.PLAUSIBLE[axis]
    return f"coalesce({lo} < {low} or {hi} > {high}, false)"


def _sql_times(x: str, f: str) -> str:
    return f"round_even({x} * {f}, 0)::bigint"


def _sql_bad_count(f: str) -> str:
    return " + ".join(f"({_sql_bad(a, _sql_times(lo, f), _sql_times(hi, f))})::int" for a, lo, hi in (("w", "w", "w"), ("d", "d0", "d1"), ("h", "h", "h")))


@query(f"""
with {SQL_SIZES},
f as (select *, list_min([struct_pack(b := {_sql_bad_count('1.0::double')}, i := 0, f := 1.0::double), struct_pack(b := {_sql_bad_count('10.0::double')}, i := 1, f := 10.0::double),
  struct_pack(b := {_sql_bad_count('0.1::double')}, i := 2, f := 0.1::double)]).f as f from mm),
s as (select p_partkey, f, {_sql_times('w', 'f')} as w, {_sql_times('d0', 'f')} as d0, {_sql_times('d1', 'f')} as d1, {_sql_times('h', 'f')} as h from f),
x as (select *, {_sql_bad('w', 'w', 'w')} and w > 6000 and not {_sql_bad('w', "round_even(w / 10.0::double, 0)", "round_even(w / 10.0::double, 0)")} as fw,
  {_sql_bad('d', 'd0', 'd1')} and d1 > 4000 and not {_sql_bad('d', "round_even(d0 / 10.0::double, 0)", "round_even(d1 / 10.0::double, 0)")} as fd,
  {_sql_bad('h', 'h', 'h')} and h > 2600 and not {_sql_bad('h', "round_even(h / 10.0::double, 0)", "round_even(h / 10.0::double, 0)")} as fh from s),
y as (select p_partkey, f <> 1.0 or fw or fd or fh as fixed, case when fw then round_even(w / 10.0::double, 0)::bigint else w end as w, case when fd then round_even(d0 / 10.0::double, 0)::bigint else d0 end as d0,
  case when fd then round_even(d1 / 10.0::double, 0)::bigint else d1 end as d1, case when fh then round_even(h / 10.0::double, 0)::bigint else h end as h from x)
select p_partkey, w, d0, d1, h, case when w is null and d0 is null and h is null then null when {_sql_bad('w', 'w', 'w')} or {_sql_bad('d', 'd0', 'd1')} or {_sql_bad('h', 'h', 'h')} then 'dims-suspect'
  when fixed then 'dims-fixed' end as flag from y""")
def size_rescale(t: Tables):
    out = sizes.with_plausible_size(sizes.with_parsed_size(_size_texts(t), "text", "raw"), "raw", "mm", "flag")
    n = lambda c: c.cast("long")
    return out.select("p_partkey", n(F.col("mm.w")[0]).alias("w"), n(F.col("mm.d")[0]).alias("d0"), n(F.col("mm.d")[1]).alias("d1"), n(F.col("mm.h")[0]).alias("h"), "flag")


@query("""
select p_partkey, (p_size + 100) * 10 as w, case when p_size <= 25 then p_size * 100 end as d, (p_size + 200) * 10 as h, case when p_size > 25 then (p_size + 100) * 10 end as dia from (
  select p_partkey, p_size::bigint as p_size from part) where p_size <= 25
union all select p_partkey, null, null, (p_size + 200)::bigint, (p_size + 100)::bigint from part where p_size > 25""")
def brochure_sizes(t: Tables):
    n = F.col("p_size")
    text = F.when(n <= 25, F.concat(n + 100, F.lit("(W) x "), n * 10, F.lit("(D) x "), n + 200, F.lit("(H) cm"))).otherwise(
        F.concat(n + 100, F.lit("(Ø) x "), n + 200, F.lit("(H) mm")))
    mm = sizes.brochure_size(F.col("text"))
    return t.dealt("part", "p_partkey").select("p_partkey", text.alias("text")).select("p_partkey", *[mm[a][0].cast("long").alias(a) for a in ("w", "d", "h", "dia")])


# ---------------------------------------------------------------- layout


@query("""
with g as (select user_id, event_id, ts, case when ts - lag(ts) over w > interval 1 hour then 1 else 0 end as gap from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(gap) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from g)
select user_id, island::bigint as island, count(*)::bigint as n, min(event_id) as first_event, max(event_id) as last_event from i group by 1, 2""")
def line_islands(t: Tables):
    """Rows of one owner cut into runs where the distance to the row before is too large."""
    rows = t.events.select("user_id", "event_id", "ts")
    near = ordered.with_neighbours(rows, ["user_id"], ["ts", "event_id"], F.col("ts"), "before", None)
    gap = F.coalesce((F.col("ts") - F.col("before") > F.expr("interval 1 hour")).cast("int"), F.lit(0))
    runs = ordered.running_total(near, ["user_id"], ["ts", "event_id"], gap, "island")
    return runs.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""
with v as (select *, max(case when event_type = 'view' then struct_pack(ts := ts, id := event_id) end) over (partition by user_id order by ts, event_id rows unbounded preceding) as seen from events)
select event_id, case when ts - seen.ts <= interval 1 hour then seen.id end as nearest_view from v where event_type = 'purchase'""")
def nearest_above(t: Tables):
    """For each purchase the latest view of the same owner before it, within an hour."""
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    view = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    seen = ordered.carry_forward(rows, ["user_id"], ["ts", "event_id"], view, "seen")
    close = F.col("ts") - F.col("seen.ts") <= F.expr("interval 1 hour")
    return seen.filter(F.col("event_type") == "purchase").select("event_id", F.when(close, F.col("seen.event_id")).alias("nearest_view"))


# ---------------------------------------------------------------- vectors


def _photo_queries(t: Tables):
    """One query per label: the last picture of each product is held out of the index."""
    last = t.embeddings.groupBy("label").agg(F.max_by("embedding", "vec_id").alias("embedding"), F.max("vec_id").alias("vec_id"))
    index = t.embeddings.join(last.select("vec_id"), "vec_id", "left_anti")
    return last, index


SQL_NEAR = """
q as (select label as true_label, max(vec_id) as query_id, arg_max(embedding, vec_id) as e from embeddings group by label),
qu as (select true_label, query_id, list_transform(e::double[], lambda x: round(x / sqrt(list_sum(list_transform(e::double[], lambda y: y * y))), 6)) as v from q),
near as (select query_id, vec_id as image_id, label, round(1 - list_cosine_similarity(v, embedding::double[]), 9) as distance from qu, embeddings
  where vec_id not in (select query_id from q)
  qualify row_number() over (partition by query_id order by distance, vec_id) <= 240),
best as (select query_id, label, min(distance) as distance from near group by 1, 2),
shown as (select label from embeddings group by label having arg_min(embedding[1], vec_id) > 0),
ranked as (select query_id, label, distance, row_number() over (partition by query_id order by distance, label) as rank from best semi join shown using (label) qualify rank <= 24)"""


def _near(t: Tables):
    queries, index = _photo_queries(t)
    return queries, similar.nearest_images(index, queries, "vec_id", "vec_id", "embedding", "label")


@query(f"with {SQL_NEAR} select query_id, image_id, round(distance, 6) as distance from near")
def vector_topk(t: Tables):
    _, near = _near(t)
    return near.select("query_id", "image_id", F.round("distance", 6).alias("distance"))


def _indexed(t: Tables):
    queries, index = _photo_queries(t)
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}"
    vector_index.build_index(index, "vec_id", "embedding", "label", folder)
    return vector_index.indexed_nearest(t.spark, folder, queries, "vec_id", "embedding")


@query(f"with {SQL_NEAR} select query_id, image_id, round(distance, 6) as distance from near")
def indexed_vector_topk(t: Tables):
    """The rows of vector_topk, from clusters that are read by their bounds."""
    near, _ = _indexed(t)
    return near.select("query_id", "image_id", F.round("distance", 6).alias("distance"))


def _ranked(t: Tables):
    queries, near = _near(t)
    # A product counts as published when its first picture points to the positive side of the first axis.
    first = t.embeddings.groupBy(F.col("label").alias("product")).agg(F.min_by(F.col("embedding")[0], "vec_id").alias("x"))
    return queries, similar.top_products(similar.best_per_product(near), first.filter(F.col("x") > 0))


@query(f"with {SQL_NEAR} select query_id, label::bigint as label, rank::bigint as rank, round(1 - distance, 3) as score from ranked")
def vector_by_product(t: Tables):
    _, ranked = _ranked(t)
    return ranked.select("query_id", F.col("product").cast("long").alias("label"), F.col("rank").cast("long"), "score")


@query(f"""
with {SQL_NEAR} select count(*)::bigint as queries, round(avg((coalesce(rank <= 1, false))::int), 6) as top_1, round(avg((coalesce(rank <= 5, false))::int), 6) as top_5,
  round(avg((coalesce(rank <= 24, false))::int), 6) as top_24 from qu left join ranked on ranked.query_id = qu.query_id and ranked.label = qu.true_label""")
def recall_at_k(t: Tables):
    queries, ranked = _ranked(t)
    truth = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("product"))
    out = similar.hit_rates(ranked, truth)
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("top_1", "top_5", "top_24")])


@query("""
select vec_id, array_to_string(list_transform(list_transform(embedding::double[], lambda x: round(x / sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y))), 6)), lambda z: (round(z * 1000000))::bigint::varchar), ',') as unit from embeddings""")
def unit_vectors(t: Tables):
    micro = F.transform(unit_vector(F.col("embedding")), lambda x: F.round(x * 1_000_000, 0).cast("long").cast("string"))
    return t.dealt("embeddings", "vec_id").select("vec_id", F.array_join(micro, ",").alias("unit"))
