"""Keys, spelling, classification and translation over parts and documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import language, textclean
from vitrine.functions.patterns import mapped
from vitrine.operators import classify, identity, ordered, reports, spelling
from vitrine.operators.browse import code_order
from vitrine.plans.browse_queries import SQL_FLAGGED, flagged_documents
from vitrine.plans.tables import Tables, query

# ---------------------------------------------------------------- keys


@query(r"""
with c as (select p_partkey, upper(p_type) || '-' || p_brand || '/' || p_size as code, p_name, p_brand, p_size from part)
select p_partkey,
  regexp_replace(upper(code), '[\s\-_/.]+', '', 'g') as dedupe_key, regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') as search_key,
  upper(coalesce(nullif(regexp_replace(string_split(p_brand, '#')[1], '[0-9]+$', ''), ''), p_brand)) as series,
  upper(string_split(p_name, ' ')[1]) as first_word,
  coalesce(nullif(trim(lower(regexp_replace(code, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'item') as slug,
  regexp_extract(replace(code, ' ', ''), '^[0-9]?[A-Z]+(?:-[A-Z]+)?') as family,
  case when length(p_name) <= 8 then p_name else rtrim(substring(p_name, 1, 8)) || '…' end as short_name
from c""")
def code_keys(t: Tables):
    code = F.concat(F.upper("p_type"), F.lit("-"), F.col("p_brand"), F.lit("/"), F.col("p_size"))
    series = textclean.series_of_code(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    return t.part.withColumn("code", code).select(
        "p_partkey", textclean.dedupe_key(F.col("code")).alias("dedupe_key"), textclean.search_key(F.col("code")).alias("search_key"),
        series.alias("series"), textclean.series_first_word(F.col("p_name")).alias("first_word"),
        textclean.slugify(F.col("code")).alias("slug"), textclean.code_family(F.col("code")).alias("family"),
        textclean.shorten(F.col("p_name"), 8).alias("short_name"))


@query(r"""
with c as (select p_partkey, p_name, p_brand, 'SFO' || p_size || '-' || p_partkey as raw, p_size || '. ' ||
  case when p_size > 25 then 'F' || p_size || ' ' || p_name when p_size > 10 then p_name else 'k' || p_size || 'x' || p_name end as title from part),
d as (select *, regexp_replace(title, '^\d+(\.\d+)*\.?\s*', '') as t from c)
select p_partkey, regexp_replace(raw, '^SFO', 'SF0') as cleaned,
  case when t like 'F%' then regexp_extract(t, '^(F\d+)', 1) when t like 'k%' and regexp_matches(string_split(t, ' ')[1], '\d') then upper(string_split(t, ' ')[1])
       else 'AB-' || p_partkey end as code,
  case when t like 'F%' then p_name when t like 'k%' and regexp_matches(string_split(t, ' ')[1], '\d') then string_split(t, ' ')[2] else t end as name
from d""")
def title_parts(t: Tables):
    title = F.concat(F.col("p_size"), F.lit(". "), F.when(F.col("p_size") > 25, F.concat(F.lit("F"), F.col("p_size"), F.lit(" "), F.col("p_name")))
                     .when(F.col("p_size") > 10, F.col("p_name")).otherwise(F.concat(F.lit("k"), F.col("p_size"), F.lit("x"), F.col("p_name"))))
    file_name = F.concat(F.lit("รุ่น AB "), F.col("p_partkey"), F.lit(".docx"))
    raw = F.concat(F.lit("SFO"), F.col("p_size"), F.lit("-"), F.col("p_partkey"))
    parts = textclean.split_title(title, file_name)
    return t.part.select("p_partkey", textclean.clean_code(raw).alias("cleaned"), parts["code"].alias("code"), parts["name"].alias("name"))


# ---------------------------------------------------------------- words

SQL_TOKENS = r"""
tokens as (select doc_id, lang, token from (select doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+')) as token from documents) where token <> ''),
freq as (select token, count(*)::bigint as freq from tokens group by token)"""


def _tokens(t: Tables):
    return spelling.words(t.documents.select("doc_id", "text"), "text", ["doc_id"])


@query(f"with {SQL_TOKENS} select token, freq from freq")
def token_freq(t: Tables):
    return spelling.word_frequency(_tokens(t))


@query(f"""
with {SQL_TOKENS} select strip_accents(token) as skeleton, arg_min(token, struct_pack(a := -freq, b := token)) as spelling,
  count(*)::bigint as spellings, sum(freq)::bigint as occurrences from freq group by 1""")
def skeleton_dictionary(t: Tables):
    plain = F.translate(F.col("token"), textclean.ACCENTED, textclean.PLAIN)
    return spelling.skeleton_choice(spelling.word_frequency(_tokens(t)), "token", "freq", plain)


@query(f"""
with {SQL_TOKENS} select doc_id, sum(length(token))::bigint as chars, coalesce(sum(length(token)) filter (where freq < 3), 0)::bigint as unknown_chars,
  round(coalesce(sum(length(token)) filter (where freq < 3), 0) / sum(length(token))::double, 6) as unknown_ratio
from tokens join freq using (token) group by doc_id""")
def unknown_ratio(t: Tables):
    counts = spelling.word_counts(_tokens(t), ["doc_id"])
    known = spelling.frequency_of_counts(counts).filter(F.col("freq") >= 3)
    out = spelling.unknown_ratio(counts, known, ["doc_id"])
    return out.withColumn("unknown_ratio", F.round("unknown_ratio", 6))


@query(f"""
with {SQL_TOKENS} select doc_id, avg(case when freq >= 3 then 1 else 0 end) >= 0.9 and not bool_or(regexp_matches(token, '[0-9]')) as readable
from tokens join freq using (token) group by doc_id""")
def name_quality(t: Tables):
    counts = spelling.word_counts(_tokens(t), ["doc_id"])
    known = spelling.frequency_of_counts(counts).filter(F.col("freq") >= 3)
    return spelling.name_is_readable(counts, known, ["doc_id"], digits="[0-9]")


@query(f"""
with {SQL_TOKENS} select token, (10 - round_even(6 * least(1.0, log10(1 + freq) / 3), 0))::bigint as cost from freq""")
def word_costs(t: Tables):
    freq = spelling.word_frequency(_tokens(t))
    return freq.select("token", textclean.word_cost(F.col("freq")).cast("long").alias("cost"))


# ---------------------------------------------------------------- rules

TYPE_RULES = [(r"\bring\b|rod", "fittings"), (r"^hot.*(plate|anvil)", "forge"), (r"widget|gizmo", "gadgets"), (r"LARGE", "heavy")]
SPEC_RULES = [(r"#2", "brand-two"), (r"#1", "brand-one")]
SQL_TYPE = "case when p_size <= 5 then '' else p_name end"
SQL_CATEGORY = rf"""
case when regexp_matches({SQL_TYPE} || ' | ' || p_type, '(?i)\bring\b|rod') then 'fittings'
     when regexp_matches({SQL_TYPE} || ' | ' || p_type, '(?i)^hot.*(plate|anvil)') then 'forge'
     when regexp_matches({SQL_TYPE} || ' | ' || p_type, '(?i)widget|gizmo') then 'gadgets'
     when regexp_matches({SQL_TYPE} || ' | ' || p_type, '(?i)LARGE') then 'heavy'
     when p_size <= 5 and p_brand like '%#2%' then 'brand-two' when p_size <= 5 and p_brand like '%#1%' then 'brand-one' end"""


def _categorized(t: Tables):
    type_text = F.when(F.col("p_size") <= 5, "").otherwise(F.col("p_name"))
    return t.dealt("part", "p_partkey").withColumn("category", classify.categorize(type_text, F.col("p_type"), F.col("p_brand"), TYPE_RULES, SPEC_RULES))


@query(f"select p_partkey, {SQL_CATEGORY} as category from part")
def first_match_category(t: Tables):
    return _categorized(t).select("p_partkey", "category")


FOLDERS = {"ECONOMY": "economy", "PROMO": "promo", "SMALL": "small", "LARGE": "large"}


@query(f"""
select p_partkey, case when p_type in ('PROMO', 'SMALL') or m is null then coalesce(rule, m) else m end as category from (
  select p_partkey, p_type, {SQL_CATEGORY} as rule, case p_type when 'ECONOMY' then 'economy' when 'PROMO' then 'promo' when 'SMALL' then 'small' when 'LARGE' then 'large' end as m from part)""")
def folder_category(t: Tables):
    rows = _categorized(t)
    return rows.select("p_partkey", classify.folder_category(F.col("p_type"), F.col("category"), FOLDERS, ["PROMO", "SMALL"]).alias("category"))


TAGS = [("small|new", "low-back"), ("large|old", "high-back"), ("ring|rod", "round"), (r"r", "has-r"), (r"PROMO|ECONOMY", "mid-back")]


@query(r"""
with f as (select p_partkey, list_filter([
  case when regexp_matches(s, '(?i)small|new') then 'low-back' end, case when regexp_matches(s, '(?i)large|old') then 'high-back' end,
  case when regexp_matches(s, '(?i)ring|rod') then 'round' end, case when regexp_matches(s, '(?i)r') then 'has-r' end,
  case when regexp_matches(s, '(?i)PROMO|ECONOMY') then 'mid-back' end], lambda x: x is not null) as tags
  from (select p_partkey, p_name || ' ' || p_type as s from part))
select p_partkey, array_to_string(list_filter(tags, lambda x: not ends_with(x, '-back') or x = list_filter(tags, lambda y: ends_with(y, '-back'))[1]), ',') as tags from f""")
def multi_tags(t: Tables):
    text = F.concat_ws(" ", "p_name", "p_type")
    return t.part.select("p_partkey", F.array_join(classify.tags(text, TAGS), ",").alias("tags"))


@query("""
with v as (select string_split(p_name, ' ')[2] as family, p_type as category, count(*) as n from part group by 1, 2),
b as (select family, sum(n) as total, arg_min(struct_pack(c := category, n := n), struct_pack(a := -n, b := category)) as best from v group by family)
select family, best.c as category, best.n::bigint as votes, round(best.n / total::double, 6) as share from b where best.n >= 2 and best.n / total::double >= 0.18""")
def family_vote(t: Tables):
    rows = t.part.select(F.split("p_name", " ")[1].alias("family"), F.col("p_type").alias("category"))
    out = classify.learn_families(rows, "family", "category", 2, 0.18)
    return out.withColumn("share", F.round("share", 6))


CODE_RULES = [(r"^EC", "economy-line"), (r"^LA", "large-line")]
PROVENANCE_RULES = [(r"\bring\b", "fittings"), (r"hot.*rod", "fittings")]
NOISY_RULES = [(r"gizm", "gadgets"), (r"plat", "plates")]


@query(r"""
with n as (select p_partkey, p_size, p_type || '-' || string_split(p_name, ' ')[1] || p_size as code0, p_name, p_type, p_brand from part),
m as (select *, upper(code0) as code, case when p_size > 44 then 'hall' end as dflt from n),
a as (select *, regexp_extract(code, '^[0-9]?[A-Z]+(?:-[A-Z]+)?') as family,
  case when regexp_matches(p_name, '(?i)\bring\b') then 'fittings' when regexp_matches(p_name || ' | ' || code, '(?i)hot.*rod') then 'fittings'
       when p_name ilike '%gizm%' then 'gadgets' when p_name ilike '%plat%' then 'plates' end as named,
  case when code like 'EC%' then 'economy-line' when code like 'LA%' then 'large-line' end as rule from m),
v as (select family, named, count(*) as n from a where named is not null and length(family) >= 2 group by 1, 2),
b as (select family, sum(n) as total, arg_min(struct_pack(c := named, n := n), struct_pack(a := -n, b := named)) as best from v group by family),
l as (select family, best.c as learned from b where best.n >= 2 and best.n / total::double >= 0.7),
r as (select a.*, coalesce(named, learned, rule) as found from a left join l using (family))
select p_partkey, coalesce(found, dflt) as category, array_to_string(list_filter(['ocr-import', case when found is null then 'category-guessed' end,
  case when rule is not null and found is not distinct from rule and named is null then 'category-from-code' end,
  case when found is null and dflt is null then 'no-category' end], lambda x: x is not null), ',') as flags from r""")
def category_provenance(t: Tables):
    code = F.upper(F.concat(F.col("p_type"), F.lit("-"), F.split("p_name", " ")[0], F.col("p_size")))
    rows = t.part.select("p_partkey", F.col("p_name").alias("name"), code.alias("code"), "p_size")
    default = F.when(F.col("p_size") > 44, "hall")
    out = classify.with_category_provenance(rows, "name", "code", default, PROVENANCE_RULES, NOISY_RULES, CODE_RULES)
    return out.select("p_partkey", "category", F.array_join("flags", ",").alias("flags"))


# ---------------------------------------------------------------- materials and ranges

_CATEGORY_OF = {"anvil": "storage", "bolt": "desks", "gear": "office-chairs", "gizmo": "sofas", "plate": "partitions",
                "ring": "meeting-tables", "rod": "shelving", "widget": "counters"}
_WORD_OF = {"red": "wood", "blue": "mesh", "hot": "leather", "cold": "steel", "large": "screen", "new": "reception", "old": "dining", "small": "locker"}


def _furniture(t: Tables):
    """Parts as furniture: the noun gives the category, the adjective the words in the type."""
    adjective, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    return t.dealt("part", "p_partkey").select(
        "p_partkey", "p_name", "p_size", "p_type", "p_brand", mapped(noun, _CATEGORY_OF).alias("category"),
        F.concat_ws(" ", mapped(adjective, _WORD_OF), noun).alias("type"),
        F.when(F.col("p_size") > 35, "steel frame").when(F.col("p_size") > 25, "caster").otherwise("").alias("spec"),
        F.when(F.col("p_type") == "PROMO", "steel").when(F.col("p_type") == "ECONOMY", "wood").alias("material"),
        F.when(F.col("p_type") == "LARGE", F.array(F.lit("veneer"))).when(F.col("p_type") == "SMALL", F.array(F.lit("steel"), F.lit("mesh")))
        .otherwise(F.array().cast("array<string>")).alias("materials"))


SQL_FURNITURE = """
furniture as (
  select p_partkey, p_name, p_size, p_type, p_brand,
    case string_split(p_name, ' ')[2] when 'anvil' then 'storage' when 'bolt' then 'desks' when 'gear' then 'office-chairs' when 'gizmo' then 'sofas'
      when 'plate' then 'partitions' when 'ring' then 'meeting-tables' when 'rod' then 'shelving' when 'widget' then 'counters' end as category,
    case string_split(p_name, ' ')[1] when 'red' then 'wood' when 'blue' then 'mesh' when 'hot' then 'leather' when 'cold' then 'steel' when 'large' then 'screen'
      when 'new' then 'reception' when 'old' then 'dining' when 'small' then 'locker' end || ' ' || string_split(p_name, ' ')[2] as type,
    case when p_size > 35 then 'steel frame' when p_size > 25 then 'caster' else '' end as spec,
    case p_type when 'PROMO' then 'steel' when 'ECONOMY' then 'wood' end as material,
    case p_type when 'LARGE' then ['veneer'] when 'SMALL' then ['steel', 'mesh'] else [] end as materials
  from part),
ranged as (
  select *,
    coalesce(list_has_any(materials, ['veneer']), false) as boards, coalesce(material, '') as m,
    regexp_matches(type || ' ' || spec, '(?i)wood') as wood_word, regexp_matches(type || ' ' || spec, '(?i)steel') as steel_word,
    (type ilike '%mesh%' or list_contains(materials, 'mesh')) as mesh, type ilike '%leather%' as leather from furniture),
cases as (
  select *, case when m in ('steel', 'wood') then m when boards then 'wood' when list_contains(materials, 'steel') or type ilike '%steel%' then 'steel' end as cm,
    case when m = 'steel' and not boards then 'TB-ST' when (m = 'wood' or boards or wood_word) and (list_contains(materials, 'steel') or steel_word) then 'TB-WS'
         when m = 'wood' or boards or wood_word then 'TB-WD' when list_contains(materials, 'steel') or steel_word then 'TB-ST' end as tr from ranged),
placed as (
  select *, case category
      when 'office-chairs' then case when mesh then 'CH-NT' when leather then 'CH-LT' else 'CH-MW' end
      when 'sofas' then 'GR' when 'counters' then case when type ilike '%reception%' then 'GR' end
      when 'partitions' then case when type ilike '%screen%' then 'PT' end
      when 'shelving' then case when cm = 'steel' then 'SH-ST' else 'SH-WD' end
      when 'storage' then case when cm = 'steel' then 'CB-ST' else 'CB-WD' end
      when 'meeting-tables' then 'TB-MT'
      when 'desks' then case when type ilike '%dining%' then null else coalesce(tr, 'TB-WD') end end as range,
    case when category = 'office-chairs' and mesh and leather then ['CH-LT'] when category = 'meeting-tables' then [coalesce(tr, 'TB-WD')] else [] end as also,
    case when category in ('shelving', 'storage') then cm is null when category in ('meeting-tables', 'desks') then tr is null else false end as guessed
  from cases)"""


def _placed(t: Tables):
    return classify.with_office_range(_furniture(t), F.col("category"), F.col("type"), F.col("spec"), F.col("material"),
                                      F.col("materials"), F.array().cast("array<string>"))


@query(f"with {SQL_FURNITURE} select p_partkey, range, case when range is not null then array_to_string(also, ',') end as also, case when range is not null then guessed end as guessed from placed")
def range_classify(t: Tables):
    return _placed(t).select("p_partkey", "range", F.array_join("also", ",").alias("also"), "guessed")


def _gaps(t: Tables):
    items = _placed(t).filter(F.col("range").isNotNull()).withColumn("printed", classify.printed_materials(
        F.col("materials"), F.col("range"), F.col("also"), F.col("guessed")))
    return items, [("photo", F.col("p_brand") == "Brand#7"), ("dimensions", F.col("p_size") <= 3), ("material", F.size("printed") == 0),
                   ("colours", F.size(classify.colours(F.col("p_name"))) == 0), ("range-guessed", F.col("guessed"))]


SQL_GAPS = f"""{SQL_FURNITURE},
items as (select *, case when len(materials) > 0 then list_transform(materials, lambda x: case x when 'veneer' then 'Wood veneer' when 'steel' then 'Steel' when 'mesh' then 'Mesh' end)
    when guessed then [] else case case when range = 'TB-MT' then also[1] else range end when 'CH-NT' then ['Mesh'] when 'CH-LT' then ['Leather / PU leather']
      when 'CB-WD' then ['Wood'] when 'CB-ST' then ['Steel'] when 'SH-WD' then ['Wood'] when 'SH-ST' then ['Steel'] when 'TB-WD' then ['Wood'] when 'TB-ST' then ['Steel']
      when 'TB-WS' then ['Wooden top', 'Steel frame'] else [] end end as printed
  from placed where range is not null),
gaps as (select p_partkey, range, list_filter([case when p_brand = 'Brand#7' then 'photo' end, case when p_size <= 3 then 'dimensions' end,
    case when len(printed) = 0 then 'material' end, case when not regexp_matches(p_name, '\\b(red|blue)\\b') then 'colours' end,
    case when guessed then 'range-guessed' end], lambda x: x is not null) as missing from items)"""


@query(f"with {SQL_GAPS} select p_partkey, range, array_to_string(missing, ' ') as missing from gaps where len(missing) > 0")
def gap_report(t: Tables):
    items, gaps = _gaps(t)
    out = reports.gap_report(items, gaps, ["p_partkey", "range"])
    return out.withColumn("missing", F.array_join("missing", " "))


@query(f"with {SQL_GAPS} select gap, count(*)::bigint as n from (select unnest(missing) as gap from gaps) group by gap")
def gap_counts(t: Tables):
    items, gaps = _gaps(t)
    return reports.gap_counts(reports.gap_report(items, gaps, ["p_partkey"]))


@query(f"with {SQL_FURNITURE} select p_partkey, category, type as name from placed where range is null")
def exclusion_report(t: Tables):
    out = reports.exclusions(_placed(t), "range", ["p_partkey", "category", "type"])
    return out.withColumnRenamed("type", "name")


@query(f"""
with {SQL_FURNITURE}, tax(range, main) as (values ('CH-NT', 'CH'), ('CH-LT', 'CH'), ('CH-MP', 'CH'), ('CH-MW', 'CH'), ('CB-WD', 'CB'), ('CB-ST', 'CB'), ('SH-WD', 'SH'),
  ('SH-ST', 'SH'), ('TB-WD', 'TB'), ('TB-ST', 'TB'), ('TB-WS', 'TB'), ('TB-MT', 'TB'), ('ST', 'ST'), ('PT', 'PT'), ('GR', 'GR'))
select tax.range, main, count(p_partkey)::bigint as n from tax left join placed on placed.range = tax.range group by 1, 2""")
def range_counts(t: Tables):
    taxonomy = t.spark.createDataFrame(list(classify.range_main_map().items()), "range string, main string")
    return reports.range_counts(_placed(t), taxonomy, "range").select("range", "main", "n")


@query(f"""
with {SQL_FURNITURE}, src as (select *, case when p_brand = 'Brand#5' then 'x/LOCKER/' || p_name when p_brand = 'Brand#6' then 'x/WOOD/' || p_name else p_name end as source from furniture)
select p_partkey,
  case when category in ('office-chairs', 'sofas') then null
    when type ilike '%steel%' then 'steel' when type ilike '%wood%' then 'wood'
    when upper(source) like '%/STEEL/%' or upper(source) like '%LOCKER%' then 'steel' when upper(source) like '%/WOOD/%' then 'wood'
    when spec ilike '%steel%' or type ilike '%locker%' then 'steel' end as material,
  (p_size * 10 >= 100 and p_size * 10 / 200.0 >= 0 and greatest(p_size * 10, 200) / least(p_size * 10, 200)::double <= 6
    and not (greatest(p_size * 10, 200) < 450 and greatest(p_size * 10, 200) / least(p_size * 10, 200)::double > 2)) as photo,
  case when p_size > 40 then p_size::bigint end as seats,
  coalesce(case category when 'sofas' then 'โซฟา' when 'desks' then 'โต๊ะทำงาน' when 'storage' then 'ตู้เก็บของ' when 'office-chairs' then 'เก้าอี้สำนักงาน'
    when 'partitions' then 'แผงกั้น' when 'meeting-tables' then 'โต๊ะประชุม' end, type) as label
from src""")
def material_chain(t: Tables):
    rows = _furniture(t)
    source = F.when(F.col("p_brand") == "Brand#5", F.concat(F.lit("x/LOCKER/"), "p_name")).when(
        F.col("p_brand") == "Brand#6", F.concat(F.lit("x/WOOD/"), "p_name")).otherwise(F.col("p_name"))
    seats = classify.seat_count(F.when(F.col("p_size") > 40, F.concat(F.col("p_name"), F.lit(" "), F.col("p_size"), F.lit("-seat"))).otherwise(F.col("p_name")))
    return rows.select(
        "p_partkey", classify.main_material(F.col("category"), F.col("type"), F.col("spec"), source).alias("material"),
        classify.is_photo(F.col("p_size") * 10, F.lit(200)).alias("photo"), seats.cast("long").alias("seats"),
        classify.type_label(F.col("category"), F.col("type")).alias("label"))


SUBCATEGORIES = {"SMALL": "stools", "LARGE": "desks"}
UNITS = {"Brand#3": "partitions"}
NAMES = [(r"RING", "bar"), (r"ROD|BOLT", "shelving")]


@query("""
select p_partkey, coalesce(case p_type when 'SMALL' then 'stools' when 'LARGE' then 'desks' end, case p_brand when 'Brand#3' then 'partitions' end,
  case when upper(p_name) like '%RING%' then 'bar' when upper(p_name) like '%ROD%' or upper(p_name) like '%BOLT%' then 'shelving' end) as category from part""")
def lookup_chain(t: Tables):
    return t.part.select("p_partkey", classify.web_category(F.col("p_type"), F.col("p_brand"), F.col("p_name"), SUBCATEGORIES, UNITS, NAMES).alias("category"))


@query(f"""
with {SQL_FLAGGED} select doc_id, case when list_has_any(flags, ['no-code', 'no-category', 'no-image', 'category-guessed']) then 'review' else 'published' end as status from flagged""")
def status_from_flags(t: Tables):
    return flagged_documents(t).select("doc_id", classify.status_of(F.col("flags")).alias("status"))


@query(f"""
with {SQL_FLAGGED}
select 'category' as section, coalesce(case lang when 'de' then null else lang end, '—') as value, count(*)::bigint as n from flagged group by 2
union all select 'brand', source, count(*)::bigint from flagged group by 2
union all select 'flag', flag, total from counted""")
def import_summary(t: Tables):
    rows = flagged_documents(t).withColumn("category", F.when(F.col("lang") != "de", F.col("lang")))
    return reports.import_summary(rows, "flags", "category", "source")


@query(f"select p_name, count(*)::bigint as n from (select p_name, {SQL_CATEGORY} as category from part) where category is null group by 1")
def unmapped_types(t: Tables):
    return reports.unmapped_types(_categorized(t), "category", "p_name")


# ---------------------------------------------------------------- languages

PHRASES = [("red", "rouge"), ("blue", "bleu"), ("hot rod", "bolide"), ("hot", "chaud"), ("rod", "tige"), ("ring", "anneau"), ("bolt", "boulon"), ("old", "")]
SOURCE_WORDS = "red|blue|hot|rod|ring|bolt|old|cold|small|large"


def _sql_phrases(column: str) -> str:
    out = column
    for source, target in sorted(PHRASES, key=lambda p: -len(p[0])):
        out = f"replace({out}, '{source}', ' {target} ')"
    return out


@query(rf"""
with r as (select p_partkey, p_name, {_sql_phrases('p_name')} as raw from part),
s as (select *, trim(regexp_replace(raw, '\s+', ' ', 'g')) as tidy from r)
select p_partkey, case when not regexp_matches(p_name, '{SOURCE_WORDS}') then p_name when regexp_matches(raw, '{SOURCE_WORDS}') then null
  else upper(tidy[1]) || substring(tidy, 2) end as translated from s""")
def phrase_translate(t: Tables):
    return t.part.select("p_partkey", language.translate_phrases(F.col("p_name"), PHRASES, SOURCE_WORDS).alias("translated"))


@query("""
select doc_id, case when lang = 'en' then 'en text' when lang = 'fr' then lang || ' text' else source end as value, not (lang in ('en', 'fr')) as fallback from documents""")
def language_pick(t: Tables):
    en = F.when(F.col("lang").isin("en", "fr"), F.concat_ws(" ", "lang", F.lit("text"))).when(F.col("lang") == "de", "")
    picked = language.pick_language(F.col("source"), en, "en")
    return t.documents.select("doc_id", picked["value"].alias("value"), picked["fallback"].alias("fallback"))


@query("""
with p as (select conv_id, turn, string_split(text, chr(10)) as th, list_transform(string_split(text, chr(10)), lambda x: case when length(x) > 40 then 'en ' || x end) as en from conversations),
z as (select conv_id, turn, list_filter(list_transform(range(1, len(th) + 1), lambda i: struct_pack(th := th[i], en := coalesce(en[i], ''))), lambda s: s.th <> '') as pairs,
  list_filter(list_transform(range(1, len(th) + 1), lambda i: coalesce(nullif(en[i], ''), th[i])), lambda v: v <> '' and not contains(v, 'ISO 9001'))[1:5] as features from p)
select conv_id, turn, len(pairs)::bigint as pairs, array_to_string(list_transform(pairs, lambda s: s.th || '=' || s.en), '|') as aligned, array_to_string(features, '|') as features from z""")
def paired_arrays(t: Tables):
    th = F.split("text", "\n")
    en = F.transform(th, lambda v: F.when(F.length(v) > 40, F.concat(F.lit("en "), v)))
    pairs = language.align_pairs(F.col("th"), F.col("en"))
    shown = F.array_join(F.transform(pairs, lambda p: F.concat(p["th"], F.lit("="), p["en"])), "|")
    return t.conversations.withColumns({"th": th, "en": en}).select(
        "conv_id", "turn", F.size(pairs).cast("long").alias("pairs"), shown.alias("aligned"),
        F.array_join(language.pick_features(F.col("th"), F.col("en")), "|").alias("features"))


# ---------------------------------------------------------------- preferred rows

@query("""
select p_name as key, arg_min(p_partkey, struct_pack(a := p_size < 20, b := p_partkey)) as pictured, arg_max(p_brand, p_partkey) as last_brand,
  arg_min(p_partkey, struct_pack(a := p_size > 25, b := p_partkey)) filter (where p_size >= 20) as hero from part group by 1""")
def first_preferred(t: Tables):
    rows = t.part.withColumn("image", F.when(F.col("p_size") >= 20, F.col("p_brand"))).withColumn("rendered", F.col("p_size") > 25)
    pictured = classify.first_pictured_per_code(rows, "p_name", "image", "p_partkey").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("pictured"))
    last = identity.last_per_key(rows, ["p_name"], "p_partkey", ["p_brand"]).select(F.col("p_name").alias("key"), F.col("p_brand").alias("last_brand"))
    hero = identity.pick_hero(rows, "p_name", "image", "rendered", "p_partkey", ["p_partkey"]).select(F.col("p_name").alias("key"), F.col("p_partkey").alias("hero"))
    return pictured.join(last, "key").join(hero, "key", "left")


@query("""
select l_orderkey, l_partkey, l_linenumber::bigint as l_linenumber, l_suppkey, l_shipdate, l_extendedprice, (row_number() over (partition by l_orderkey order by case when rn = 1 then 0 else 1 end,
  l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1)::bigint as sort from (
  select *, row_number() over (partition by l_orderkey order by -l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_shipdate) as rn from lineitem)""")
def hero_order(t: Tables):
    rows = t.lineitem.withColumn("ordinal", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    out = identity.hero_first(rows, "l_orderkey", "ordinal", F.col("l_extendedprice"))
    return out.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long"), "l_suppkey", "l_shipdate", "l_extendedprice", F.col("sort").cast("long"))


@query("""
select r, doc_id from (select doc_id, row_number() over (order by case when key = '' then '~' else key end, source, doc_id)::bigint as r from (
  select doc_id, source, regexp_replace(upper(source), '[^A-Z0-9]', '', 'g') as key from documents))""")
def code_index(t: Tables):
    key = textclean.search_key(F.col("source"))
    rows = t.documents.select("doc_id", "source", code_order(key).alias("k"))
    return ordered.number_rows(rows, [], ["k", "source", "doc_id"], "r").select("r", "doc_id")
