"""Queries for single steps of the import: cleaning, labels, flags, spelling, lines of a page."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import glossary, language, textclean
from vitrine.operators import classify, extract, identity, merge, segment, spelling
from vitrine.plans.tables import Tables, query

# Letters of the documents in the script that the cleaning steps are for: four marks, sara aa, sara am, and consonants.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SCRIPT_LETTERS = "\u0e32" + "".join(chr(0x0E01 + i) for i in range(6)) + "\u0e48" + "".join(chr(0x0E10 + i) for i in range(1)) + "\u0e4d" + "".join(
    chr(0x0E14 + i) for i in range(10)) + "\u0e49" + "".join(chr(0x0E22 + i) for i in range(3)) + "\u0e33" + "\u0e2a"
MARKS = textclean.TONE_MARKS


def in_script(text: Column) -> Column:
    return F.translate(F.lower(text), LETTERS, SCRIPT_LETTERS)


def _sql_script(text: str) -> str:
    return f"translate({text}, '{LETTERS}', '{SCRIPT_LETTERS}')"


_SQL_AM = "regexp_replace(replace({0}, '\u0e4d\u0e32', '\u0e33'), '\u0e4d([\u0e48-\u0e4b])\u0e32', '\\1\u0e33', 'g')"


@query(f"""
with t as (select doc_id, regexp_replace(lower(text), '[^a-z]+', '', 'g') as letters, trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]+', '', 'g'), ' +', ' ', 'g')) as words from documents),
s as (select doc_id, {_sql_script("letters")} as script, length(letters) as n, {_sql_script("words")} as words from t)
select doc_id, case when n < 2 then translate(script, '{textclean.THAI_FORM}', '{textclean.LATIN_FORM}') else {_SQL_AM.format("script")} end || ' \u00b5m' as repaired,
  replace(translate(words, '\u0e33{MARKS}', '\u0e32'), ' ', '') as skeleton, regexp_replace(script, '[^{MARKS}]', '', 'g') as tones,
  replace(replace(words, ' ', ''), '\u0e4d\u0e32', '\u0e33') as spaced from s""")
def repaired_texts(t: Tables):
    """Each document's letters read in the wrong code page, and its words with spaces."""
    lower = F.lower("text")
    letters = in_script(F.regexp_replace(lower, "[^a-z]+", ""))
    words = in_script(F.trim(F.regexp_replace(F.regexp_replace(lower, "[^a-z ]+", ""), " +", " ")))
    damaged = F.concat(F.translate(letters, textclean.THAI_FORM, textclean.LATIN_FORM), F.lit(" \u03bcm"))
    return t.dealt("documents", "doc_id").select("doc_id", textclean.normalize(damaged).alias("repaired"), textclean.skeleton(words).alias("skeleton"),
                              textclean.tone_sequence(letters).alias("tones"), textclean.fix_thai_spacing(words).alias("spaced"))


@query("""
with c as (select r_name as slug, null as parent, r_regionkey::bigint as id from region union all select n_name || '-' || n_nationkey, r_name, n_nationkey::bigint + 100 from nation join region on n_regionkey = r_regionkey)
select c.slug, c.id, p.id as parent_id from c left join c p on c.parent = p.slug""")
def resolved_parents(t: Tables):
    roots = t.region.select(F.col("r_name").alias("slug"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("id"))
    leaves = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws("-", "n_name", "n_nationkey").alias("slug"), F.col("r_name").alias("parent"), (F.col("n_nationkey").cast("long") + 100).alias("id"))
    return merge.resolve_parents(roots.unionByName(leaves)).select("slug", "id", "parent_id")


@query("""
select p_partkey, array_to_string(list_filter([case when p_size < 10 then 'no-code' end, case when p_retailprice < 1000 then 'no-dimensions' end,
  case when p_type = 'PROMO' then 'no-category' end, case when p_size % 3 = 0 then 'dims-fixed' end, case when p_size % 2 = 0 then 'dims-suspect' end], lambda x: x is not null), ',') as flags from part""")
def quality_flag_sets(t: Tables):
    size_flags = F.array(F.when(F.col("p_size") % 2 == 0, "dims-suspect"), F.when(F.col("p_size") % 3 == 0, "dims-fixed"))
    found = classify.quality_flags(F.when(F.col("p_size") >= 10, F.col("p_name")).otherwise(""), F.when(F.col("p_retailprice") >= 1000, F.col("p_size")),
                                   F.when(F.col("p_type") != "PROMO", F.col("p_type")), size_flags)
    return t.part.select("p_partkey", F.array_join(found, ",").alias("flags"))


def _glossary_sql(words: str) -> str:
    return f"""g as (select list(row(w, ' ' || upper(w) || ' ') order by length(w) desc, w) as phrases from ({words}))"""


@query(f"""
with {_glossary_sql("select distinct unnest(string_split_regex(lower(text), '[^a-z]+')) as w from benchmark")},
p as (select list_filter(phrases, lambda x: x[1] <> '') as phrases from g)
select doc_id, list_reduce(phrases, lambda t, x: row(replace(t[1], x[1], x[2]), ''), row(lower(text), ''))[1] as replaced from documents, p""")
def glossary_texts(t: Tables):
    """All documents after a glossary of all words of the benchmark, longest first."""
    words = spelling.words(t.benchmark, "text", [], split="[^a-z]+").distinct()
    phrases = [(r["token"], r["token"].upper()) for r in words.orderBy("token").collect()]  # a glossary, here as long as the benchmark's vocabulary
    return t.dealt("documents", "doc_id").select("doc_id", glossary.replaced_phrases(F.lower("text"), phrases).alias("replaced"))


LABELS_TH = {"โครงขา": "Leg frame", "สี": "Colour"}
LABELS_EN = {"leg frame": "โครงขา", "colour": "สี"}


@query("""
with l as (select p_partkey, p_size, p_name, case p_size % 4 when 0 then 'โครงขา' when 1 then 'สี' when 2 then 'ขนาด' else p_name end as th,
  case p_size % 3 when 0 then ' Leg Frame: ' when 1 then 'COLOUR' else p_name end as en from part)
select p_partkey, case p_size % 4 when 0 then 'Leg frame' when 1 then 'Colour' when 2 then null else p_name end as english,
  case p_size % 3 when 0 then 'โครงขา' when 1 then 'สี' else trim(p_name) end as source from l""")
def translated_labels(t: Tables):
    n = F.col("p_size")
    th = F.when(n % 4 == 0, "โครงขา").when(n % 4 == 1, "สี").when(n % 4 == 2, "ขนาด").otherwise(F.col("p_name"))
    en = F.when(n % 3 == 0, " Leg Frame: ").when(n % 3 == 1, "COLOUR").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", language.translate_label(th, LABELS_TH, [("โต๊ะ", "table")]).alias("english"), language.reverse_label(en, LABELS_EN).alias("source"))


@query("""
select p_name as label, arg_max(p_type, p_partkey) as meaning from part group by 1""")
def dictionary_labels(t: Tables):
    return identity.last_per_key(t.part, ["p_name"], "p_partkey", ["p_type"]).select(F.col("p_name").alias("label"), F.col("p_type").alias("meaning"))


STUFF = [("anvil|bolt", "steel"), ("red|hot", "wood"), ("g[ei]", "glass")]


@query("""
select p_partkey, array_to_string(list_filter([case when regexp_matches(p_name, '(?i)anvil|bolt') then 'steel' end, case when regexp_matches(p_name, '(?i)red|hot') then 'wood' end,
  case when regexp_matches(p_name, '(?i)g[ei]') then 'glass' end], lambda x: x is not null), ',') as materials from part""")
def material_sets(t: Tables):
    return t.part.select("p_partkey", F.array_join(classify.materials(F.col("p_name"), STUFF), ",").alias("materials"))


@query(f"""
with w as (select {_sql_script("word")} as word, count(*) as freq from (select unnest(string_split_regex(lower(text), '[^a-z]+')) as word from documents) where word <> '' group by 1),
d as (select *, replace(translate(word, '\u0e33{MARKS}', '\u0e32'), ' ', '') as skeleton, translate(word, '{MARKS}', '') as token from w),
tokens as (select distinct token, replace(token, '\u0e33', '\u0e32') as skeleton from d),
c as (select t.token, coalesce(d.word, t.token) as word, coalesce(d.freq, 0) as freq from tokens t left join (select * from d where length(word) between 1 and 24) d using (skeleton)),
s as (select *, length(regexp_replace(word, '[^\u0e33]', '', 'g')) <> length(regexp_replace(token, '[^\u0e33]', '', 'g')) as vowels, length(regexp_replace(word, '[^{MARKS}]', '', 'g')) as marks from c)
select token, arg_min(word, row(vowels, word <> token, -freq, marks, word)) as spelling from s group by token""")
def repair_words(t: Tables):
    """All words of the documents without their marks, spelled again by a dictionary of these words."""
    words = spelling.word_frequency(spelling.words(t.documents, "text", [], split="[^a-z]+").select(in_script(F.col("token")).alias("token")))
    damaged = words.select(F.translate("token", MARKS, "").alias("token"))
    index = spelling.dictionary_index(words.select(F.col("token").alias("word")))
    return spelling.choose_spelling(damaged, index, words)


def _benchmark_words(t: Tables):
    return spelling.words(t.benchmark, "text", [], split="[^a-z]+").select(in_script(F.col("token")).alias("word"))


def _unspaced(t: Tables):
    """Each document as one line in the script, without spaces: runs end at other characters only."""
    return t.dealt("documents", "doc_id").select("doc_id", F.replace(in_script(F.col("text")), F.lit(" "), F.lit("")).alias("line"))


@query()
def segmented_words(t: Tables):
    """Words that the cheapest cut of all documents without spaces is made of, by the words of the benchmark; letters outside words under the empty one."""
    pages = _unspaced(t).select("doc_id", F.array("line").alias("lines"))
    dictionary = _benchmark_words(t).distinct()
    costs = segment.with_costs(dictionary, segment.word_contexts(_unspaced(t), "line", segment.dictionary_words(dictionary)))
    parts = segment.cut_lines(pages, ["doc_id"], "lines", costs).select(F.explode("parts.skeleton").alias("skeleton"))
    return parts.groupBy(F.coalesce("skeleton", F.lit("")).alias("skeleton")).agg(F.count(F.lit(1)).alias("parts"))


@query()
def unknown_letters(t: Tables):
    """Share of each document, without its spaces, that no cut into words of the benchmark covers."""
    return segment.unknown_share(_unspaced(t), ["doc_id"], "line", _benchmark_words(t)).withColumn("unknown_ratio", F.round("unknown_ratio", 6))


@query()
def mended_pages(t: Tables):
    """All documents without their marks and with a space after every fifth letter, repaired by the words of the benchmark and the contexts of the documents."""
    whole = in_script(F.col("text"))
    damaged = F.regexp_replace(F.translate(whole, MARKS, ""), "([\u0e00-\u0e7f]{5})", "$1 ")
    pages = t.dealt("documents", "doc_id").select("doc_id", F.split(damaged, "\n").alias("lines"))
    trusted = t.dealt("documents", "doc_id").select(whole.alias("text"))
    out = segment.repair_pages(pages, ["doc_id"], "lines", _benchmark_words(t), trusted)
    return out.select("doc_id", F.array_join("lines", "\n").alias("text"))


WORDS_PER_PAGE, WORDS_PER_LINE = 400, 8


@query(f"""
with w as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as n from documents)
select doc_id, n // {WORDS_PER_PAGE} as page, (n % {WORDS_PER_PAGE}) // {WORDS_PER_LINE} as line, string_agg(word, ' ' order by n) as text, count(*) as words from w group by all""")
def page_lines(t: Tables):
    """Words of a document set on pages of 50 lines that are not quite straight."""
    at = F.col("n") % WORDS_PER_PAGE
    column, row = at % WORDS_PER_LINE, F.floor(at / WORDS_PER_LINE)
    words = t.dealt("documents", "doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "text")).select(
        "doc_id", F.floor(F.col("n") / WORDS_PER_PAGE).alias("page"), "text", (column * 60).cast("int").alias("x0"), (column * 60 + 50).cast("int").alias("x1"),
        (row * 20 + column % 3).cast("int").alias("y0"), (row * 20 + column % 3 + 12).cast("int").alias("y1"))
    lines = extract.word_lines(words, ["doc_id", "page"])
    return lines.select("doc_id", "page", F.col("band").cast("long").alias("line"), "text", F.size("words").cast("long").alias("words"))


PAGE_W, PAGE_H = 1000, 1100
_SQL_BOXES = f"""
w as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as n from documents),
b as (select doc_id, n // {WORDS_PER_PAGE} as page, n % {WORDS_PER_LINE} as col, (n % {WORDS_PER_PAGE}) // {WORDS_PER_LINE} as line, word, n from w),
l as (select doc_id, page, n, col * 120 as x0, col * 120 + 100 as x1, line * 50 + col % 3 as y0, line * 50 + col % 3 + 12 as y1, word,
  case when n % 5 = 0 then 'C-' || (n % 90 + 10) end as code, case when n % 5 = 3 then 'W600*D450*H' || (700 + n % 100) end as size from b)"""


def _boxes(t: Tables):
    """Words of a document set on pages of 50 rows and 8 columns; every fifth begins a code line, every fifth is a size line."""
    n, at = F.col("n"), F.col("n") % WORDS_PER_PAGE
    column, row = at % WORDS_PER_LINE, F.floor(at / WORDS_PER_LINE)
    code, size = F.concat(F.lit("C-"), n % 90 + 10), F.concat(F.lit("W600*D450*H"), n % 100 + 700)
    words = F.when(n % 5 == 0, F.array(code, F.col("word"))).when(n % 5 == 3, F.array(size)).otherwise(F.array("word"))
    rows = t.dealt("documents", "doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "word"))
    out = rows.select("doc_id", F.floor(n / WORDS_PER_PAGE).alias("page"), F.lit(PAGE_W).alias("page_w"), F.lit(PAGE_H).alias("page_h"), "n", words.alias("words"),
                      (column * 120).cast("int").alias("x0"), (column * 120 + 100).cast("int").alias("x1"), (row * 50 + column % 3).cast("int").alias("y0"),
                      (row * 50 + column % 3 + 12).cast("int").alias("y1"))
    return out.withColumn("text", F.array_join("words", " "))


@query(f"""
with {_SQL_BOXES},
s as (select * from l where size is not null), c as (select * from l where code is not null),
j as (select s.doc_id, s.page, s.n, s.size, arg_max(c.code, struct_pack(a := c.y1, b := -c.x0)) as code from s join c on s.doc_id = c.doc_id and s.page = c.page
  and c.y1 <= s.y0 + 4 and s.y0 - c.y1 < {PAGE_H} * 0.05 and c.x0 < s.x1 and c.x1 > s.x0 - {PAGE_W} * 0.02 group by all)
select doc_id, page, size as size_text, code, count(*) as lines from j group by all""")
def nearest_code(t: Tables):
    """The code line above each size line of all pages, by size and code."""
    found = extract.nearest_code_above(_boxes(t), ["doc_id", "page"], "page_w", "page_h", F.col("text").rlike("^W600"))
    return found.groupBy("doc_id", "page", "size_text", "code").agg(F.count(F.lit(1)).alias("lines"))


@query(f"""
with {_SQL_BOXES},
c as (select *, case when y0 - lag(y0) over (partition by doc_id, page order by y0, x0) >= {PAGE_H} * 0.04 then 1 else 0 end as jump from l where code is not null),
r as (select *, sum(jump) over (partition by doc_id, page order by y0, x0 rows unbounded preceding) as row from c)
select doc_id, n::bigint as n, greatest(0, x0 - {PAGE_W * 3 // 100}, lag(x0) over w + {PAGE_W * 5 // 100})::int as "left",
  least({PAGE_W}, coalesce(lead(x0) over w - {PAGE_W * 15 // 1000}, least({PAGE_W}, x0 + {PAGE_W * 34 // 100})))::int as "right"
from r window w as (partition by doc_id, page, row order by x0, y0)""")
def column_neighbours(t: Tables):
    """Bounds of each code line of all pages, between its neighbours in the row."""
    out = extract.column_spans(_boxes(t).filter(F.col("n") % 5 == 0), ["doc_id", "page"], "page_w", "page_h")
    return out.select("doc_id", F.col("n").cast("long"), "left", "right")
