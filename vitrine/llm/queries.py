"""The operators over the given tables: each query maps table columns to crawled pages and results back."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import (byte_bpe, decontaminate, exact_dedup, host_reputation, language_id, ngram_join, packing, piece_encoding,
                         quality_ranking, source_divergence, token_counts, toxic_neighbours, whitening)

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def pages_of(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """``documents`` as crawled pages: doc_id is the url."""
    return spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("url"), "text", *more)


def fold(key: str, n: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


RULES = [host_reputation.Rule("com/", "allow"), host_reputation.Rule("example.com/en/", "block"),
         host_reputation.Rule("www.example.com/en/", "allow"), host_reputation.Rule("net/es/", "block"),
         host_reputation.Rule("net/fr/", "block")]


def url_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A page's url ends in the number of the document it shows; that document's quality label is its outcome."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("url")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("usable"))
    number = F.regexp_extract(host_reputation.path_of(F.col("url")), r"^/[a-z]+/(\d{1,18})", 1).try_cast("long")
    return pages.withColumn("doc_id", number).join(labels, "doc_id").select("url", "usable")


_HOST_PARTS = """
  case when array_to_string(string_split(host, '.')[-2:], '.') in ('co.th', 'in.th', 'or.th', 'ac.th', 'go.th', 'co.uk', 'com.au', 'co.jp')
    then array_to_string(string_split(host, '.')[-2:], '.') else string_split(host, '.')[-1] end as suffix,
  case when array_to_string(string_split(host, '.')[-2:], '.') in ('co.th', 'in.th', 'or.th', 'ac.th', 'go.th', 'co.uk', 'com.au', 'co.jp')
    then array_to_string(string_split(host, '.')[-3:], '.') else array_to_string(string_split(host, '.')[-2:], '.') end as domain"""
_STRENGTH = """(select case when count(*) - count(distinct m) < 2 then 2.0 when not sum((n - 1) * m * (1 - m)) > 0 then 1000.0
    when sum(n * (good / n - m) ** 2) <= sum(m * (1 - m)) then 1000.0
    else least(1000.0, greatest(2.0, sum((n - 1) * m * (1 - m)) / (sum(n * (good / n - m) ** 2) - sum(m * (1 - m))) - 1)) end as k from """
_BOUND = "round(round(least(1.0, a / (a + b) + 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))), 9), 6)"


def _rule_sql(field: str) -> str:
    """The rules as CASE, longest prefix first."""
    tests = []
    for rule in sorted(RULES, key=lambda r: -len(r.prefix)):
        name, slash, rest = rule.prefix.partition("/")
        tests.append(f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash + rest}') then '{getattr(rule, field)}'")
    return "case " + " ".join(tests) + " end"


@query(f"""
with cut as (select page_id, url, strpos(url, '://') as found, substr(url, strpos(url, '://') + 3) as rest from pages),
p as (select page_id, case when found > 0 then translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
  case when found > 0 then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path from cut),
o as (select host, quality from p join labels l on l.doc_id = try_cast(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1) as bigint) where quality is not null and host <> ''),
h0 as (select host, count(*)::double as n, sum(quality)::double as good, {_HOST_PARTS} from o group by host),
d0 as (select domain, suffix, sum(n) as n, sum(good) as good from h0 group by all),
s0 as (select suffix, sum(n) as n, sum(good) as good from d0 group by all),
t as (select (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) as m from s0),
s1 as (select s0.*, m from s0, t), ks as {_STRENGTH} s1),
s2 as (select s1.*, (good + k * m) / (n + k) as rate from s1, ks),
d1 as (select d0.*, s2.rate as m from d0 join s2 using (suffix)), kd as {_STRENGTH} d1),
d2 as (select d1.*, (good + k * m) / (n + k) as rate from d1, kd),
h1 as (select h0.*, d2.rate as m from h0 join d2 using (domain)), kh as {_STRENGTH} h1),
ab as (select 'host' as level, host as name, good + k * m as a, n - good + k * (1 - m) as b from h1, kh
  union all select 'domain', domain, k * rate, k * (1 - rate) from d2, kh union all select 'suffix', suffix, k * rate, k * (1 - rate) from s2, kd
  union all select 'all', '', k * m, k * (1 - m) from t, ks),
bounds as (select level, name, {_BOUND} as bound from ab),
named as (select *, {_HOST_PARTS} from p),
judged as (select page_id, host, path, {_rule_sql("prefix")} as rule, {_rule_sql("verdict")} as ruled,
  coalesce(bh.bound, bd.bound, bs.bound, (select bound from bounds where level = 'all')) as usable_bound from named
  left join bounds bh on bh.level = 'host' and bh.name = host left join bounds bd on bd.level = 'domain' and bd.name = domain
  left join bounds bs on bs.level = 'suffix' and bs.name = suffix)
select page_id, host, path, rule, coalesce(ruled, case when usable_bound < 0.5 then 'block' else 'allow' end) as verdict, usable_bound from judged""")
def op1_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(F.col("page_id").alias("key"), "url")
    judged = host_reputation.judge_urls(pages, url_outcomes(spark, folder), RULES)
    return judged.select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict", F.round("usable_bound", 6).alias("usable_bound"))


@query()
def op2_toxic_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(fold("doc_id", 4) != 2)
    status = F.when(F.col("toxic") == 1, "hidden").when(F.col("toxic") == 0, "published")
    model = toxic_neighbours.fit_examples(pages_of(spark, folder), labels.select(F.col("doc_id").alias("url"), status.alias("status")))
    found = toxic_neighbours.score_pages(pages_of(spark, folder), model)
    return found.select(F.col("url").alias("doc_id"), (fold("url", 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"),
                        F.transform("neighbours", lambda e: e["url"]).alias("neighbours"), F.transform("evidence", lambda e: e["url"]).alias("evidence"))


@query()
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_pages(pages_of(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed.select("shard", "row", "n_tokens", "ids", F.col("urls").alias("doc_ids"), "pieces", "cu_lengths", "position_resets")


@query()
def op4_language_backoff(spark: SparkSession, folder: str) -> DataFrame:
    model = language_id.fit_languages(pages_of(spark, folder, "lang").filter(fold("url", 4) != 2))
    found = language_id.identify_languages(pages_of(spark, folder), model)
    return found.select(F.col("url").alias("doc_id"), (fold("url", 4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op5_resync_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(pages_of(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select(F.col("url").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query()
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_pages(pages_of(spark, folder), ranks, pattern, offsets=True)
    narrow = encoded.select("url", "ids", "n_tokens", F.xxhash64("starts", "ends").alias("offsets_hash"))
    return byte_bpe.decode_pages(narrow, ranks, pattern).select(
        F.col("url").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "offsets_hash")


@query()
def op7_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("slug"), "text")
    found = decontaminate.contaminated(pages_of(spark, folder), items)
    return found.select(F.col("url").alias("doc_id"), F.col("slug").alias("item_id"), "windows", "share", "verbatim",
                        F.col("first").alias("first_token"), F.col("last").alias("last_token"))


@query()
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(pages_of(spark, folder)).select(
        F.col("url").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("""
with keyed as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) text_sha256 from documents),
     grouped as (select *, max(doc_id) over (partition by text_sha256) keep_id, count(*) over (partition by text_sha256) group_size from keyed)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from grouped""")
def op9_stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.dedup_pages(pages_of(spark, folder))
    return found.select(F.col("url").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept",
                        F.col("digest").alias("text_sha256"))


@query()
def op10_pairwise_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(fold("doc_id", 3) != 1)
    status = F.when(F.col("quality") == 1, "published").when(F.col("quality") == 0, "review")
    ranking = quality_ranking.fit_ranking(pages_of(spark, folder), labels.select(F.col("doc_id").alias("url"), status.alias("status")))
    found = quality_ranking.rank_pages(pages_of(spark, folder), ranking)
    return found.select(F.col("url").alias("doc_id"), (fold("url", 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op13_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = piece_encoding.decode_pages(piece_encoding.encode_pages(pages_of(spark, folder), model), model)
    return decoded.select(F.col("url").alias("doc_id"), "n_tokens",
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select lang, source, id, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct id) as docs from t group by all),
k as (select lang, term, sum(n) as whole from c group by all having sum(docs) >= 30),
v as (select lang, count(*) as v, sum(whole) as n from k group by all),
g as (select distinct lang, source from d),
dense as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.whole from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
total as (select lang, source, sum(n) as total from dense group by all),
p as (select lang, source, term, dense.n, 1 + (1000000000::hugeint * (dense.n + 5)) // (total + 5 * v) as p, 1 + (1000000000::hugeint * (whole + 5)) // (v.n + 5 * v) as q
  from dense join total using (lang, source) join v using (lang)),
pair as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
rows as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from rows) where part = 'pair' or rank <= 50""")
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audit_sources(spark.read.parquet(f"{folder}/documents.parquet"))


@query()
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    images = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding")
    found = whitening.whiten_images(images)
    return found.select("image_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("image_id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.col("explained")[F.col("at")].alias("explained"), "identity_error")
