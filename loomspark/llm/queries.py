"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import decontamination, url_filter
from loomspark.llm.erasure import cascade, digests, erased_tables
from loomspark.llm.exact_dedup import exact_groups
from loomspark.llm.hard_negatives import mine, prepared
from loomspark.llm.language_id import identify, learn
from loomspark.llm.mixing import assign, in_training_order
from loomspark.llm.ngram_join import classes_of_links
from loomspark.llm.page_text import main_text
from loomspark.llm.pii import KINDS, find_pii
from loomspark.llm.quality import fit, score
from loomspark.llm.secret_scan import find_secrets
from loomspark.llm.substring_dedup import repeated_spans
from loomspark.llm.url_filter import PATTERN_RULES, host_path_rule, judge_urls

URL_RULES = tuple(host_path_rule(t, a) for t, a in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: SQL for the queries that DuckDB can express and answer over whole tables.
ORACLES: dict[str, str] = {}

_WORDS = r"[^\x20\x09-\x0D]+"
ORACLES["op4_url_filter"] = r"""
with u as (select page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
 r(rule, h, p, verdict) as (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
 f as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1)
select page_id, host, path, rule, coalesce(verdict, case when
  regexp_matches(l, '(?s)^([^#]*[.-])?((JUNK)[0-9]|(JUNK)-?(LURES)|(LURES)-?(JUNK))[0-9]*([.-][^#]*)?#') or regexp_matches(l, '(?s)^([^#]*[.-])?(JUNK)([.-][^#]*)?#/(.*/)?(ACTS)([/._-].*)?$')
  or regexp_matches(l, '(?s)#(.*/)?(PUSHES)[-_](LURES)[-_](JUNK)([/._-].*)?$') or regexp_matches(l, '(?s)^([^#]*[.])?(AD_HOSTS)[0-9]*[.][^#]*#/(.*/)?(AD_PATHS)([/._-].*)?$')
  or regexp_matches(l, '(?s)#.*/wp-(admin|login|json|cron)([/.].*)?$') or regexp_matches(l, '(?s)#(.*/)?cgi-bin/') or regexp_matches(l, '(?s)#(.*/)?calendar/[0-9]{4}([/-][0-9]{1,2}){1,2}/?$')
  or regexp_matches(l, '(?s)#(.*/)?page/[0-9]{3,}/?$') or regexp_matches(l, '(?s)#.*;jsessionid=[0-9a-f]+') or regexp_matches(l, '(?s)#(.*/)?((feed|rss|atom)[.]xml|(blog|comments|posts)/feed/?)$')
  or regexp_matches(l, '(?s)#(.*/)?tag/[^/]+/page/[0-9]+/?$') or regexp_matches(l, '(?s)#(.*/)?(cart|checkout|basket)/(add|item|step)([^a-z].*)?$') or regexp_matches(l, '^[0-9]+([.][0-9]+){3}(:[0-9]+)?#')
  then 'block' else 'allow' end) as verdict
from (select *, host || '#' || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as l from u) left join f using (page_id)"""
for _name in ("AD_HOSTS", "AD_PATHS", "JUNK", "LURES", "ACTS", "PUSHES"):
    ORACLES["op4_url_filter"] = ORACLES["op4_url_filter"].replace(f"({_name})", f"({'|'.join(getattr(url_filter, _name))})")
ORACLES["op5_ngram_join"] = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') as w from documents),
 s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) when len(w) > 0 then [list_aggregate(w, 'string_agg', ' ')] else [] end) as s from w),
 x as (select doc_id, len(s) as n, unnest(s) as g from s),
 pairs as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id <> b.doc_id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by 1, 2, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 reach(doc_id, seen) as (select doc_id, doc_id from s union select p.b, r.seen from reach r join pairs p on p.a = r.doc_id)
select doc_id, len(s)::bigint as n_shingles, c.component_id from s join (select doc_id, min(seen) as component_id from reach group by 1) c using (doc_id)"""
ORACLES["op6_exact_dedup"] = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))"""
ORACLES["op8_source_mixing"] = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::bigint as size from documents),
 s as (select source, sum(size)::bigint as source_size, 3.0::double * sum(size) as most, [5.0::double, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w, row_number() over (order by source nulls last) as rank from d group by source),
 l as (select *, (sum(source_size) over () - coalesce(sum(most) over f, 0)) / (sum(w) over () - coalesce(sum(w) over f, 0)) as level from s window f as (order by most / w, rank rows between unbounded preceding and 1 preceding)),
 t as (select source, rank, source_size, least(most, w * coalesce((select level from l where level <= most / w order by most / w, rank limit 1), 'infinity'::double)) as target from l),
 o as (select d.*, t.rank, t.source_size, t.target, round(target)::bigint as demand, coalesce(sum(size) over (partition by d.source order by md5(doc_id::varchar), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start from d join t on d.source is not distinct from t.source),
 k as (select *, case when source_size > 0 then demand // source_size else 0 end as whole from o),
 g as (select *, greatest(0, least(demand - whole * source_size - start, size)) as part, start / demand as share from k)
select doc_id, size, source_size, target, whole * size + part as taken, case when size > 0 then whole + (part > 0)::bigint else 0 end as copies,
 case when whole * size + part > 0 then round(case (rank - 1) % 3
   when 0 then 1.5 - sqrt(2.25 - 2 * share)
   when 1 then share
   else case when share < 0.3125 then sqrt(1 + 4 * share) - 1 else 0.5 + (sqrt(0.5625 + 5 * (share - 0.3125)) - 0.75) / 2.5 end end, 9) end as first_time from g"""

ORACLES["op13_hard_negatives"] = """
with v as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, x -> floor(256 * x::double)) as e from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, x -> x is not null and isfinite(x))) = len(embedding)),
 s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
 p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
 n as (select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id)::int as rank
       from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = learn(docs.filter(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count("base", k) for k in ("assign", "access", "hex")], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", (F.length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES + PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of_links(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select("doc_id", "quality_score", "weak_label", "quality_keep")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = in_training_order(assign(_table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("first_time", 9).alias("first_time"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count("base", k) for k in KINDS], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_templates")


def op12_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, clicks, sales, lines = (_table(spark, sf_dir, t) for t in ("clients", "clicks", "sales", "sale_lines"))
    files = erased_tables(spark, cascade(clients, clicks, sales, lines), size_of=lambda n: 1 + n // 150)
    amounts = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
    return digests(files, amounts).select("file_no", "n_rows", "n_erased", "cents", "rewritten", "table_name", "ids_sha256", "columns", "path")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prepared(_table(spark, sf_dir, "embeddings"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(vectors, vectors.filter("id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_secret_scan, op3_substring_dedup, op4_url_filter, op5_ngram_join, op6_exact_dedup, op7_quality_classifier, op8_source_mixing, op9_decontamination, op10_pii, op11_page_text, op12_erasure, op13_hard_negatives)
}
