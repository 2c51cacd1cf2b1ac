"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chat_format import format_chat, read_back
from tessera.llm.license_scan import license_scan
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.packing import best_fit_packing
from tessera.llm.periodic_runs import highest_exponent, periodic_runs, with_planted_runs
from tessera.llm.quality_classifier import quality_classifier
from tessera.llm.quality_rules import quality_rules
from tessera.llm.secret_scan import BASE_RULES, secret_spans, written
from tessera.llm.suffix_dedup import suffix_array_dedup
from tessera.llm.token_alignment import align_tokenizers
from tessera.llm.topk import exact_top_k

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_documents(spark, sf_dir), tokenizer_path())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_documents(spark, sf_dir))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), F.round("p_good", 6).alias("p_good"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(_documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_RULES))

    def n_of(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == k)).cast("long")

    n = [n_of(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *n, F.sha2(F.encode(written(base), "UTF-8"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(_documents(spark, sf_dir))).withColumn("top", highest_exponent(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokenizers(_documents(spark, sf_dir), tokenizer_path(), tokenizer_path(PIECES))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(told.unionByName(own)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_quality_rules, op3_ngram_jaccard_join, op4_quality_classifier, op5_exact_top_k,
        op6_mix_sources, op7_suffix_array_dedup, op8_line_dedup, op9_license_scan, op10_secret_scan,
        op11_periodic_runs, op12_token_alignment, op13_chat_format,
    )
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": rf"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as grams from w),
n as (select doc_id, len(grams)::bigint as n_shingles from s),
g as (select doc_id, unnest(grams) as gram from s),
rare as (select gram from g group by gram having count(*) > 1),
h as (select g.doc_id, g.gram from g semi join rare using (gram)),
p as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared from h a join h b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
l as (
  select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y
  where 100 * shared >= 80 * (a.n_shingles + b.n_shingles - shared)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as x, doc_id as y from n union select r.x, e.y from r join e on r.y = e.x)
select n.doc_id, n.n_shingles, c.component_id from n join (select x, min(y) as component_id from r group by x) c on c.x = n.doc_id""",
    "op5_exact_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5""",
    "op8_line_dedup": rf"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (select *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') as key from l),
f as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, k.line, k.i, f.last is not null and k.doc_id < f.last as gone from k left join f using (key))
select doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from m group by doc_id""",
    "op11_periodic_runs": rf"""
with t as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
h as (select *, len(w)::bigint as n, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda s, c: list_reduce(range(0, 8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(s, c)), 4294967295::bigint), 4294967295) as h from t),
c as (select r, doc_id, w, n, h % 10 = 0 and n > 0 as planted, (h // 10) % greatest(n, 1) as a, h // 10 as g from h),
b as (select *, 1 + (n - a) // (3 + g % 8) as p from c),
d as (select r, doc_id, n, case when planted then list_transform(range(0, n), lambda i: w[(case when i < a then i else a + (i - a) % p end + 1)::bigint]) else w end as w from b),
k as (select r, n, unnest(range(0, n - 4)) as i, w from d where n >= 6),
m as (select r, n, i, array_to_string(w[i + 1:i + 5], ' ') as gram from k),
j as (select x.r, y.i - x.i as p, x.i from m x join m y on x.r = y.r and x.gram = y.gram and y.i > x.i and 4 * (y.i - x.i) <= x.n),
s as (select r, p, min(i) as start, count(*) + 4 + p as length from (select *, i - row_number() over (partition by r, p order by i) as island from j) group by r, p, island),
u as (select r, start, length, min(p) as period from s where length >= greatest(6, 4 * p) group by r, start, length),
o as (select *, row_number() over (partition by r order by length::decimal(38, 9) / period desc, start, period) as place from u),
f as (
  select r, count(*) as n_runs, max(start) filter (where place = 1) as start, max(length) filter (where place = 1) as length, max(period) filter (where place = 1) as period,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from o group by r),
gone as (select distinct r, i from (select r, unnest(range(start + period, start + length)) as i from u)),
left_over as (
  select z.r, string_agg(z.x, ' ' order by z.i) as kept from (select r, unnest(w) as x, unnest(range(0, n)) as i from d) z anti join gone using (r, i) group by z.r)
select d.doc_id, coalesce(f.n_runs, 0)::bigint as n_runs, f.start::bigint as start, f.length::bigint as length, f.period::bigint as period,
  (1000 * f.length // f.period)::bigint as exponent_milli, sha256(coalesce(f.lines, '')) as runs_sha256, sha256(coalesce(l.kept, '')) as collapsed_sha256
from d left join f using (r) left join left_over l using (r)""",
    "op13_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, length(regexp_replace(text, '([<\[])(\\*)(/INST\]|/ROLE\]|/SYS\]|INST\]|ROLE\]|SYS\]|/s>|:\]|s>)', '\1\\\2\3', 'g')) as inner_chars,
    length(regexp_replace(role, '([<\[])(\\*)(/INST\]|/ROLE\]|/SYS\]|INST\]|ROLE\]|SYS\]|/s>|:\]|s>)', '\1\\\2\3', 'g')) as role_chars from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(inner_chars + case role when 'system' then 11 when 'user' then 13 when 'assistant' then 7 else 16 + role_chars end)::bigint as formatted_chars
from e group by conv_id""",
}
