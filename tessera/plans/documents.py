"""Queries of intake, layout, extraction and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import evidence_text, jaccard, normal_text, tokens
from tessera.operators import extract as x
from tessera.operators import helpers as h
from tessera.operators import layout as l
from tessera.operators import resolve as j
from tessera.operators import verify as v
from tessera.plans import carriers as c
from tessera.sources import intake as s

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""select page_id, case when page_id % 3 = 0 then 'not base64' end as reason, case when page_id % 3 <> 0 then length(url) end as n from pages""")
def s1_decode_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict base64; every third row has a stray character."""
    p = c.table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""), F.when(F.col("page_id") % 3 == 0, "*").otherwise("")).alias("data"))
    return s.decode_upload(p, "data").select("page_id", "reason", F.length("bytes").alias("n"))


@query("""with n as (select page_id, case page_id % 5 when 0 then '/etc/x' when 1 then 'a\\b' || page_id || '.pdf' when 2 then 'a/../b' when 3 then 'C:\\x' else 'ok/' || page_id || '.zip' end as name from pages)
select page_id, case when page_id % 5 = 1 then 'a/b' || page_id || '.pdf' when page_id % 5 = 4 then name end as safe, case page_id % 5 when 1 then 67108864 when 4 then 83886080 else 26214400 end as cap from n""")
def s2_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names and caps by extension."""
    k = F.col("page_id")
    name = F.when(k % 5 == 0, "/etc/x").when(k % 5 == 1, F.concat(F.lit("a\\b"), k, F.lit(".pdf"))).when(k % 5 == 2, "a/../b").when(k % 5 == 3, "C:\\x").otherwise(F.concat(F.lit("ok/"), k, F.lit(".zip")))
    p = c.table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    return p.select("page_id", s.safe_relative_name(F.col("name")).alias("safe"), s.input_limit(F.col("name")).alias("cap"))


@query("""select p_partkey, (['png','jpeg','gif','wav',null])[p_partkey % 5 + 1] as format, case when p_partkey % 5 < 4 and p_partkey % 2 = 0 then (['png','jpeg','gif','wav'])[p_partkey % 5 + 1] end as agreed from part""")
def s9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by leading bytes, and their agreement with the extension."""
    k = F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*(F.lit(a) for a in xs)), (k % 5 + 1).cast("int"))
    content = F.unhex(pick(["89504E470D0A1A0A00", "FFD8FFE000104A46", "474946383961", "52494646000000005741564566", "00112233"]))
    name = F.concat(F.lit("f."), F.when(k % 2 == 0, pick(["png", "jpg", "gif", "wav", "png"])).otherwise("ogg"))
    return c.table(spark, sf_dir, "part").select("p_partkey", s.detect_media(content)["format"].alias("format"), s.identify_media(name, content).alias("agreed"))


@query("select p_brand, count(*) as files, sum(p_size * 1000)::bigint as bytes, 0::bigint as manifests, count(*) - count(distinct lower(p_name)) as repeated, count(*) <= 200 and count(*) = count(distinct lower(p_name)) as ok from part group by 1")
def s7_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards of an intake batch."""
    return s.batch_guards(c.table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"), (F.col("p_size") * 1000).alias("size")), "p_brand")


@query("""select p_partkey, bool_and(p_size <> 13) over (partition by p_brand, case when p_partkey % 2 = 0 then p_type else 'file' || p_partkey end) as kept from part""")
def s8_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members commit as a unit, loose files alone."""
    p = c.table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("archive"), F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") != 13).alias("ok"))
    return s.tolerant_intake(p, "p_brand").select("p_partkey", "kept")


@query("""select p_brand as path, p_name || '/' || p_partkey || '.txt' as name, strlen(p_type) as size, p_type as text, null as issue from part""")
def s4_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages written as ZIP and read again, an exact round trip."""
    p = c.table(spark, sf_dir, "part").select("p_brand", F.concat("p_name", F.lit("/"), F.col("p_partkey"), F.lit(".txt")).alias("name"), F.encode("p_type", "UTF-8").alias("content"))
    z = s.package_archives(p, "p_brand")
    return s.read_archives(z.select(F.col("p_brand").alias("path"), F.col("zip").alias("content"))).select("path", "name", "size", F.decode("content", "UTF-8").alias("text"), "issue")


@query("""with p as (select *, p_name || '.png' as name, sha256(p_partkey::varchar) as sha from part), n as (select *, row_number() over (partition by p_brand, lower(name) order by sha) as n from p),
k as (select *, row_number() over (partition by p_brand, lower(name), substr(sha, 1, 12) order by n) as k from n)
select p_partkey, case when n = 1 then name else p_name || '-' || substr(sha, 1, 12) || case when k > 1 then '-' || k else '' end || '.png' end as canonical from k""")
def s12_canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique media names in natural order."""
    p = c.table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat("p_name", F.lit(".png")).alias("name"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"))
    return s.canonical_names(p, ["p_brand"]).select("p_partkey", "canonical")


@query("select doc_id, nfc_normalize(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as text from documents")
def s14_evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form in which quotations are looked for."""
    return c.table(spark, sf_dir, "documents").select("doc_id", evidence_text(normal_text(F.col("text"))).alias("text"))


@query("select conv_id, string_agg(text, chr(10) || chr(10) order by turn, role, text) as text, length(string_agg(text, chr(10) || chr(10) order by turn, role, text)) as chars, length(string_agg(text, chr(10) || chr(10) order by turn, role, text)) <= 500000 as ok from conversations group by 1")
def s17_source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each source with its cap."""
    return s.source_texts(c.table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as positioned runs of a page per order."""
    i = c.table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    i = i.withColumn("item_index", F.row_number().over(w)).withColumn("y", F.floor(F.col("l_quantity") / 10) * 5.0)
    return i.select(F.col("l_orderkey").alias("page"), "item_index", F.concat(F.lit("w"), F.col("l_partkey") % 10).alias("str"), (F.col("item_index") * 50.0).alias("x"), "y", F.lit(40.0).alias("width"), (F.col("l_returnflag") == "R").alias("has_eol"))


@query("""with i as (select l_orderkey as page, row_number() over w as n, 'w' || (l_partkey % 10) as str, floor(l_quantity / 10) * 5.0 as y, l_returnflag = 'R' as eol from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)),
f as (select *, case when lag(y) over v is null or abs(y - lag(y) over v) > 3 or lag(eol) over v then 1 else 0 end as new from i window v as (partition by page order by n)),
g as (select *, sum(new) over (partition by page order by n) - 1 as line from f)
select page, line::bigint as line, string_agg(str, ' ' order by n) as text, (min(n) * 50.0)::double as x0, (max(n) * 50.0 + 40)::double as x1 from g group by 1, 2""")
def l1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: runs to lines."""
    return l.assemble_lines(_items(spark, sf_dir), ["page"])


@query("""with r as (select s_suppkey, s_acctbal / 100 as w, s_nationkey + 1.0 as h, s_suppkey % 7 - 3.0 as a from supplier)
select s_suppkey, least(0, a * w, h, a * w + h) + 5 as x0, least(0, w, 2 * h, w + 2 * h) - 1 as y0, greatest(0, a * w, h, a * w + h) + 5 as x1, greatest(0, w, 2 * h, w + 2 * h) - 1 as y1 from r""")
def l2_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: bounding boxes under affine maps."""
    t = F.array((F.col("s_suppkey") % 7 - 3.0), F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(5.0), F.lit(-1.0))
    return c.table(spark, sf_dir, "supplier").select("s_suppkey", l.bounds(t, F.col("s_acctbal") / 100, F.col("s_nationkey") + 1.0).alias("b")).select("s_suppkey", "b.*")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as blocks in two columns of a page."""
    i = c.table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    i = i.withColumn("block", F.row_number().over(w)).withColumn("side", F.col("l_partkey") % 2)
    wide = F.col("l_suppkey") % 9 == 0
    return i.select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), "block", F.lit(0).alias("row"), F.when(wide, 20.0).otherwise(F.col("side") * 300.0 + 20).alias("x0"), (F.col("block") * 30.0).alias("y0"),
        F.when(wide, 580.0).otherwise(F.col("side") * 300.0 + 250).alias("x1"), (F.col("block") * 30.0 + F.col("l_partkey") % 4).alias("y1"), F.concat(F.lit("some prose of a block "), F.col("l_partkey")).alias("text"), F.lit(600.0).alias("width"),
    )


@query()
def l3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: greedy rows, cut at gaps (tested on small pages)."""
    rows = l.split_rows(l.cluster_rows(_blocks(spark, sf_dir).drop("width")), ["doc", "page"])
    return rows.select("doc", "page", "block", "row", "cell")


@query()
def l4_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: order of blocks by bands and columns (tested on small pages)."""
    return l.reading_order(_blocks(spark, sf_dir))


_MARGINS = f"""{c.LINES}, b as (select source, doc_id as page, line_no as block, (line_no + 0.5) / n * 1000 as y, 500.0 + doc_id % 3 * 10 as "right", case
  when line_no = n - 1 and doc_id % 4 = 0 then 'Page ' || (doc_id + 2) when line_no = n - 1 and doc_id % 4 = 1 then (doc_id + 5)::varchar when line_no = n - 1 and doc_id % 4 = 2 then 'Page ' || doc_id * 3
  when line_no = 0 and doc_id % 5 = 0 then 'Copyright 2020 Somebody' when line_no = 0 and doc_id % 5 = 1 then 'Practice Test 1 ' || (doc_id + 2) when line_no = 0 and doc_id % 5 = 2 then 'Section 4' else line end as text from lines),
m as (select *, trim(text) as t, case when y < 70 then 'header' when y > 910 then 'footer' end as margin, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\d+', '#', 'g') as pattern, try_cast(regexp_extract(text, '(\\d{{1,9}})\\s*$', 1) as bigint) - page as gap from b where not regexp_matches(text, 'Section|Module|Question|Read |Listen |Fill in', 'i')),
o as (select source, margin, pattern from m where margin is not null group by 1, 2, 3 having count(distinct page) >= 2),
a as (select m.*, coalesce(gap is not null and min(page) over w <> max(page) over w, false) as tracks from m semi join o using (source, margin, pattern) window w as (partition by source, margin, pattern, gap order by "right" range between 12 preceding and 12 following)),
k as (select distinct source, page, y from a where tracks and regexp_full_match(t, '\\d+')),
l as (select a.*, regexp_matches(t, '^(?:(?:Original|Practice|Sample|Mock)\\s+(?:Workbook|Test))\\s+#?\\d+(?:\\s+\\d+)?$', 'i') as title, exists (select 1 from k where k.source = a.source and k.page = a.page and abs(k.y - a.y) <= 3) as beside from a),
f as (select *, regexp_matches(t, '^(?:\\d+|Page\\s+\\d+)$', 'i') and tracks or title and (tracks or beside) or regexp_matches(t, '^(?:Copyright\\s*(?:©\\s*)?|©\\s*)\\d{{4}}\\b.{{0,180}}$', 'i') as label from l)"""


@query(f"with {_MARGINS} select source, page, block::int as block, pattern, case when label then margin else 'body' end as role, case when not label then 'repeated_margin' end as doubt from f")
def l5_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that repeat in the margins; documents of a source as its pages, some with labels, titles and imprints."""
    d, i, n = F.col("doc_id"), F.col("line_no"), F.col("n")
    first, last = i == 0, i == n - 1
    text = F.when(last & (d % 4 == 0), F.concat(F.lit("Page "), d + 2)).when(last & (d % 4 == 1), (d + 5).cast("string")).when(last & (d % 4 == 2), F.concat(F.lit("Page "), d * 3))
    text = text.when(first & (d % 5 == 0), "Copyright 2020 Somebody").when(first & (d % 5 == 1), F.concat(F.lit("Practice Test 1 "), d + 2)).when(first & (d % 5 == 2), "Section 4").otherwise(F.col("line"))
    y = (i + 0.5) / n * 1000
    blocks = c.lines(spark, sf_dir).select("source", d.alias("page"), i.alias("block"), text.alias("text"), y.alias("y"), F.lit(1000.0).alias("height"), (d % 3 * 10 + 500.0).alias("right"), y.alias("baseline"))
    return l.repeated_margins(blocks, ["source"])


@query(f"with {c.LINES} select doc_id, line_no::int as line_no, case when bool_or(regexp_matches(line, '^\\s*Licensed under')) over (partition by doc_id) then 'reference' else 'visible' end as visibility from lines")
def l8_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under a marker are reference."""
    return l.reference_visibility(c.lines(spark, sf_dir), ["doc_id"], "line", r"^\s*Licensed under").select("doc_id", "line_no", "visibility")


_STRUCTURE = " or ".join(f"regexp_matches(t, '{pattern}')" for pattern in l.STRUCTURAL) + " or regexp_matches(regexp_replace(lower(t), '[^a-z]', '', 'g'), 'listenandrepeat|listenrepeat')"


@query(f"""with {c.LINES}, t as (select *, regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '') as t from lines),
r as (select *, regexp_replace(t, '\\d+', '#', 'g') as mask, row_number() over (partition by source, doc_id order by line_no) <= 2 or row_number() over (partition by source, doc_id order by line_no desc) <= 3 as edge from t where t <> ''),
o as (select source, mask from r where edge and length(t) <= 90 and not ({_STRUCTURE}) group by 1, 2 having count(distinct doc_id) >= 3)
select doc_id, line_no::int as line_no from r semi join o using (source, mask) where edge""")
def l9_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands alike at the edges of three pages or more; structural lines stay."""
    return l.edge_furniture(c.lines(spark, sf_dir), ["source"], "doc_id", "line_no", "line").where("furniture").select("doc_id", "line_no")


@query(f"with {c.LINES}, m as (select *, max(case when length(trim(line, ' ')) > 0 then line_no end) over (partition by doc_id) as last from lines) select doc_id, line_no::int as line_no from m where line_no = last and regexp_matches(line, 'License')")
def l10_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers on the last line."""
    return l.last_line_footers(c.lines(spark, sf_dir), ["doc_id"], "line_no", "line", "License").where("footer").select("doc_id", "line_no")


@query("select l_orderkey, group_no as \"group\", string_agg(w, ' ' order by x, w) as text from (select l_orderkey, round((l_linenumber + l_linenumber + 20) / 2.0 / 12)::bigint as group_no, l_partkey::double as x, 'w' || l_suppkey as w from lineitem) group by 1, 2")
def l11_group_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to lines by their middles."""
    i = c.table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(None).cast("int").alias("line"), F.col("l_partkey").cast("double").alias("x0"), F.col("l_linenumber").alias("y0"), (F.col("l_linenumber") + 20).alias("y1"), F.concat(F.lit("w"), "l_suppkey").alias("text"))
    return l.group_words(i, ["l_orderkey"]).select("l_orderkey", "group", "text")


@query("""with t as (select l_orderkey, row_number() over w as pos, case when l_partkey % 4 < 2 then null when l_partkey % 11 = 0 then row_number() over w + 3 else row_number() over w end as number from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)),
n as (select *, last_value(number ignore nulls) over b + pos - last_value(case when number is not null then pos end ignore nulls) over b as counted, lead(number) over (partition by l_orderkey order by pos) - 1 as after
  from t window b as (partition by l_orderkey order by pos rows between unbounded preceding and 1 preceding)),
f as (select *, case when number is null then case when after is null then counted when counted is null or counted = after then after end end as fix from n)
select l_orderkey, pos::int as pos, coalesce(number, case when fix >= 1 then fix end)::int as number, coalesce(fix >= 1, false) as restored from f""")
def l13_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing numbers in order, from the labels around them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    k = F.col("l_partkey")
    number = F.when(k % 4 >= 2, F.when(k % 11 == 0, F.col("pos") + 3).otherwise(F.col("pos")))
    t = c.table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w)).withColumn("number", number)
    return l.repair_numbers(t.select("l_orderkey", "pos", "number"), ["l_orderkey"], ["pos"], "number").select("l_orderkey", "pos", "number", "restored")


@query("""select event_id, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by event_id rows between 3 preceding and 3 following) - case when event_type = 'click' then 1 else 0 end >= 2 as option_like from events""")
def l14_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit options within three lines around."""
    return l.option_context(c.table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "click").select("event_id", "option_like")


@query("""with t as (select *, row_number() over w as pos from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)), k as (select *, case when l_partkey % 7 = 0 then pos + 5 else pos end as num from t),
n as (select *, lag(num) over v as b, lead(num) over v as a from k window v as (partition by l_orderkey order by pos))
select l_orderkey, pos::int as pos, case when b + 2 = a and num <> b + 1 then b + 1 else num end::int as number, coalesce(b + 2 = a and num <> b + 1, false) as repaired, case when l_quantity * 2 < 50 or l_returnflag not in ('A') then '[?]' else l_returnflag end as letter from n""")
def l15_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key rows repaired by both neighbours, unsafe letters withheld."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    t = c.table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w)).withColumn("number", F.when(F.col("l_partkey") % 7 == 0, F.col("pos") + 5).otherwise(F.col("pos")))
    out = l.repair_key_rows(t.select("l_orderkey", "pos", "number", F.col("l_returnflag").alias("letter"), (F.col("l_quantity") * 2).alias("confidence")), ["l_orderkey"], ["pos"])
    return out.select("l_orderkey", "pos", "number", "repaired", "letter")


@query("""with p as (select doc_id, case when doc_id % 3 = 0 then '' else coalesce(text, '') end as text from documents),
q as (select *, not regexp_matches(text, '[^\\s\\p{Z}\\x0B\\x{85}]') as blank from p)
select doc_id, case when blank then coalesce(b.text, q.text) else q.text end as text, blank and b.text is not null as scanned from q left join benchmark b on b.item_id = doc_id % 50""")
def l17_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are blank or null, and every third page, take the scan's text; all rows stay."""
    text = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    d = c.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("item_id"), text.alias("text"))
    return l.apply_scans(d, c.table(spark, sf_dir, "benchmark"), ["item_id"]).select("doc_id", "text", "scanned")





@query("""select e.conv_id, e.turn, coalesce(b.text, e.text) as text, case when b.text is null then 'kept' when len(regexp_split_to_array(e.text, '\\s+')) = len(regexp_split_to_array(b.text, '\\s+')) then 'same' else 'proportional' end as boxes
from conversations e left join benchmark b on b.item_id = e.conv_id * 3 + e.turn""")
def l18_proofread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected lines and what becomes of their boxes."""
    t = c.table(spark, sf_dir, "conversations").withColumn("item_id", F.col("conv_id") * 3 + F.col("turn"))
    return l.apply_proofread(t, c.table(spark, sf_dir, "benchmark"), ["item_id"]).select("conv_id", "turn", "text", "boxes")


@query("""with t as (select o_custkey as page, o_orderkey as line, case when o_orderkey % 97 <> 0 then o_totalprice end as y, o_orderkey % 13 <> 0 as filled from orders),
m as (select *, coalesce(bool_and(y is not null) filter (where filled) over (partition by page), false) as moved from t),
g as (select *, row_number() over w as place, case when moved then lag(y) over w - y end as gap from m where not moved or filled window w as (partition by page order by case when moved then -y end, line)),
h as (select page, list_sort(list(gap) filter (where gap > 1)) as gaps from g group by 1)
select page, line, place::int as place, coalesce(gap > 1.55 * coalesce(gaps[len(gaps) // 2 + 1], 14), false) as blank_before from g join h using (page)""")
def l19_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page and their gaps; some have no text, some no place."""
    k = F.col("o_orderkey")
    o = c.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.when(k % 97 != 0, F.col("o_totalprice").cast("double")).alias("y"), k.alias("x"), k.alias("line"), F.when(k % 13 == 0, " ").otherwise("line").alias("text"))
    return l.page_lines(o, ["page"]).select("page", "line", "place", "blank_before")


@query("""with l as (select conv_id, turn, role, replace(coalesce(text, ''), chr(10), ' ') as t from conversations), s as (select *, max(case when role in ('user', 'system') then turn end) over (partition by conv_id order by turn) as at_turn from l)
select conv_id, at_turn as at, any_value(case when role = 'user' then 'question' when role = 'system' then 'group' end) as directive, string_agg(case role when 'user' then regexp_replace(regexp_replace(t, '^\\s+', ''), '\\s+$', '') when 'system' then 'all' else case when turn % 3 = 0 then ' ' else '' end || '@ ' || t || '@@' end, chr(10) order by turn) as body, count(*) as n_lines
from s where at_turn is not null group by 1, 2""")
def x1_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directive lines, some indented, in capitals or with a colon, and the text below them; turns as lines."""
    text = F.coalesce("text", F.lit(""))
    asked, odd = F.when(F.col("turn") % 4 == 0, " @Question: ").otherwise("@question "), F.when(F.col("turn") % 3 == 0, " @@ ").otherwise("@@ ")
    line = F.when(F.col("role") == "user", F.concat(asked, text)).when(F.col("role") == "system", "@GROUP all ").otherwise(F.concat(odd, text, F.lit("@@")))
    t = c.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate(line, "\n", " ").alias("line"))
    return x.parse_template(t, ["conv_id"], "turn", "line")


@query("""with i as (select l_orderkey as doc, l_partkey, l_suppkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem)
select doc, n::int as number, n || '. What about ' || l_partkey || '?' || chr(10) || 'and why' as prompt, 'A) ' || l_returnflag || '|B) other' as options,
  case when l_suppkey % 4 = 3 then 'missing' when l_suppkey % 4 = 2 then 'unmatched' else 'applied' end as state, case l_suppkey % 4 when 0 then 'A' when 1 then 'B' end as answer from i""")
def x2_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of worksheets with their options, and the answers of their group's key; an order's items as a group."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    i = c.table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(own))
    n, kind = F.col("n"), F.col("l_suppkey") % 4
    line = lambda at, text: F.struct(at.cast("int").alias("line_no"), text.alias("line"))
    asked = F.array(
        line(10 * n, F.concat(n, F.lit(". What about "), "l_partkey", F.lit("?"))), line(10 * n + 1, F.lit("and why")), line(10 * n + 2, F.concat(F.lit("(A) "), "l_returnflag")), line(10 * n + 3, F.lit("B. other")),
        line(10000 + n, F.when(kind < 3, F.concat(n, F.lit(" "), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("D"), F.lit("")), (kind + 1).cast("int")))).otherwise("")),
    )
    rows = i.select("l_orderkey", F.explode(asked).alias("l"))
    ends = F.array(line(F.lit(0), F.lit("Section one")), line(F.lit(9999), F.lit("Answer key:")))
    rows = rows.unionByName(i.select("l_orderkey").distinct().select("l_orderkey", F.explode(ends).alias("l"))).select(F.col("l_orderkey").alias("doc"), "l.line_no", "l.line")
    questions, options, keys = x.worksheet(rows, ["doc"], "line_no", "line")
    listed = options.groupBy("doc", "question").agg(F.sort_array(F.collect_list(F.struct("label", "option"))).alias("o"))
    q = questions.join(listed, ["doc", "question"], "left").withColumn("question_id", F.concat_ws("-", "doc", "question"))
    asked = q.select("question_id", "doc", "group", "number", F.lit("single_choice").alias("type"), F.transform("o", lambda x: x["label"]).alias("options"), F.array().cast("array<string>").alias("local"))
    found = j.resolve_keys(asked, keys, ["doc", "group"], "number")
    shown = F.array_join(F.transform("o", lambda x: F.concat(x["label"], F.lit(") "), x["option"])), "|")
    return q.join(found, "question_id").select("doc", "number", "prompt", shown.alias("options"), "state", F.get("answer", 0).alias("answer"))


@query("""select o_orderkey, number, answer from (select o_orderkey, unnest([1, 2, 3]) as number, unnest([chr(65 + (o_orderkey % 4)::int), chr(65 + (o_custkey % 4)::int), 'D']) as answer from orders where o_orderkey % 5 <> 0)""")
def x7_key_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key tables of a line; a line with an odd part is refused."""
    o = c.table(spark, sf_dir, "orders")
    letter = lambda k: F.char(65 + F.col(k) % 4)
    line = F.concat(F.lit("1 "), letter("o_orderkey"), F.lit("; 2. "), letter("o_custkey"), F.when(F.col("o_orderkey") % 5 == 0, "; see below").otherwise("; 3) D"))
    return x.key_table(o.select("o_orderkey", line.alias("line")), ["o_orderkey"], "line")


@query("""select c_custkey, (['zero','modular','worksheet'])[arg_max(p, (s * 10 + p)) + 1] as parser, max(s)::bigint as score from (select o_custkey as c_custkey, o_orderkey % 3 as p, o_orderkey % 11 - o_orderkey % 4 as s from orders) group by 1""")
def x6_arbitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser with the most questions less errors."""
    o = c.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    r = o.select(F.col("o_custkey").alias("c_custkey"), (k % 11).alias("questions"), (k % 4).alias("errors"), (k % 3).alias("priority"), F.element_at(F.array(F.lit("zero"), F.lit("modular"), F.lit("worksheet")), (k % 3 + 1).cast("int")).alias("parser"))
    return x.arbitrate(r, ["c_custkey"])


@query("""select o_orderkey, case when k in (0, 3) then 'group' when k = 1 then 'question' end as scope, case when k in (0, 2) then 'prepare' when k < 6 then 'time' end as field,
  case k when 0 then case when n * 60 <= 7200 then n * 60 end when 1 then case when o_custkey <= 7200 then o_custkey end when 2 then 90 when 3 then 0 end::int as seconds
from (select o_orderkey, o_orderkey % 8 as k, o_custkey % 200 as n, o_custkey from orders)""")
def x18_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled times; what is no single duration of up to two hours in minutes or seconds is refused (null)."""
    o, k = c.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 8
    text = F.when(k == 0, F.concat(F.lit("Group Preparation time: "), F.col("o_custkey") % 200, F.lit(" minutes."))).when(k == 1, F.concat(F.lit("question response time : "), "o_custkey", F.lit(" sec")))
    text = text.when(k == 2, "Prep time: 1.5 m").when(k == 3, "Group time limit: 0 seconds").when(k == 4, "Answer time: 1 hour").when(k == 5, "Time limit: about 5 minutes").when(k == 6, "You have 5 minutes.").otherwise("Time: 5 s")
    out = o.select("o_orderkey", x.labelled_times(text).alias("t"))
    return out.select("o_orderkey", "t.*")


@query("""select p_partkey, case p_partkey % 8 when 0 then 'so' when 1 then 'lved' when 2 then null when 3 then null when 4 then 'a-B' when 5 then '' when 6 then 'bcd' end as letters from part""")
def x17_missing_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters to fill in, as a scan gives them."""
    k = F.col("p_partkey") % 8
    read = F.element_at(F.array(*(F.lit(x) for x in ("SO", "Ived", "IN", "A", "a-B", "", "bcd"))), (k + 1).cast("int"))
    return c.table(spark, sf_dir, "part").select("p_partkey", x.missing_letters(F.when(k < 7, read)).alias("letters"))


@query(f"with {c.LINES} select doc_id, line_no::int as line_no, sum(case when regexp_matches(line, '!!$') then 1 else 0 end) over w as \"group\", max(case when regexp_matches(line, 'Licensed') then 1 else 0 end) over w = 1 as reference from lines window w as (partition by doc_id order by line_no)")
def x21_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by headings; reference from a key heading on."""
    return x.source_groups(c.lines(spark, sf_dir), ["doc_id"], "line_no", "line", "!!$", "Licensed").select("doc_id", "line_no", "group", "reference")


@query("""with b as (select item_id, string_split(translate(coalesce(text, ''), chr(10), ' '), ' ') as ws from benchmark), p as (select item_id, ws, unnest(range(1, len(ws) + 1)) as i from b),
w as (select item_id, ws[i] as w, i, (coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x) + 1)), 0))::int as at0 from p)
select item_id, at0 + 2 as start, at0 + length(w)::int as "end", at0 as prefix_start, length(w)::int - 2 as missing from w where i % 3 = 0 and length(w) > 4 and regexp_full_match(w, '[A-Za-z]+')""")
def x10_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps with their offsets; every third word of letters in a benchmark text loses its end."""
    b = c.table(spark, sf_dir, "benchmark")
    cut = lambda w, i: (i % 3 == 2) & (F.length(w) > 4) & w.rlike("^[A-Za-z]+$")
    words = F.split(F.translate(F.coalesce("text", F.lit("")), "\n", " "), " ", -1)
    gapped = F.array_join(F.transform(words, lambda w, i: F.when(cut(w, i), F.concat(F.substring(w, 1, 2), F.repeat(F.lit("_"), F.length(w) - 2))).otherwise(w)), " ")
    return b.select("item_id", F.explode(x.inline_blanks(gapped)).alias("b")).select("item_id", "b.*")


@query()
def x13_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one order of fragments (held against all orders in tests/test_whole.py); thirds of whole benchmark texts, turned round."""
    words = F.split(F.translate("text", "\n", " "), " ")
    third = F.ceil(F.size(words) / 3).cast("int")
    part = lambda k: F.array_join(F.slice(words, k * third + 1, third), " ")
    fragments = F.filter(F.array(part(2), part(0), part(1)), lambda f: F.trim(f) != "")
    b = c.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("answer"), fragments.alias("fragments"))
    return b.select("item_id", x.tiling("answer", "fragments").alias("order"))


@query("""with w as (select item_id, string_split(translate(coalesce(text, ''), chr(10), ' '), ' ') as ws from benchmark),
g as (select *, list_filter(ws, lambda x, i: i % 3 = 0 and length(x) > 4 and regexp_full_match(x, '[A-Za-z]+')) as cut from w)
select item_id, case when len(cut) > 0 then array_to_string(list_transform(cut, lambda x: substr(x, 3)), ',') end as missing,
  case when len(cut) > 0 then array_to_string(list_transform(ws, lambda x, i: case when i % 3 = 0 and length(x) > 4 and regexp_full_match(x, '[A-Za-z]+') then upper(substr(x, 1, 2)) || repeat('_', length(x) - 2) else x end), ' ') end as passage from g""")
def x15_gap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that lost their ends, in capitals and without a mark, restored from the full text."""
    b = c.table(spark, sf_dir, "benchmark").withColumn("t", F.translate(F.coalesce("text", F.lit("")), "\n", " "))
    cut = lambda w, i: (i % 3 == 2) & (F.length(w) > 4) & w.rlike("^[A-Za-z]+$")
    gapped = F.array_join(F.transform(F.split("t", " ", -1), lambda w, i: F.when(cut(w, i), F.upper(F.substring(w, 1, 2))).otherwise(w)), " ")
    out = b.select("item_id", x.gap_words(gapped, F.col("t")).alias("g"))
    return out.select("item_id", F.array_join("g.missing", ",").alias("missing"), "g.passage")


RULES = [
    v.Rule("text too short", "warning", "length(text) >= 100"), v.Rule("length recorded wrongly", "error", "n_chars = length(text)"), v.Rule("language unknown", "error", "lang in ('en', 'de', 'fr')"),
    v.Rule("source id malformed", "error", "source rlike '^[a-z0-9]{1,128}$'"),
]


@query("""select 'warning' as severity, 'text too short' as message, doc_id::varchar as path from documents where not coalesce(length(text) >= 100, false) union all select 'error', 'length recorded wrongly', doc_id::varchar from documents where not coalesce(n_chars = length(text), false)
union all select 'error', 'language unknown', doc_id::varchar from documents where not coalesce(lang in ('en','de','fr'), false) union all select 'error', 'source id malformed', doc_id::varchar from documents where not coalesce(regexp_full_match(source, '[a-z0-9]{1,128}'), false)""")
def v1_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: a rules table in one pass; three of its rules."""
    return v.check_rules(c.table(spark, sf_dir, "documents"), RULES, F.col("doc_id"))


@query("select 'error' as severity, 'name used twice' as message, p_brand || '/' || p_name as path from part group by p_brand, p_name having count(*) > 1")
def v1_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: uniqueness across a pack."""
    return v.duplicates(c.table(spark, sf_dir, "part"), ["p_brand", "p_name"], "name used twice")


@query("""select doc_id, length(text) > 0 as display, length(text) > 0 and coalesce(quality = 1, false) as score, concat_ws(',', case when not coalesce(length(text) > 0, false) then 'no_text' end, case when quality is null then 'no_key' when quality <> 1 then 'bad_key' end) as score_blocked
from documents left join labels using (doc_id)""")
def v4_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: what a candidate may be used for, and what blocks it."""
    d = c.table(spark, sf_dir, "documents").join(c.table(spark, sf_dir, "labels"), "doc_id", "left")
    no_text = "not coalesce(length(text) > 0, false)"
    out = v.capabilities(d, {"display": {"no_text": no_text}, "score": {"no_text": no_text, "no_key": "quality is null", "bad_key": "coalesce(quality <> 1, false)"}})
    return out.select("doc_id", "display", "score", F.array_join("score_blocked", ",").alias("score_blocked"))


@query(f"""with {c.LINES}, f as (select doc_id, substr(line, 3, 12) as t from lines where line_no = 1), m as (select f.doc_id, count(case when contains(line, t) and length(t) > 0 then 1 end) as n, min(case when contains(line, t) and length(t) > 0 then line_no end) as b from f left join lines using (doc_id) group by 1)
select doc_id, n as n_blocks, case when n = 1 then 'known' when n > 1 then 'ambiguous' else 'missing' end as state, case when n = 1 then b end::int as block_id from m""")
def v5_field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V6: in how many lines of its document a quotation stands."""
    lines = c.lines(spark, sf_dir)
    fields = lines.where("line_no = 1").select("doc_id", F.substring("line", 3, 12).alias("field_text"))
    return v.field_evidence(fields, lines.select("doc_id", F.col("line").alias("block_text"), F.col("line_no").alias("block_id")), ["doc_id"], ["doc_id"])


@query("select doc_id, case when contains(d.text, left(b.text, 40)) then left(b.text, 40) end as quote, not coalesce(contains(d.text, left(b.text, 40)), false) as cleared from documents d join benchmark b on b.item_id = d.doc_id % 40")
def v7_clear_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, V7: quotations that their source does not hold are emptied."""
    d = c.table(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % 40).withColumnRenamed("text", "src")
    rows = d.join(c.table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 40).alias("quote")), "item_id")
    return v.clear_unverified(rows, "quote", "src").select("doc_id", "quote", "cleared")


@query("""select 'error' as severity, 'media not found' as message, p as path from (select distinct l_partkey::varchar as p from lineitem) where p not in (select p_partkey::varchar from part where p_size < 40)
union all select 'warning', 'media not used', p_partkey::varchar from part where p_size < 40 and p_partkey not in (select l_partkey from lineitem)""")
def v8_media_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: absent and idle media."""
    refs = c.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("path"))
    return v.media_issues(refs, c.table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").cast("string").alias("path")))


@query()
def v10_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript against its reference (held against a plain version in tests/test_exam.py); neighbours of a conversation."""
    t = c.table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.select("conv_id", "turn", F.col("text").alias("reference"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "^\\S+ ", "not 7 ")).alias("transcript"), F.array_compact(F.array(F.lag("text").over(w), F.lead("text").over(w))).alias("near"))
    return v.compare_texts(rows, "reference", "transcript", "near").select("conv_id", "turn", "state", F.array_join("doubts", ",").alias("doubts"))


@query("""with t as (select item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:''\\p{L}+)?')) as w from benchmark)
select a.item_id as a, b.item_id as b, round(len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(a.w || b.w)), 6) as similarity from t a join t b on b.item_id = a.item_id + 1""")
def v11_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set similarity of tokens of neighbours."""
    b = c.table(spark, sf_dir, "benchmark").select("item_id", tokens(F.col("text")).alias("w"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("w").alias("w2"))
    return b.join(nxt, "item_id").select(F.col("item_id").alias("a"), "b", F.round(jaccard(F.col("w"), F.col("w2")), 6).alias("similarity"))


@query("""with t as (select item_id, case when item_id % 5 = 1 then ' ' else text end as a, case item_id % 5 when 0 then text || ' 5 _' when 2 then replace(text, ' ', '  ') when 3 then 'NOT ' || text when 4 then text end as b from benchmark),
n as (select item_id, coalesce(a, '') as a, coalesce(b, '') as b from t), d as (select *, trim(regexp_replace(a, '\\s+', ' ', 'g')) as x, trim(regexp_replace(b, '\\s+', ' ', 'g')) as y from n)
select item_id, case when x = '' or x = y then '' else array_to_string(list_filter(['text_ocr_disagreement',
  case when list_transform(regexp_extract_all(a, '(?i)\\b(?:not|no|never|except|without)\\b'), lambda w: lower(w)) <> list_transform(regexp_extract_all(b, '(?i)\\b(?:not|no|never|except|without)\\b'), lambda w: lower(w)) then 'critical_negation_conflict' end,
  case when length(regexp_replace(a, '[^_]', '', 'g')) <> length(regexp_replace(b, '[^_]', '', 'g')) then 'blank_anchor_conflict' end,
  case when regexp_extract_all(a, '\\d+') <> regexp_extract_all(b, '\\d+') then 'number_conflict' end], lambda c: c is not null), ',') end as issues from d""")
def v12_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text layer against its OCR; an empty layer and other white space are no disagreement."""
    k, text = F.col("item_id") % 5, F.col("text")
    ocr = F.when(k == 0, F.concat(text, F.lit(" 5 _"))).when(k == 2, F.replace(text, F.lit(" "), F.lit("  "))).when(k == 3, F.concat(F.lit("NOT "), text)).when(k == 4, text)
    rows = c.table(spark, sf_dir, "benchmark").select("item_id", F.when(k == 1, " ").otherwise(text).alias("text"), ocr.alias("ocr"))
    return v.compare_ocr(rows, "text", "ocr").select("item_id", F.array_join("issues", ",").alias("issues"))


@query("select doc_id, coalesce(not (doc_id % 5 = 0) and length(text) >= 16 and not regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') and regexp_matches(text, '(?s)\\p{L}.*\\p{L}'), false) as reliable from documents")
def v13_reliable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose text can be relied on."""
    return c.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(v.reliable_region(F.col("text"), F.col("doc_id") % 5 == 0), F.lit(False)).alias("reliable"))


@query("select event_id, floor(value * 16000)::bigint as first, floor((value + 1.5) * 16000)::bigint as last from events")
def v15_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample ranges."""
    return c.table(spark, sf_dir, "events").select("event_id", v.decoded_scope(F.col("value"), F.col("value") + 1.5).alias("s")).select("event_id", F.col("s.first").alias("first"), F.col("s.last").alias("last"))


@query("""select o_orderkey, case when o_custkey % 4 = c.c_nationkey % 4 and o_orderstatus = (case when c.c_acctbal > 5000 then 'F' else 'O' end) then 'passed' else 'notChecked' end as effective from orders join customer c on c_custkey = o_custkey""")
def v16_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks hold only while their bindings are current."""
    checks = c.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 4).cast("long").alias("revision"), F.col("o_orderstatus").alias("hash"), F.lit("passed").alias("state"))
    now = c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 4).cast("long").alias("revision"), F.when(F.col("c_acctbal") > 5000, "F").otherwise("O").alias("hash"))
    return v.effective_checks(checks, now, ["o_custkey"], ["revision", "hash"]).select("o_orderkey", "effective")


@query("""select item_id, case when item_id % 3 = 0 then 0 else 1 end + case when item_id % 4 = 0 then 0 else 1 end as n, 2 - (case when item_id % 3 = 0 then 0 else 1 end + case when item_id % 4 = 0 then 0 else 1 end) as removed from benchmark""")
def v17_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes must stand in the answer; scores and claims about sound go."""
    k = F.col("item_id")
    first = F.struct(F.when(k % 3 == 0, "§§").otherwise(F.substring("text", 5, 9)).alias("quote"), F.lit("shorter").alias("note"))
    second = F.struct(F.substring("text", 2, 6).alias("quote"), F.when(k % 4 == 0, "score 4/5").otherwise("clear").alias("note"))
    out = v.clean_feedback(c.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("answer"), F.array(first, second).alias("corrections")))
    return out.select("item_id", F.size("kept").alias("n"), "removed")


@query("""with b as (select o_custkey as doc, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place, case when o_orderdate < date '1996-01-01' then 'a' else 'b' end as name, o_orderkey % 6 as k from orders),
r as (select *, sum(case when new then 1 else 0 end) over (partition by doc order by place) as reach from (select *, k = 0 or coalesce(lag(name) over (partition by doc order by place) <> name, false) as new from b)),
e as (select doc, reach, place as at, unnest([1, 2, 12]) as number, unnest([chr(65 + (id // 6 % 3)::int), 'B', 'C']) as value from r where k = 1),
h as (select q.id, chr(65 + (q.doc % 3)::int) as answer, e.value from r q join e on e.doc = q.doc and e.reach = q.reach and e.number = q.id % 4 + 1 and e.at >= q.place where q.k > 1)
select id as question_id, count(*) as n, case when count(*) > 1 then 'ambiguous' when any_value(value) = any_value(answer) then 'known' else 'conflict' end as state from h group by 1""")
def v18_key_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the key rows between a prompt and the next heading say of its answer; orders of a customer as blocks."""
    k = F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    key = F.concat(F.lit("Answer key: 1 "), F.char(65 + F.expr("o_orderkey div 6 % 3")), F.lit("; 2. B, 12) C"))
    text = F.when(k % 6 == 0, "Reading: more").when(k % 6 == 1, key).otherwise("What is it?")
    b = c.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("id"), place.alias("place"), F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("date"), "a").otherwise("b").alias("name"), text.alias("text"))
    q = b.where("id % 6 > 1").select("doc", F.col("id").alias("question_id"), (F.col("id") % 4 + 1).alias("number"), F.char(65 + F.col("doc") % 3).alias("answer"), "place")
    return v.answer_evidence(q, b.select("doc", "place", "name", "text"), ["doc"]).select("question_id", "n", "state")


@query("""with i as (select doc_id, 1 as r from documents where not coalesce(length(text) >= 100, false) union all select doc_id, 2 from documents where not coalesce(lang in ('en','de','fr'), false))
select doc_id::varchar as path, count(*) as n_issues, case max(r) when 2 then 'blocked' else 'needs_review' end as status from i group by 1""")
def v19_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a material from its issues."""
    return v.status_rollup(v.check_rules(c.table(spark, sf_dir, "documents"), [RULES[0], RULES[2]], F.col("doc_id")), ["path"])


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'saved' when o_orderkey % 4 = 0 then 'unanswered' when o_orderkey % 4 < 3 then 'partial' else 'answered' end as status from orders""")
def h2_answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: saved, answered, partial or unanswered by slots."""
    k = F.col("o_orderkey")
    slots = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= k % 4, "x").otherwise(" "))
    return c.table(spark, sf_dir, "orders").select("o_orderkey", h.answer_status(slots, F.lit(3), k % 5 == 0).alias("status"))


@query("select o_orderkey, 'I ' || case when o_orderkey % 2 = 0 then 'red' else 'blue' end || ' and [z] end' || case when o_orderkey % 3 = 0 then ' + big' else '' end as shown from orders")
def h1_format_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: option ids as texts in the slots of a frame."""
    k = F.col("o_orderkey")
    options = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(t).alias("text")) for i, t in (("a", "red"), ("b", "blue"), ("c", "big"))))
    ids = F.concat(F.array(F.when(k % 2 == 0, "a").otherwise("b"), F.lit("z")), F.when(k % 3 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")))
    return c.table(spark, sf_dir, "orders").select("o_orderkey", h.format_answer(F.lit("I __ and ___ end"), ids, options).alias("shown"))


@query("""with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as n, count(*) over (partition by conv_id) as c from conversations) select conv_id, turn, n <= 3 as sent from r where n <= 6""")
def h12_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last messages of a scope, of which fewer are sent (numbers are the feature)."""
    return h.scoped_history(c.table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], sent=3, kept=6).select("conv_id", "turn", "sent")


@query("""select user_id, event_type, event_id from events e where event_id % 3 = 0 and value < 50 and event_id > coalesce((select max(t.event_id) from events t where t.event_id % 7 = 0 and t.user_id = e.user_id and t.event_type = e.event_type), -1)""")
def h13_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed, unexpired preferences newer than their tombstones."""
    e = c.table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_type", "event_id", (F.col("event_id") % 3 == 0).alias("confirmed"), (F.col("value") < 50).alias("valid"))
    return h.allowed_preferences(rows, e.where("event_id % 7 = 0"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("select user_id, event_type, max(event_id) as revision, arg_max(value, event_id) as value from events group by 1, 2")
def h6_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5, H6: appended revisions; the latest stands."""
    return h.latest_revision(c.table(spark, sf_dir, "events").withColumnRenamed("event_id", "revision"), ["user_id", "event_type"], "revision").select("user_id", "event_type", "revision", "value")
