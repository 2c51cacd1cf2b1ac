"""Queries of projected documents (L7, L4) and of proofread words (L18): blocks with their raw runs, reading order, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import layout as l
from tessera.operators import projection as pr
from tessera.plans import carriers as c

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An order's items as runs of a page, some on one line, in the document of its customer."""
    o = c.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("name"))
    i = c.table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    i = i.select("name", F.col("l_orderkey").cast("int").alias("page"), "l_partkey", "l_quantity", n.alias("n"))
    items = i.select(
        "name", "page", F.col("page").alias("chunk"), (F.col("n") - 1).alias("item_index"), F.concat(F.lit("w"), F.col("l_partkey") % 10).alias("str"), (50.0 * F.col("n") + F.col("l_partkey") % 3 * 30).alias("x"),
        (100 + F.floor(F.col("l_quantity") / 10) * 20.0).alias("y"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"), F.col("n").alias("line"), F.lit(None).cast("array<double>").alias("axis"),
    )
    head = lambda kind, value: F.lit(value).cast(kind)
    pages = items.select("name", "page", "chunk").distinct().withColumns({"kind": head("string", "pdf"), "text": head("string", ""), "width": head("double", 600.0), "height": head("double", 800.0), "transform": head("array<double>", None), "rotation": head("int", 0)})
    return pages, items


@query("""with i as (select 'c' || o_custkey as name, l_orderkey as page, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n, 100 + floor(l_quantity / 10) * 20 as y from lineitem join orders on o_orderkey = l_orderkey),
x as (select *, 50.0 * n + l_partkey % 3 * 30 as x from i),
g as (select *, case when x - lag(x + 40) over w > 24 then 1 else 0 end as cut from x window w as (partition by page, y order by x, n)), s as (select *, sum(cut) over (partition by page, y order by x, n) as cell from g)
select page::int as page, 'block-' || substr(sha256('["' || name || '"],' || page || ',' || page || ',[' || string_agg((n - 1)::varchar, ',' order by x, n) || '],[' || string_agg(n::varchar, ',' order by x, n) || ']'), 1, 20) as block_id,
  string_agg('w' || l_partkey % 10, ' ' order by x, n) as text, min(x)::double as x0, (max(x) + 40)::double as x1, (800 - y)::double as baseline, count(*)::int as n_runs from s group by name, page, y, cell""")
def l7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of positioned pages with ids from their raw runs."""
    pages, items = _pages(spark, sf_dir)
    return pr.blocks_of_runs(pr.run_boxes(items, pages)).select("page", "block_id", "text", "x0", "x1", "baseline", F.size("raw_items").alias("n_runs"))


@query()
def l7_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole projection in reading order, with regions, rows and visibility (tested on small pages)."""
    blocks = pr.project_layout(*_pages(spark, sf_dir)).blocks
    return blocks.select("name", "page", "block_id", "text", "role", "region", "place", "row_id", "visibility")


@query("""with w as (select l_orderkey as page, l_linenumber % 2 as line, row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_linenumber, l_partkey, l_suppkey) - 1 as word, 'w' || l_partkey % 5 as text, l_quantity::double as confidence, l_partkey % 100 + 0.0 as x0, l_linenumber + 0.0 as y0 from lineitem),
o as (select page, line, list(text order by word) as own, list(confidence order by word) as sure, list(x0 order by word) as xs, list(y0 order by word) as ys, min(x0) as a, max(x0) + 30 as b, min(y0) as c, max(y0) + 10 as d, count(*) as n from w group by 1, 2),
t as (select *, case page % 4 when 0 then own when 1 then list_transform(own, lambda x: case when x = 'w1' then 'w7' else x end) when 2 then list_concat(own, ['é', '😀x']) else [] end as tokens from o),
u as (select *, (b - a) / greatest(1, length(array_to_string(tokens, ' ')) + case when page % 4 = 2 then 1 else 0 end) as unit from t),
e as (select *, unnest(range(len(tokens))) as i from u),
z as (select *, case when i = 0 then 0 else length(array_to_string(tokens[1:i], ' ')) + 1 end as before from e)
select page, line::int as line, i::int as word, tokens[i + 1] as text, (case when len(tokens) = n and tokens[i + 1] = own[i + 1] then sure[i + 1] else 95 end)::double as confidence,
  round(case when len(tokens) = n then xs[i + 1] else a + before * unit end, 6)::double as x0, (case when len(tokens) = n then ys[i + 1] else c end)::double as y0,
  round(case when len(tokens) = n then xs[i + 1] + 30 else a + (before + length(tokens[i + 1]) + case when page % 4 = 2 and i = len(tokens) - 1 then 1 else 0 end) * unit end, 6)::double as x1, (case when len(tokens) = n then ys[i + 1] + 10 else d end)::double as y1 from z""")
def l18_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of proofread words: kept, or dealt by lengths where a line has got other words."""
    i = c.table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey", F.col("l_linenumber") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    x0, y0 = (F.col("l_partkey") % 100).cast("double"), F.col("l_linenumber").cast("double")
    words = i.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 2).alias("line"), n.alias("word"), F.concat(F.lit("w"), F.col("l_partkey") % 5).alias("text"), F.col("l_quantity").cast("double").alias("confidence"), x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 10).alias("y1"))
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), "  ")
    k = F.col("page") % 4
    told = words.groupBy("page", "line").agg(own.alias("own")).where(k != 0)
    text = F.when(k == 1, F.replace("own", F.lit("w1"), F.lit("w7"))).when(k == 2, F.concat("own", F.lit(" é  😀x"))).otherwise(" ")
    out = l.proofread_words(words, told.select("page", "line", text.alias("text")), ["page"])
    return out.withColumns({"x0": F.round("x0", 6), "x1": F.round("x1", 6)}).withColumn("line", F.col("line").cast("int"))
