"""Queries of exam documents, sessions and the workspace (X3, X8, X9, X16, X19, X20, L6, L12, L16, L20, R1, R7, R10, R14 to R17, R19, V1, V3, S11, S13, S21, V2, V9, V14, V20, G9, G13, K12, H4, H7 to H11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.staging import dealt
from tessera.operators import exam as e
from tessera.operators import extract as x
from tessera.operators import layout as l
from tessera.operators import packages as pk
from tessera.operators import runs as r
from tessera.operators import sentences as sent
from tessera.operators import sessions as s
from tessera.operators import verify as v
from tessera.operators import workspace as w
from tessera.plans import carriers as c
from tessera.sources import intake

#: Orders of the banks that a task holds, about.
ORDERS_PER_TASK = 1 << 16

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pick(k: Column, *values: object) -> Column:
    """The k-th of some values, from 0."""
    return F.element_at(F.array(*(F.lit(x) for x in values)), (k + 1).cast("int"))


def _exam_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a document: the first half are questions of a reading module, the rest of a listening one."""
    o = c.table(spark, sf_dir, "orders")
    own = Window.partitionBy("o_custkey")
    place, n = F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")), F.count("*").over(own)
    o = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), "o_orderpriority", place.alias("number"), F.when(2 * place <= n, 1).otherwise(2).alias("module"))
    line = lambda at, text: F.struct(at.cast("int").alias("line_no"), text.alias("text"))
    k, number = F.col("id"), F.col("number").cast("string")
    asked = F.array(
        line(10 * F.col("number"), F.concat(number, F.lit(". What about "), k, F.lit("?"))), line(10 * F.col("number") + 1, F.concat(F.lit("more on "), k)), line(10 * F.col("number") + 2, F.lit(" (A) yes")),
        line(10 * F.col("number") + 3, F.concat(F.lit("(B) "), "o_orderpriority")),
    )
    keyed = F.when(k % 5 == 0, F.array().cast(asked_type := "array<struct<line_no:int,text:string>>")).otherwise(F.array(line(10 * F.col("number"), F.concat(number, F.lit(". "), _pick(k % 3, "A", "B", "maybe")))))
    keyed = F.when(k % 5 == 1, F.array(line(10 * F.col("number"), F.concat(number, F.lit(" A"))), line(10 * F.col("number") + 1, F.lit("or so")))).otherwise(keyed).cast(asked_type)
    rows = o.select("doc", F.col("module").alias("page"), F.explode(asked).alias("l")).unionByName(o.select("doc", (F.col("module") + 10).alias("page"), F.explode(keyed).alias("l")))
    title = _pick(F.col("module") - 1, "Reading Section, Module 1", "Listening Section, Module 2")
    head = F.array(line(F.lit(0), title), line(F.lit(1), _pick(F.col("module") - 1, "Read an email.", "Listen to a talk.")))
    keys = F.array(line(F.lit(0), F.lit("Answer Key")), line(F.lit(1), title), line(F.lit(2), F.lit("Question Number Answer")))
    pages = o.select("doc", "module").distinct()
    rows = rows.unionByName(pages.select("doc", F.col("module").alias("page"), F.explode(head).alias("l"))).unionByName(pages.select("doc", (F.col("module") + 10).alias("page"), F.explode(keys).alias("l")))
    return rows.select("doc", "page", "l.line_no", "l.text")


_EXAM = """o as (select o_custkey as doc, o_orderkey as id, o_orderpriority, row_number() over w as number, count(*) over (partition by o_custkey) as n from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
q as (select *, case when 2 * number <= n then 1 else 2 end as module, case when 2 * number <= n then 'reading' else 'listening' end as section,
  case when id % 5 = 0 then null when id % 5 = 1 then 'A' || chr(10) || 'or so' else case id % 3 when 0 then 'A' when 1 then 'B' else 'maybe' end end as answer from o)"""


@query(f"""with {_EXAM} select doc, section, module, number::int as number, 'single_choice' as kind, 'What about ' || id || '?' || chr(10) || 'more on ' || id as prompt, 'yes|' || o_orderpriority as options,
  case when answer is null then 'missing' else 'applied' end as state, answer from q where n > 1""")
def x3_exam_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of modular documents with their options and keys; documents of one module are not recognised."""
    out = e.exam_document(_exam_lines(spark, sf_dir), ["doc"])
    return out.withColumn("options", F.array_join(F.transform("options", lambda o: o["text"]), "|"))


@query(f"""with {_EXAM} select doc, section, module, number::int as number, answer from q where answer is not null""")
def x8_read_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer key pages to (section, module, number), with lines that go on."""
    return e.read_keys(_exam_lines(spark, sf_dir), ["doc"])[0]


@query("""with i as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos, l_partkey % 6 as k, l_partkey, l_suppkey from lineitem),
m as (select *, sum(case when k = 0 then 1 else 0 end) over w as modules, max(case when k = 0 then l_suppkey % 3 + 1 end) over g as module from (select *, sum(case when k = 0 then 1 else 0 end) over (partition by doc order by pos) as grp from i) window w as (partition by doc order by pos), g as (partition by doc, grp)),
t as (select *, max(case when k in (0, 1, 5) then pos end) over (partition by doc order by pos) as last_head from m where modules > 0),
n as (select t.*, case when h.k = 1 then 'conversation#' || h.l_suppkey when h.k = 5 then 'academic talk#' || h.l_suppkey end as task from t join t h on h.doc = t.doc and h.pos = t.last_head),
b as (select *, max(case when k in (0, 1, 2, 3, 5) then pos end) over (partition by doc order by pos) as start from n)
select h.doc, h.module, h.task, case h.k when 2 then 'choice' when 3 then 'fill' else 'transcript' end as kind, case h.k when 2 then h.l_suppkey when 3 then 4 end::int as first, case when h.k = 3 then 4 + h.l_suppkey end::int as last,
  case when h.k = 2 then 'B' end as answer, case when h.k = 2 then 'main idea' end as label, coalesce(string_agg('text ' || b.l_partkey, chr(10) order by b.pos) filter (where b.pos > h.pos), '') as body
from b h join b on b.doc = h.doc and b.start = h.pos where h.k in (2, 3, 5) group by h.doc, h.module, h.task, h.k, h.l_suppkey, h.pos""")
def x9_objective_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer sections to choices, fill ranges and transcripts, each with its text; line items as lines."""
    i = c.table(spark, sf_dir, "lineitem")
    k, n = F.col("l_partkey") % 6, F.col("l_suppkey")
    text = F.when(k == 0, F.concat(F.lit("Module "), n % 3 + 1)).when(k == 1, F.concat(F.lit("Conversation # "), n)).when(k == 2, F.concat(n, F.lit(". B, main idea"))).when(k == 3, F.concat(F.lit("4 - "), n + 4))
    text = text.when(k == 5, F.concat(F.lit("Listen to an Academic Talk #"), n, F.lit(" Transcript"))).otherwise(F.concat(F.lit("text "), "l_partkey"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return e.objective_keys(i.select(F.col("l_orderkey").alias("doc"), F.lit("reading").alias("section"), place.alias("line_no"), text.alias("text")), ["doc"]).drop("section")


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a bank: most are a passage with one item, every fifth is a block of keys."""
    # An order becomes up to six lines in the task that it is dealt to.
    o, k = dealt(c.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", rows_per_task=ORDERS_PER_TASK), F.col("o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    n = (k % 3 + 1).cast("string")
    texts = F.when(k % 5 == 0, F.array(F.lit("Answer Key"), F.concat(n, F.lit(" A")), F.lit("explained"))).otherwise(
        F.array(F.concat(F.lit("Passage "), place, F.lit(": about it")), F.concat(n, F.lit(". What about "), k, F.lit("?")), F.lit("more"), F.lit("A. yes"), F.lit("(B) no"), F.when(k % 4 == 0, "Correct answer: b").otherwise(""))
    )
    rows = o.select(F.col("o_custkey").alias("doc"), place.alias("place"), texts.alias("texts")).select("doc", "place", F.posexplode("texts").alias("i", "text"))
    return rows.select("doc", (F.col("place") * 10 + F.col("i")).alias("line_no"), "text")


_BANKED = """o as (select o_custkey as doc, o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders),
g as (select *, sum(case when id % 5 <> 0 then 1 else 0 end) over (partition by doc order by place) as grp from o)"""


@query(f"""with {_BANKED} select doc, place * 10 + 1 as question_id, grp::bigint as "group", (id % 3 + 1)::int as number, 'single_choice' as type, 'What about ' || id || '?' || chr(10) || 'more' as prompt, 'A yes|B no' as options, case when id % 4 = 0 then 'B' else '' end as stated from g where id % 5 <> 0""")
def x5_task_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of banks of single tasks, with their options and the answers that they state."""
    q, _ = e.task_bank(_bank(spark, sf_dir), ["doc"])
    return q.select("doc", "question_id", "group", "number", "type", "prompt", F.array_join(F.transform("options", lambda o: F.concat(o["id"], F.lit(" "), o["text"])), "|").alias("options"), F.array_join("stated", ",").alias("stated"))


@query(f"""with {_BANKED} select doc, (id % 3 + 1)::int as number, (grp + 1)::bigint as block, 'single_choice' as type, 'A' as answer from g where id % 5 = 0""")
def x5_bank_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key blocks of banks, each after the groups that it may answer."""
    return e.task_bank(_bank(spark, sf_dir), ["doc"])[1].select("doc", "number", "block", "type", "answer")


@query("""with o as (select o_orderkey, o_orderkey % 5 as pos, o_orderkey % 7 = 0 as twin from orders)
select o_orderkey, case when not twin then array_to_string(list_filter(range(5), lambda i: i <> pos), ',') end as kept from o""")
def x11_aligned_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: the one way to drop surplus gaps so that lengths fit best; a gap beside its twin leaves two ways, and nothing is dropped."""
    k = F.col("o_orderkey")
    wanted = F.array(*(F.lit(n) for n in (3, 4, 5, 6)))
    at = (k % 5).cast("int")
    extra = F.when(k % 7 == 0, F.get(wanted, F.least(at, F.lit(3)))).otherwise(9)
    lengths = F.concat(F.slice(wanted, F.lit(1), at), F.array(extra), F.slice(wanted, at + 1, F.lit(4)))
    return c.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(x.aligned_blanks(lengths, wanted), ",").alias("kept"))


@query("""select p_partkey, case when p_partkey % 5 in (0, 1) then 'Is the _____ _____ _____ shelf?' when p_partkey % 5 = 4 then 'Is the _____ _____ ' || lower(p_type) || ' shelf?' end as frame, case when p_partkey % 5 in (0, 1) then '1,2,0' when p_partkey % 5 = 4 then '0,1' end as "order",
  case when p_partkey % 5 in (0, 1, 4) then true end as inferred_text, case when p_partkey % 5 in (0, 1) then false when p_partkey % 5 = 4 then true end as left_in_frame, case when p_partkey % 5 in (0, 1) then true when p_partkey % 5 = 4 then false end as looks_whole from part""")
def x12_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences covered by fragments, and what speaks against a cover."""
    k, name, kind = F.col("p_partkey") % 5, F.col("p_name"), F.lower("p_type")
    answer = F.concat(F.lit("Is the "), name, F.lit(" on the "), kind, F.lit(" shelf?"))
    parts = F.when(k == 0, F.array(kind, name, F.lit("on the"))).when(k == 1, F.array(kind, name, F.lit("on the"), F.lit("xyz"))).when(k == 2, F.array(F.lit("the"), name)).when(k == 3, F.array(name))
    parts = parts.otherwise(F.array(name, F.lit("on the"), F.lit("shelfs"), F.lit("a|b")))
    out = c.table(spark, sf_dir, "part").select("p_partkey", sent.covers(answer, parts).alias("c"))
    return out.select("p_partkey", "c.frame", F.array_join("c.order", ",").alias("order"), "c.inferred_text", "c.left_in_frame", "c.looks_whole")


@query("""select p_partkey, p_name || '|on|the' as fragments, 'Is the ' || p_name || ' on the shelf, now.' as answer from part""")
def x14_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces that a scan lost in fragments and in the sentence."""
    name = F.col("p_name")
    parts = F.array(F.replace(name, F.lit(" "), F.lit("")), F.lit("on"), F.lit("the"))
    out = c.table(spark, sf_dir, "part").select("p_partkey", sent.rejoined(F.concat(F.lit("Is the "), name, F.lit(" onthe shelf, now.")), parts).alias("r"))
    return out.select("p_partkey", F.array_join("r.fragments", "|").alias("fragments"), "r.answer")


_MARKED = "'(A)' || substr(t, 1, 5) || '(B)' || substr(t, 6, 5) || '(C)' || substr(t, 11, 5) || '(D)' || substr(t, 16)"


@query("""with b as (select item_id, 'x' || item_id || ' ' || trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g')) || ' end of it all here' as t from benchmark)
select item_id, case when item_id % 4 = 3 then null when item_id % 4 = 2 then 'refused' else 'insertion' end as state, case when item_id % 4 < 2 then 'It fits.' end as sentence,
  case when item_id % 4 < 2 then array_to_string(list_transform([0, 5, 10, 15], lambda p: 6 + length(rtrim(substr(t, 1, p)))), ',') end as positions from b""")
def x16_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a sentence may be put, as offsets in the passage; a paragraph that stands twice is refused."""
    k = F.col("item_id")
    t = F.concat(F.lit("x"), k, F.lit(" "), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", " ")), F.lit(" end of it all here"))
    b = c.table(spark, sf_dir, "benchmark").select("item_id", t.alias("t"))
    marked = F.expr(_MARKED)
    prompt = F.when(k % 4 == 3, "What is it?").otherwise(F.concat(F.lit("There are four locations. Where would the sentence best fit?\nIt fits.\n"), marked))
    passage = F.concat(F.lit("Intro "), F.when(k % 4 == 2, F.concat("t", F.lit(" "))).otherwise(""), "t", F.lit("\n"))
    out = e.insertion_interaction(b.select("item_id", prompt.alias("prompt"), passage.alias("passage")))
    return out.select("item_id", "state", "sentence", F.array_join("positions", ",").alias("positions"))


@query("""with c as (select conv_id, turn, coalesce(replace(text, chr(10), ' '), '') as t, (conv_id + turn) % 4 as k from conversations)
select conv_id, turn, case k when 0 then 'email' when 1 then 'notice' when 2 then 'academic' else 'plain' end as kind, case when k = 0 then 'To=a|Subject=b' else '' end as rows, case when k in (1, 2) then 'A title' else '' end as title,
  case when k = 3 then 'Ends here.' || chr(10) || t else t end as body from c""")
def x19_reading_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading passages to header rows, title and body."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    head = _pick(k, "Read an email.\nTo: a\nSubject: b\n", "Read a notice.\nA title\n", "A title\n", "Ends here.\n")
    t = c.table(spark, sf_dir, "conversations")
    d = t.select("conv_id", "turn", e.reading_document(F.concat(head, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))), k == 2).alias("d"))
    return d.select("conv_id", "turn", "d.kind", F.array_join(F.transform("d.rows", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "|").alias("rows"), "d.title", F.trim("d.body").alias("body"))


@query("""with c as (select conv_id, turn, coalesce(replace(text, chr(10), ' '), '') as t, (conv_id + turn) % 3 as k from conversations)
select conv_id, turn, case when k < 2 then 'Mr. A' end as "to", case when k < 2 then 'Hello' end as subject, case when k = 0 then 'Write it.' || chr(10) || 'You will have 7 minutes to write.' when k = 1 then '' end as instructions,
  case when k < 2 then 'To: Mr. A' || chr(10) || 'Subject: Hello' || chr(10) || t end as body from c""")
def x19_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Email tasks to recipient, subject, instructions and body."""
    k = (F.col("conv_id") + F.col("turn")) % 3
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    prompt = F.concat(F.when(k == 0, "Write it.\nYou will have 7 minutes to write.\n").otherwise(""), F.when(k < 2, "To: Mr. A\n").otherwise(""), F.lit("Subject: Hello\n"), text, F.lit("\nYour Response:\nnone"))
    return c.table(spark, sf_dir, "conversations").select("conv_id", "turn", e.email_presentation(prompt).alias("p")).select("conv_id", "turn", "p.*")


@query("""select o_orderkey, case when k < 2 or k = 4 then 'task' when k in (2, 3) then 'question' else 'inherit_module' end as scope, case when k = 0 and m between 1 and 120 then m * 60 end::int as duration_seconds,
  case when k = 2 then 0 end as prepare_seconds, case when k = 2 or k = 0 and m > 0 then 'document' else 'unknown' end as basis, case when k = 5 then 'Read a notice.' when k < 2 then 'first' when k < 5 then 'Read a notice.' || chr(10) || 'more' else '' end as prefix
from (select o_orderkey, o_orderkey % 7 as k, o_custkey % 130 as m from orders)""")
def x20_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times and instructions that the text of a task prints."""
    k = F.col("o_orderkey") % 7
    kind = _pick(k, "write_email", "academic_discussion", "interview", "listen_repeat", "build_sentence", "read_daily", "read_daily")
    text = F.when(k == 0, F.concat(F.lit("You will have "), F.col("o_custkey") % 130, F.lit(" minutes to write"))).when(k == 2, "No time for preparation will be provided.").otherwise("none")
    passage = F.when(k == 6, "It was.\nRead a notice.").otherwise("Read a notice.\nmore")
    out = c.table(spark, sf_dir, "orders").select("o_orderkey", e.document_timing(kind, text).alias("t"), e.instruction_prefix(kind, passage, F.lit("first\nsecond")).alias("prefix"))
    return out.select("o_orderkey", "t.*", "prefix")


@query("""select p_partkey, case p_partkey % 9 when 0 then 'Question 12: ' || p_name when 1 then '3. B' when 2 then '3. 6 words' when 3 then '6 words ' || p_name when 4 then 'A. ' || 'word' when 5 then 'ab---,' when 6 then 'fr__ therec_' when 7 then 'care____ on' else 'The ____ ____ fantastic.' end as line from part""")
def l12_repair_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a scan glued together or tore apart."""
    k, name = F.col("p_partkey") % 9, F.col("p_name")
    line = F.when(k == 0, F.concat(F.lit("Question12: "), name)).when(k == 3, F.concat(F.lit("6words "), name)).otherwise(_pick(k, "", "3.B", "3.6 words", "", "A.word", "ab—–,", "fr__therec_", "care ___ _ on", "The ____ ____ fantastic."))
    return c.table(spark, sf_dir, "part").select("p_partkey", F.array_join(e.repair_words(F.split(line, " ", -1)), " ").alias("line"))


@query("""with i as (select l_orderkey, l_linenumber, l_partkey % 9 * 90.0 + l_linenumber as x0, l_partkey % 9 * 90.0 + l_linenumber + 40 as x1, 'w' || l_suppkey as text, l_quantity * 2 as confidence from lineitem),
g as (select *, case when x0 - lag(x1) over o > 48 then 1 else 0 end as cut from i window o as (partition by l_orderkey order by x0, x1, text)),
r as (select *, sum(cut) over (partition by l_orderkey order by x0, x1, text) as run from g)
select l_orderkey, run::bigint as run, string_agg(text, ' ' order by x0, x1, text) as text, round(min(x0) / 2, 6)::double as x, round((max(x1) - min(x0)) / 2, 6)::double as width, min(confidence)::double as confidence, count_if(confidence < 60) as low_confidence from r group by 1, 2""")
def l16_ocr_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in pixels to runs in points."""
    i = c.table(spark, sf_dir, "lineitem")
    x0 = (F.col("l_partkey") % 9 * 90 + F.col("l_linenumber")).cast("double")
    words = i.select("l_orderkey", x0.alias("x0"), (x0 + 40).alias("x1"), F.lit(10.0).alias("y0"), F.lit(30.0).alias("y1"), F.concat(F.lit("w"), "l_suppkey").alias("text"), (F.col("l_quantity") * 2).cast("double").alias("confidence"))
    out = e.ocr_runs(words, ["l_orderkey"], F.lit(2.0), F.lit(792.0))
    return out.select("l_orderkey", "run", "text", F.round("x", 6).alias("x"), F.round("width", 6).alias("width"), "confidence", "low_confidence")


@query("""with i as (select l_orderkey, l_linenumber % 2 as row_no, l_partkey % 9 * 60.0 + l_linenumber as x0, l_partkey % 9 * 60.0 + l_linenumber + 40 as x1, 'w' || l_suppkey as text from lineitem),
g as (select *, case when x0 - lag(x1) over o > 24 then 1 else 0 end as cut from i window o as (partition by l_orderkey, row_no order by x0, text)), r as (select *, sum(cut) over (partition by l_orderkey, row_no order by x0, text) as part from g)
select l_orderkey, row_no as "row", part::bigint as part, string_agg(text, ' ' order by x0, text) as text, min(x0)::double as x0, max(x1)::double as x1 from r group by 1, 2, 3""")
def l6_joined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours on one baseline as one line, unless a gutter parts them."""
    x0 = (F.col("l_partkey") % 9 * 60 + F.col("l_linenumber")).cast("double")
    blocks = c.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("row"), x0.alias("x0"), (x0 + 40).alias("x1"), F.concat(F.lit("w"), "l_suppkey").alias("text"))
    return l.joined_rows(blocks, ["l_orderkey"])


@query("""with o as (select o_custkey as page, o_orderkey as id, row_number() over w as n, count(*) over (partition by o_custkey) as m from orders window w as (partition by o_custkey order by o_orderkey))
select page, string_agg(id::varchar, chr(10) order by n) filter (where n <= 2) as prompt, string_agg(id::varchar, chr(10) order by n) filter (where n between 3 and 5) as first_post, string_agg(id::varchar, chr(10) order by n) filter (where n > 5) as second_post
from o where m between 6 and 12 and page % 3 <> 0 group by 1""")
def l20_discussion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and two posts by indent and leading; pages with a crooked line or of one post give none."""
    own = Window.partitionBy("o_custkey")
    n, m = F.row_number().over(own.orderBy("o_orderkey")), F.count("*").over(own)
    o = c.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").cast("string").alias("text"), n.alias("n"), m.alias("m")).where("m <= 12")
    y = 800.0 - F.col("n") * 10 - F.when(F.col("n") > 5, 20).otherwise(0)
    x_ = F.when(F.col("n") <= 2, 50.0).otherwise(90.0) + F.when((F.col("page") % 3 == 0) & (F.col("n") == 4), 10).otherwise(0)
    return e.discussion_posts(o.select("page", "text", x_.alias("x"), y.alias("y")), ["page"])


@query("""select page_id, 'f; page ' || page_id % 4 || case when page_id % 3 = 0 then '; paragraph ' || page_id % 5 else '' end as location, length('[source: f; page ' || page_id % 4 || case when page_id % 3 = 0 then '; paragraph ' || page_id % 5 else '' end || ']' || chr(10) || url)::int as chars, page_id % 4 in (1, 3) as scanned from pages""")
def h4_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: where chunks come from, and whether their page was scanned."""
    k = F.col("page_id")
    chunks = c.table(spark, sf_dir, "pages").select("page_id", F.lit("f").alias("name"), (k % 4).alias("page"), F.when(k % 3 == 0, k % 5).alias("paragraph"), F.col("url").alias("text"))
    scanned = spark.createDataFrame([("f", 1), ("f", 3), ("g", 2)], "name string, page long")
    return e.mark_scanned(e.source_marks(chunks), scanned).select("page_id", "location", F.length("marked").alias("chars"), "scanned")


# Sessions -----------------------------------------------------------------------------------------------------------


@query("""with q as (select o_orderkey as id, o_custkey % 20 as lib, case o_orderkey % 4 when 0 then 'exam' when 1 then 'practice' when 2 then 'other' end as mode, case when o_orderkey % 3 = 0 then o_custkey % 30 end as leg from orders),
l as (select n_nationkey as lib, sha256(n_name) as hash from nation where n_nationkey < 18), g as (select c_custkey as leg, c_custkey % 20 as lib, 'practice' as mode from customer where c_custkey < 28),
s as (select s_suppkey as sid, case when s_suppkey % 2 = 0 then s_suppkey % 15 end as leg, s_suppkey % 3 = 0 as finished from supplier), u as (select leg, min(sid) as sid from s where not finished and leg is not null group by 1),
t as (select q.id, q.leg, coalesce(q.mode, g.mode, 'practice') as mode, hash, u.sid, case when hash is null then 'no_library' when q.leg is not null and (g.mode is null or g.lib <> q.lib) then 'no_legacy' when u.sid is not null then 'reused'
  when coalesce(q.mode, g.mode, 'practice') not in ('practice', 'exam') then 'bad_mode' when q.leg is not null and coalesce(q.mode, g.mode, 'practice') <> g.mode then 'mode_changed' else 'created' end as state from q left join l using (lib) left join g using (leg) left join u using (leg)),
d as (select *, case when state = 'created' and leg is not null and row_number() over (partition by state, leg order by id) > 1 then 'reused' else state end as st from t),
n as (select *, row_number() over (partition by st order by id) + (select count(*) from s) as place from d), f as (select *, case when st = 'created' and place > 1000 then 'full' else st end as fin from n)
select id as request_id, fin as state, case when fin = 'reused' then sid end as session_id, case when fin = 'created' then mode end as mode, case when fin = 'created' then hash end as source_hash from f""")
def r1_create_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sessions with a frozen plan, unfinished ones resumed, up to what a workspace holds."""
    o, k = c.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    requests = o.select(k.alias("request_id"), (F.col("o_custkey") % 20).alias("library_id"), F.when(k % 4 < 3, _pick(k % 4, "exam", "practice", "other", "")).alias("mode"), F.when(k % 3 == 0, F.col("o_custkey") % 30).alias("legacy_id"))
    libraries = c.table(spark, sf_dir, "nation").where("n_nationkey < 18").select(F.col("n_nationkey").alias("library_id"), F.sha2("n_name", 256).alias("content_hash"))
    legacy = c.table(spark, sf_dir, "customer").where("c_custkey < 28").select(F.col("c_custkey").alias("legacy_id"), (F.col("c_custkey") % 20).alias("library_id"), F.lit("practice").alias("mode"))
    q = F.col("s_suppkey")
    sessions = c.table(spark, sf_dir, "supplier").select(q.alias("session_id"), F.when(q % 2 == 0, q % 15).alias("legacy_id"), (q % 3 == 0).alias("finished"))
    return s.create_sessions(requests, libraries, legacy, sessions)


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = c.table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey")
    phase = lambda n: _pick(n % 9, *s.PHASES, "completed")
    return i.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _pick(F.col("l_suppkey") % 4, "reading", "listening", "writing", "speaking").alias("section"), F.when(k % 5 == 0, "exam").otherwise("practice").alias("mode"), F.lit("m1").alias("module"),
        F.when(k % 17 == 0, "m2").otherwise("m1").alias("to_module"), (k % 3).alias("task_index"), ((k + F.col("l_suppkey")) % 3).alias("to_task_index"), (k % 6).alias("question_index"), ((k + F.col("l_linenumber")) % 6).alias("to_question_index"),
        phase(k).alias("phase"), phase(k + F.col("l_suppkey")).alias("to_phase"), _pick(F.col("l_partkey") % 3, "module", "task", "none").alias("back"), (F.col("l_partkey") % 2 == 0).alias("review"), (F.col("l_suppkey") % 2 == 0).alias("lock_on_advance"),
        (k % 13 == 0).alias("locked"), (k % 4 == 0).alias("has_recording"), (k % 7 < 3).alias("started"), (k % 100 * 1000).alias("elapsed_ms"), F.lit(60000).alias("duration_ms"),
    )


_PHASE_SQL = "(['instructions','directions','stimulus','prepare','response','saving','recorded','review','completed'])[({}) % 9 + 1]"


@query(f"""with m as (select *, l_orderkey * 7 + l_linenumber * 3 + l_partkey as k from lineitem),
p as (select *, (['reading','listening','writing','speaking'])[l_suppkey % 4 + 1] as sec, k % 5 = 0 as exam, k % 3 as t, (k + l_suppkey) % 3 as tt, k % 6 as q, (k + l_linenumber) % 6 as tq, {_PHASE_SQL.format('k')} as ph, {_PHASE_SQL.format('k + l_suppkey')} as tp from m),
v as (select *, case when tp = 'completed' then 'bad_phase' when k % 17 = 0 then 'submit_first' when tp in ('saving', 'recorded') and sec <> 'speaking' then 'not_spoken' when tp = 'saving' and (ph not in ('response', 'saving') or q <> tq) then 'not_recording'
  when tp = 'recorded' and k % 4 <> 0 then 'no_recording' when tp = 'response' and ph = 'saving' and q = tq then 'still_saving' when tp = 'response' and ph = 'recorded' and q = tq and exam then 'no_second_take' when k % 13 = 0 then 'locked'
  when l_partkey % 3 = 2 and tq < q or l_partkey % 3 = 1 and tt < t then 'no_way_back' when tp = 'review' and l_partkey % 2 = 1 then 'no_review' when tp = 'response' and sec = 'speaking' and k % 7 < 3 and k % 100 >= 60 then 'time_used_up'
  when sec in ('listening', 'speaking') and k % 7 < 3 and tp in ('instructions', 'directions', 'stimulus', 'prepare') then 'already_answering' else 'accepted' end as verdict from p)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, verdict, case when verdict = 'accepted' and sec = 'writing' then greatest(0, tt - t) else 0 end::bigint as locks_tasks,
  case when verdict = 'accepted' and sec in ('listening', 'speaking') and l_suppkey % 2 = 0 then greatest(0, tq - q) else 0 end::bigint as locks_questions, verdict = 'accepted' and tp = 'response' and ph = 'recorded' and q = tq as assisted from v""")
def r7_cursor_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal moves of a cursor, and what they lock."""
    return s.cursor_moves(_moves(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "verdict", F.col("locks_tasks").cast("long").alias("locks_tasks"), F.col("locks_questions").cast("long").alias("locks_questions"), "assisted")


@query("""select conv_id, turn, case when length(coalesce(text, '')) <= 20000 and turn % 5 <> 0 then coalesce(text, '') end as answer from conversations""")
def r10_normalized_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers within their bounds; lists of over a hundred items are none."""
    answer = F.when(F.col("turn") % 5 == 0, F.array_repeat(F.coalesce("text", F.lit("")), 101)).otherwise(F.when(F.col("text").isNotNull(), F.array("text")))
    return c.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(r.normalized_answer(answer), 0).alias("answer"))


@query("""with e as (select event_id, event_id % 3 as version, event_id % 11 = 0 as finished, event_id % 7 = 0 as closed, event_id * 37 % 90000 as used, case when event_id % 2 = 0 then 1000000 - event_id * 53 % 80000 end as since, case when event_id % 5 <> 0 then 850000 end as started from events),
m as (select *, version < 2 and not finished and not closed as mv, least(120000, used + case when since is null then 0 else greatest(0, 1000000 - since) end) as el from e),
u as (select *, started is not null and el >= 60000 as up from m)
select event_id, mv as upgraded, case when mv then least(60000, el) else used end as applied_ms, case when mv and not up and since is not null then 1000000 + 60000 - el end as deadline_ms,
  case when mv and up then least(1000000, case when since is not null and used < 60000 then since + 60000 - used else least(1000000, started + 60000) end) end as expired_ms, case when mv and not up and since is not null then 1000000 when not mv then since end as running_since_ms, case when mv then 2 else version end as version from u""")
def r14_upgrade_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks brought to the present policy without granting time."""
    k = F.col("event_id")
    t = c.table(spark, sf_dir, "events").select(
        "event_id", (k % 3).alias("version"), (k % 11 == 0).alias("finished"), (k % 7 == 0).alias("closed"), (k * 37 % 90000).alias("consumed_ms"), F.when(k % 2 == 0, 1000000 - k * 53 % 80000).alias("running_since_ms"), F.when(k % 5 != 0, F.lit(850000).cast("long")).alias("started_ms"),
        F.lit(120000).cast("long").alias("old_duration_ms"), F.lit(60000).cast("long").alias("duration_ms"), F.lit(1000000).cast("long").alias("at_ms"),
    )
    return s.upgrade_clocks(t).select("event_id", "upgraded", "applied_ms", "deadline_ms", "expired_ms", "running_since_ms", "version")


@query("""with s as (select o_custkey as sid, min(o_orderkey) as q from orders group by 1), t as (select o_custkey as sid, o_orderkey % 2 as m, o_orderkey % 4 as tk, o_orderkey as tq, case o_orderkey % 3 when 0 then 'module' when 1 then 'task' else 'question' end as scope, o_orderkey % 5 <> 0 as started, o_orderkey % 7 = 0 as closed from orders),
j as (select s.sid, s.q, bool_or(scope = 'question' and tq = s.q and m = s.q % 2) as own, count_if(scope <> 'question' and not closed and m = s.q % 2 and (scope = 'module' or tk = s.q % 4)) as n from s join t using (sid) where started and s.sid % 4 <> 0 and s.sid % 9 <> 0 group by 1, 2)
select sid as session_id, q as question_id, n as shared_timers from j where not own and n > 0""")
def r15_speaking_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken questions for which only shared clocks ran."""
    o, k = c.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = F.col("question_id")
    sessions = o.groupBy(F.col("o_custkey").alias("session_id")).agg(F.min(k).alias("question_id")).select("session_id", (F.col("session_id") % 9 == 0).alias("finished"), F.when(F.col("session_id") % 4 == 0, "writing").otherwise("speaking").alias("section"), F.lit("interview").alias("task_kind"), (first % 2).alias("module_id"), (first % 4).alias("task_id"), "question_id")
    timers = o.select(F.col("o_custkey").alias("session_id"), (k % 2).alias("module_id"), (k % 4).alias("task_id"), k.alias("question_id"), _pick(k % 3, "module", "task", "question").alias("scope"), F.lit("response").alias("phase"), (k % 5 != 0).alias("started"), (k % 7 == 0).alias("closed"))
    return s.speaking_conflicts(sessions, timers)


@query("""with e as (select event_id, case when event_id % 6 <> 0 then 500000 + event_id % 1000 end as st, case when event_id % 4 <> 0 then 500000 + (event_id * 31) % 300000 - 3000 end as cap, 500000 + (event_id * 17) % 300000 as now from events),
s as (select *, coalesce(cap, now) as asked, least(now, greatest(st, coalesce(cap, now))) as stop from e),
v as (select *, case when st is null then 'not_started' when asked > now + 1000 or asked < st - 1000 then 'not_this_phase' when now > stop + 120000 then 'too_late' else 'accepted' end as verdict from s)
select event_id, verdict, case when verdict = 'accepted' then stop end as stopped_ms, case when verdict = 'accepted' then stop + 120000 end as expires_ms from v""")
def r16_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When recordings stopped, and until when they may be saved."""
    k = F.col("event_id")
    t = c.table(spark, sf_dir, "events").select("event_id", F.when(k % 6 != 0, 500000 + k % 1000).alias("started_ms"), F.when(k % 4 != 0, 500000 + k * 31 % 300000 - 3000).alias("captured_ms"), (500000 + k * 17 % 300000).alias("at_ms"))
    return s.finalize_recordings(t).select("event_id", "verdict", "stopped_ms", "expires_ms")


_AUDITED = """a as (select o_orderkey as id, case when o_orderkey % 19 = 0 then 'race' else 'exam' end as mode, o_orderkey % 4 as version, o_orderkey % 3 = 0 as has_upgrade, o_orderkey % 4 - 1 + case when o_orderkey % 23 = 0 then 1 else 0 end as from_version, o_orderkey % 4 as to_version, o_orderkey * 11 % 70000 as used,
  60000 as dur, case when o_orderkey % 2 = 0 then 100000 end as since, 100000 + o_orderkey % 500 as up, o_orderkey * 11 % 70000 + case when o_orderkey % 2 = 0 then o_orderkey % 500 else 0 end + case when o_orderkey % 29 = 0 then 1 else 0 end as obs, least(60000, o_orderkey * 11 % 70000) as app,
  case when o_orderkey % 5 = 0 then 'submitted' else 'active' end as status, case when o_orderkey % 10 = 0 then 1 end as sub, o_custkey as started, o_custkey + o_orderkey % 7 - 1 as updated, o_orderkey % 31 as revision from orders)"""


@query(f"""with {_AUDITED}, i as (
select id, 'unknown mode' as m from a where mode = 'race' union all select id, 'policy of the future' from a where version > 2 union all select id, 'first policy with an upgrade record' from a where version = 0 and has_upgrade
union all select id, 'upgrade to another version' from a where has_upgrade and not (from_version < version and to_version = version) union all select id, 'consumed beyond the budget' from a where used > dur
union all select id, 'observed time differs from the clock' from a where has_upgrade and obs <> used + case when since is null then 0 else greatest(0, up - since) end union all select id, 'applied time beyond the budget' from a where has_upgrade and app > least(obs, dur)
union all select id, 'submitted module without submission' from a where status = 'submitted' and sub is null union all select id, 'updated before the start' from a where updated < started union all select id, 'no revision' from a where revision < 1)
select 'error' as severity, m as message, id::varchar as path from i""")
def r17_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken invariants of restored sessions."""
    o, k = c.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    used, up = k * 11 % 70000, 100000 + k % 500
    t = o.select(
        k.alias("session_id"), F.when(k % 19 == 0, "race").otherwise("exam").alias("mode"), (k % 4).alias("version"), (k % 3 == 0).alias("has_upgrade"), (k % 4 - 1 + (k % 23 == 0).cast("int")).alias("from_version"), (k % 4).alias("to_version"), used.alias("consumed_ms"), F.lit(60000).alias("duration_ms"),
        F.when(k % 2 == 0, 100000).alias("running_since_ms"), up.alias("upgraded_ms"), (used + F.when(k % 2 == 0, k % 500).otherwise(0) + (k % 29 == 0).cast("int")).alias("observed_ms"), F.least(F.lit(60000), used).alias("applied_ms"), F.when(k % 5 == 0, "submitted").otherwise("active").alias("status"),
        F.when(k % 10 == 0, 1).alias("submitted_ms"), F.col("o_custkey").alias("started_ms"), (F.col("o_custkey") + k % 7 - 1).alias("updated_ms"), (k % 31).alias("revision"),
    )
    return s.audit_sessions(t)


@query("""with r as (select c_custkey as sid, case when c_custkey % 3 = 0 then 'exam' else 'practice' end as mode, c_custkey % 5 = 0 as fin, c_custkey % 7 as rev, c_custkey % 2 = 0 as allq from customer), f as (select o_custkey as sid, min(o_orderkey) as q from orders group by 1),
q as (select o_orderkey as id, o_custkey as sid, case when o_orderkey % 8 = 0 then o_custkey % 7 + 1 else o_custkey % 7 end as rev, case when o_orderkey % 10 = 0 then o_orderkey else f.q end as asked, case when o_orderkey % 3 = 0 then 'answers' end as panel from orders join f on f.sid = o_custkey),
v as (select q.*, r.fin, r.allq, f.q as now, case when r.mode is null then 'no_session' when r.mode = 'exam' and not fin then 'exam_running' when q.rev <> r.rev then 'page_changed' when asked <> f.q then 'question_changed' else 'shown' end as verdict from q left join r using (sid) left join f using (sid))
select v.id as request_id, verdict, o.o_orderkey as shown_question, case when o.o_orderkey is not null and panel = 'answers' then o.o_orderstatus end as answer from v left join orders o on verdict = 'shown' and not fin and o.o_custkey = v.sid and (allq or o.o_orderkey = v.asked)""")
def r19_page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a helper may see of the present page; keys only where the panel of answers is open."""
    cust, o, k = F.col("c_custkey"), c.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = o.groupBy(F.col("o_custkey").alias("session_id")).agg(F.min(k).alias("first"))
    runs = c.table(spark, sf_dir, "customer").select(cust.alias("session_id"), F.when(cust % 3 == 0, "exam").otherwise("practice").alias("mode"), (cust % 5 == 0).alias("finished"), (cust % 7).alias("revision"), F.lit("t").alias("task_id"), F.lit("response").alias("phase"), (cust % 2 == 0).alias("all_questions"))
    runs = runs.join(first, "session_id").withColumnRenamed("first", "question_id")
    asked = o.select(k.alias("request_id"), F.col("o_custkey").alias("session_id")).join(first, "session_id")
    i = F.col("request_id")
    asked = asked.select("request_id", "session_id", (F.col("session_id") % 7 + (i % 8 == 0).cast("int")).alias("revision"), F.when(i % 10 == 0, i).otherwise(F.col("first")).alias("question_id"), F.lit("response").alias("phase"), F.when(i % 3 == 0, "answers").alias("panel"))
    questions = o.select(F.col("o_custkey").alias("session_id"), F.lit("t").alias("task_id"), k.alias("question_id"), F.lit("p").alias("prompt"), F.lit("o").alias("options"), F.lit(None).cast("string").alias("saved"), F.col("o_orderstatus").alias("answer"))
    return s.page_context(runs, questions, asked).select("request_id", "verdict", "shown_question", "answer")


# Workspace ----------------------------------------------------------------------------------------------------------


@query("""with e as (select event_id as id, case event_id % 6 when 0 then 'playable' when 1 then 'partial' when 2 then 'failed' when 3 then 'broken' when 4 then 'partial' else 'notChecked' end as st, event_id % 100 - 5.0 as act, event_id % 120 * 1.0 as con, case when event_id % 4 = 0 then event_id % 9 - 1.0 end as mis, event_id % 2 = 0 as loc, event_id % 5 - 1.0 as a, event_id % 7 * 1.0 as b from events),
k as (select *, st <> 'broken' as known, case when st <> 'broken' and act >= 0 then act end as ga, case when st <> 'broken' and con >= 0 then con end as gc, case when st <> 'broken' and mis >= 0 then mis end as gm, a >= 0 and b >= a as good from e)
select id as event_id, case when known then st else 'failed' end as decode_state, ga::double as actual_seconds, coalesce(gm, case when ga is not null and gc is not null then greatest(0, gc - ga) end)::double as missing_seconds,
  case when st = 'partial' and loc and good then 'known' when st = 'partial' then 'unknown' else 'notApplicable' end as missing_location, case when st = 'partial' and loc and good then 1 else 0 end as ranges from k""")
def s11_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoder reports as evidence."""
    k = F.col("event_id")
    span = F.array(F.struct((k % 5 - 1.0).alias("start"), (k % 7 * 1.0).alias("end")))
    t = c.table(spark, sf_dir, "events").select("event_id", _pick(k % 6, "playable", "partial", "failed", "broken", "partial", "notChecked").alias("state"), (k % 100 - 5.0).alias("actual"), (k % 120 * 1.0).alias("container"), F.when(k % 4 == 0, k % 9 - 1.0).alias("missing"), F.when(k % 2 == 0, "known").alias("location"), span.alias("ranges"))
    return w.normalize_probe(t).select("event_id", "decode_state", "actual_seconds", "missing_seconds", "missing_location", F.size("missing_ranges").alias("ranges"))


@query("""select page_id, case when page_id % 5 <> 3 then url end as text, page_id % 5 not in (3, 4) as readable from (select page_id, case when page_id % 5 = 4 then url || chr(1) else url end as url from pages)""")
def s13_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes with or without a mark of their order to text; what is no text is null, control characters make it unreadable."""
    k, url = F.col("page_id") % 5, F.col("url")
    data = F.when(k == 0, F.encode(url, "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(url, "UTF-16LE"))).when(k == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(url, "UTF-16BE"))).when(k == 3, F.concat(F.encode(url, "UTF-8"), F.unhex(F.lit("C3"))))
    t = c.table(spark, sf_dir, "pages").select("page_id", intake.decode_text(data.otherwise(F.concat(F.encode(url, "UTF-8"), F.unhex(F.lit("01"))))).alias("text"))
    return t.select("page_id", "text", F.coalesce(intake.readable(F.col("text")), F.lit(False)).alias("readable"))


@query()
def s21_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and digest of each table of a backup; the digest does not depend on the order of rows (tested)."""
    return w.backup_digest({name: c.table(spark, sf_dir, name) for name in ("customer", "events", "orders", "part", "supplier")})


@query("""with p as (select p_partkey as id, p_partkey % 6 as k from part)
select id, 'error' as severity, 'not JSON' as message from p where k = 0 union all select id, 'error', 'unknown version' from p where k = 1 union all select id, 'error', 'groups missing' from p where k = 2 union all select id, 'error', 'groups has another type' from p where k = 3 union all select id, 'error', 'title missing' from p where k = 4""")
def v2_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: packages held against their schema."""
    pack = _pick(F.col("p_partkey") % 6, "{", '{"schemaVersion":1,"title":"a","groups":[]}', '{"schemaVersion":2,"title":"a"}', '{"schemaVersion":2,"title":"a","groups":"x"}', '{"schemaVersion":2,"groups":[]}', '{"schemaVersion":2,"title":"a","groups":[{"id":"g"}]}')
    t = c.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pack.alias("pack"))
    return w.structure_issues(t, "pack", "title string, groups array<struct<id:string>>", ["title", "groups"])


_BACKUP = """t as (select case when event_id % 50 = 0 then event_id - 1 else event_id end as aid, user_id % 40 as sid, event_type as lib, user_id % 13 as q, event_id as seq from events),
k as (select *, row_number() over (partition by lib, q order by seq, aid) as n from t), a as (select *, case when (n = 1) <> (seq % 61 = 0) then 'first' else 'retry' end as kind from k),
h as (select o_custkey as cid, o_orderkey as seq, case when o_orderkey % 37 = 0 then 0 else row_number() over (partition by o_custkey order by o_orderkey) end as rev from orders)"""


@query(f"""with {_BACKUP}
select 'attempt_id used twice' as message, aid::varchar as path from a group by aid having count(*) > 1 union all select 'session_id not found', aid::varchar from a where sid > 35 union all select 'library_id not found', s::varchar from (select unnest(range(36)) as s) where s % 6 = 5
union all select 'kind does not follow', aid::varchar from a where kind <> case when n = 1 then 'first' else 'retry' end union all select 'content has another hash', 'purchase' union all select 'revision falls', cid::varchar from (select cid, rev - lag(rev) over (partition by cid order by seq) as step from h) where step < 0""")
def v9_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: broken invariants of a backup."""
    k = F.col("event_id")
    t = c.table(spark, sf_dir, "events").select(F.when(k % 50 == 0, k - 1).otherwise(k).alias("attempt_id"), (F.col("user_id") % 40).alias("session_id"), F.col("event_type").alias("library_id"), (F.col("user_id") % 13).alias("question_id"), k.alias("seq"))
    n = F.row_number().over(Window.partitionBy("library_id", "question_id").orderBy("seq", "attempt_id"))
    attempts = t.withColumn("kind", F.when((n == 1) != (F.col("seq") % 61 == 0), "first").otherwise("retry"))
    types = ("click", "view", "purchase", "login", "logout")
    sessions = spark.range(36).select(F.col("id").alias("session_id"), F.when(F.col("id") % 6 == 5, "gone").otherwise("purchase").alias("library_id"))
    libraries = spark.createDataFrame([(x,) for x in types], "library_id string").select("library_id", F.col("library_id").alias("content"), F.sha2(F.when(F.col("library_id") == "purchase", "other").otherwise(F.col("library_id")), 256).alias("content_hash"))
    o = c.table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    history = o.select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 37 == 0, 0).otherwise(place).alias("revision"))
    return w.backup_issues(attempts, sessions, libraries, history)


@query("""select item_id, p - 1 as word, case when p % 2 = 1 then 90 else 70 end::double as confidence, p % 2 = 0 as low_confidence, wd as text from (select item_id, unnest(string_split(coalesce(text, ''), ' ')) as wd, unnest(range(1, len(string_split(coalesce(text, ''), ' ')) + 1)) as p from benchmark) where p % 3 <> 0""")
def v14_flatten_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested blocks of a scan to words that lie on the page; every third word lies outside."""
    words = F.transform(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda t, i: F.struct(t.alias("text"), F.when(i % 2 == 0, 90.0).otherwise(70.0).alias("confidence"), (i % 3 * 50.0).alias("x0"), F.lit(0.0).alias("y0"), (i % 3 * 50.0 + 10).alias("x1"), F.lit(9.0).alias("y1")))
    tree = F.array(F.struct(F.array(F.struct(F.array(F.struct(words.alias("words"))).alias("lines"))).alias("paragraphs")))
    out = v.flatten_ocr(c.table(spark, sf_dir, "benchmark").select("item_id", tree.alias("tree")), "tree", F.lit(100.0), F.lit(100.0))
    return out.select("item_id", "word", "confidence", "low_confidence", "text")


@query("""with r as (select o_orderkey as id, o_orderkey % 12 as k, o_custkey % 25 as job, sha256(n_name) as asset from orders join nation on n_nationkey = o_custkey % 25),
t as (select *, case when k % 3 = 0 then 'source.read' when k % 3 = 1 then 'media.probe' else 'media.transcribe' end as tool from r)
select id as request_id, case when k = 11 then 'invalid_request' when k = 10 then 'invalid_assets' when k = 8 then 'invalid_budget' when job >= 20 then 'no_job' when job % 4 = 0 or k % 3 = 1 and job % 5 = 0 then 'not_approved' when tool = 'media.transcribe' and job % 2 = 0 then 'asr_not_approved'
  when tool <> 'source.read' and (job % 3 = 0 or job % 7 = 0) then 'asset_outside_scope' when k = 6 then 'source_outside_scope' else 'approved' end as verdict from t""")
def v20_tool_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool requests held against their job's scope and budget."""
    k = F.col("o_orderkey") % 12
    names = c.table(spark, sf_dir, "nation").select((F.col("n_nationkey")).alias("job_id"), F.sha2("n_name", 256).alias("asset"))
    o = c.table(spark, sf_dir, "orders").withColumn("job_id", F.col("o_custkey") % 25).join(names, "job_id")
    tool = _pick(k % 3, "source.read", "media.probe", "media.transcribe")
    ids = F.when(k == 10, F.array(F.lit("x"))).when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("asset"))
    budget = lambda ms: F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("key"), x.cast("double").alias("value")) for n, x in (("timeout_ms", ms), ("max_output_bytes", F.lit(1000)), ("max_input_bytes", F.lit(5000)), ("max_duration_seconds", F.lit(60))))))
    requests = o.select(F.col("o_orderkey").alias("request_id"), "job_id", tool.alias("tool"), F.when(k == 11, 0).otherwise(1).alias("generation"), ids.alias("asset_ids"), budget(F.when(k == 8, 10_000_000).otherwise(1000)).alias("budget"), F.lit(0).alias("read_from"), F.when(k == 6, 20_000).otherwise(100).alias("read_to"))
    j = F.col("job_id")
    tools = F.when(j % 5 == 0, F.array(F.lit("source.read"), F.lit("media.transcribe"))).otherwise(F.array(F.lit("source.read"), F.lit("media.probe"), F.lit("media.transcribe")))
    jobs = names.where("job_id < 20").select("job_id", F.when(j % 4 == 0, "completed").otherwise("running").alias("state"), tools.alias("tools"), F.when(j % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("asset")).alias("asset_ids"), j.alias("material_id"), F.lit(1).alias("revision"), (j % 2 == 1).alias("allow_asr"))
    assets = names.select(F.col("asset").alias("asset_id"), j.alias("material_id"), F.lit(1).alias("revision"), F.when(j % 7 == 0, 6000).otherwise(400).alias("size"))
    return w.tool_verdicts(requests, jobs, assets)


@query("""with q as (select o_custkey as material_id, o_orderkey % 3 as group_no, o_orderkey as question_no, case when o_orderkey % 5 = 0 then ' ' else o_clerk end as prompt, case when o_orderkey % 2 = 0 then o_orderstatus end as answer from (select *, o_orderpriority as o_clerk from orders) where o_custkey % 4 <> 0),
g as (select *, sha256(concat_ws(':', 'group', sha256('document:' || material_id), group_no, 't' || group_no)) as group_ref from q)
select material_id, group_no, question_no, group_ref, case when trim(prompt) = '' then 'missing' else 'known' end as prompt_state, case when answer is null then 'missing' else 'known' end as answer_state, 1 as revision from g""")
def g9_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages to candidates that depend on their group's artifact; materials with a set of candidates are left alone."""
    o, k = c.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    q = o.select(F.col("o_custkey").alias("material_id"), (k % 3).alias("group_no"), F.concat(F.lit("t"), k % 3).alias("title"), k.alias("question_no"), F.when(k % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("prompt"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("answer"))
    return w.ingest_packs(q, o.where("o_custkey % 4 = 0").select(F.col("o_custkey").alias("material_id")))[1]


@query("""select o_orderkey, case when o_orderkey % 9 = 0 then 'epoch_required' when o_orderkey % 7 = 0 then 'stale_epoch' when c_custkey % 10 = 0 then 'restoring' when o_orderkey % 4 <> c_nationkey % 4 then 'stale_revision' else 'accepted' end as verdict from orders join customer on c_custkey = o_custkey""")
def g13_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of a stale epoch or revision are refused."""
    k = F.col("o_orderkey")
    writes = c.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(k % 9 == 0, "").when(k % 7 == 0, "old").otherwise("now").alias("epoch"), (k % 4).cast("long").alias("expected_revision"))
    cust = c.table(spark, sf_dir, "customer")
    current = cust.select(F.col("c_custkey").alias("o_custkey"), F.lit("now").alias("now_epoch"), (F.col("c_nationkey") % 4).cast("long").alias("now_revision"), (F.col("c_custkey") % 10 == 0).alias("restoring"))
    return w.fence(writes, current, ["o_custkey"]).select("o_orderkey", "verdict")


@query("""with p as (select item_id as id, item_id % 8 as k, text from benchmark where text is not null)
select id as source_id, 'prompt' as field, case k when 0 then 'no_question' when 1 then 'kind_changed' when 2 then 'quote_not_found' when 3 then 'other_owner' when 4 then 'host_value_kept' when 5 then 'not_covered' when 6 then 'not_covered' else 'adopted' end as verdict from p""")
def k12_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's proposals held against the blocks and fields of their chunk."""
    k = F.col("item_id") % 8
    b = c.table(spark, sf_dir, "benchmark").where("text is not null")
    part = F.substring("text", 1, 12)
    proposals = b.select(F.col("item_id").alias("source_id"), F.when(k == 1, "other").otherwise("email").alias("task_kind"), F.lit("prompt").alias("field"), F.when(k == 5, F.concat(part, F.lit("§"))).otherwise(part).alias("value"), F.col("item_id").alias("block_id"), F.when(k == 2, F.concat("text", F.lit("§"))).otherwise(F.col("text")).alias("quote"))
    questions = b.where(k > 0).select(F.col("item_id").alias("source_id"), F.lit("email").alias("task_kind"), F.when(k == 4, "host").alias("host_value"), F.array(F.when(k == 3, -1).otherwise(F.col("item_id"))).alias("own_blocks"))
    blocks = b.select(F.col("item_id").alias("block_id"), "text", F.when(k == 6, "reference").otherwise("source").alias("visibility"))
    return w.judge_proposals(proposals, questions, blocks)


@query("""with p as (select p_partkey as id, p_partkey % 6 as k, p_partkey % 4 as f from part)
select id, k not in (1, 2, 3) as accepted, case when k not in (1, 2, 3) then case when f = 0 then 'known' else 'ambiguous' end end as prompt_state, case when k not in (1, 2, 3) then 'missing' end as answer_state, case when k not in (1, 2, 3) then case when f < 2 then 'source' else 'reference' end end as visibility,
  case when k not in (1, 2, 3) then case when f = 0 then 0 when id % 2 = 0 then 2 else 1 end end::int as n_open from p""")
def h7_ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: candidates of scanned pages; known only where all six flags of the review are true."""
    k, f = F.col("p_partkey") % 6, F.col("p_partkey") % 4
    option = lambda i, t: F.struct(F.lit(i).alias("id"), F.lit(t).alias("text"))
    options = F.when(k == 1, F.array(option("A", "x"))).when(k == 2, F.array(option("A", "x"), option("A", "y"))).otherwise(F.array(option("A", "x"), option("B", "y")))
    review = F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("key"), (f < 2 if n == "answer_safe" else f == 0).alias("value")) for n in w.REVIEW_FLAGS)))
    t = c.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"), options.alias("options"), F.when(k == 3, " ").otherwise("text").alias("passage"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("number_conflict"))).alias("evidence_issues"), review.alias("review"))
    return w.ocr_candidates(t).select("id", "accepted", "prompt_state", "answer_state", "visibility", F.size("open_issues").alias("n_open")).withColumn("n_open", F.when(F.col("accepted"), F.col("n_open")))


@query("""with c as (select c_custkey as id, c_nationkey % 3 as rev from customer), r as (select o_custkey as id, list_distinct(list('a' || o_orderkey % 4 order by o_orderkey)) as new from orders join c on c.id = o_custkey where o_orderkey % 5 <> 0 and o_orderkey % 3 = rev group by 1)
select c.id as candidate_id, (rev + case when len(list_filter(coalesce(new, []), lambda x: x <> 'a0')) > 0 then 1 else 0 end)::int as revision, len(list_distinct(['a0'] || coalesce(new, [])))::int as n_evidence from c left join r using (id)""")
def h8_tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: completed tool results become evidence, and revisions grow where it's new."""
    k = F.col("o_orderkey")
    candidates = c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), (F.col("c_nationkey") % 3).cast("int").alias("revision"), F.array(F.lit("a0")).alias("evidence"))
    results = c.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate_id"), (k % 3).cast("int").alias("expected_revision"), k.alias("seq"), F.concat(F.lit("a"), k % 4).alias("artifact"), F.when(k % 5 == 0, "failed").otherwise("completed").alias("state"))
    return w.apply_tool_results(candidates, results).select("candidate_id", "revision", F.size("evidence").alias("n_evidence"))


@query("""with a as (select o_custkey as job, o_orderkey as asset, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n, count(*) over (partition by o_custkey) as total from orders)
select job, asset, total, case when job % 3 + 4 < total then job % 3 + 4 end as next_offset from a where n >= job % 3 and n < job % 3 + 4""")
def h9_asset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: a page of each job's assets."""
    a = c.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("asset"))
    return w.asset_page(a, ["job"], ["asset"], F.col("job") % 3, 4)


@query("""select item_id, case when item_id % 3 = 0 then null when item_id % 3 = 1 then substr(text, 3, 7) else null end as read from benchmark""")
def h9_read_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: bounded reading of source blocks; ranges that aren't there give nothing."""
    b = c.table(spark, sf_dir, "benchmark").select("item_id", "text")
    k = F.col("item_id") % 3
    asked = b.select("item_id", F.when(k == 0, 5).otherwise(2).alias("start"), F.when(k == 0, 5).when(k == 1, 9).otherwise(1_000_000).alias("end"))
    return w.read_source(asked, b, ["item_id"]).select("item_id", "read")


@query("""select p_partkey, p_partkey % 4 = 0 as decoded, case when p_partkey % 4 = 0 and p_partkey % 8 = 0 then p_size * 1.0 end::double as range_end, case when p_partkey % 4 = 0 then 'mp3' end as codec from part""")
def h10_decode_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixed decoder saw is kept as evidence, other engines are not."""
    p, k = c.table(spark, sf_dir, "part"), F.col("p_partkey")
    probes = p.select("p_partkey", F.when(k % 2 == 0, "ffprobe+ffmpeg").otherwise("other").alias("engine"), F.when(k % 4 == 0, "cpu").otherwise("gpu").alias("device"), F.col("p_size").cast("double").alias("actual_seconds"), F.when(k % 8 == 0, "playable").otherwise("partial").alias("decode_state"), F.lit("mp3").alias("codec"))
    return w.decode_evidence(p.select("p_partkey"), probes, ["p_partkey"])


@query("""with e as (select sha256((o_orderkey // 2)::varchar) as ref, o_orderkey as job, o_orderkey % 3 as chunk, o_orderkey % 210 as page, o_custkey as material from orders)
select ref, max(job) as job_id, arg_max(chunk, job) as chunk_id, arg_max(page, job) as page, arg_max(material, job) as material_id from e where page between 1 and 200 and job % 4 <> 0 and job % 5 <> 0 and chunk <> 2 group by 1""")
def h11_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of pages that a completed chunk of a present job vouches for."""
    o, k = c.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    evidence = o.select(F.sha2(F.expr("o_orderkey div 2").cast("string"), 256).alias("ref"), k.alias("job_id"), (k % 3).alias("chunk_id"), (k % 210).alias("page"), F.lit("needs_review").alias("state"))
    chunks = o.select(k.alias("job_id"), (k % 3).alias("chunk_id"), F.when(k % 3 == 2, "failed").otherwise("completed").alias("state"), F.sha2(k.cast("string"), 256).alias("checkpoint"))
    jobs = o.select(k.alias("job_id"), F.col("o_custkey").alias("material_id"), F.when(k % 4 == 0, "failed").otherwise("completed").alias("state"), F.lit(1).alias("revision"), F.when(k % 5 == 0, 2).otherwise(1).alias("now_revision"))
    return w.ocr_proofs(evidence, chunks, jobs).select("ref", "job_id", "chunk_id", "page", "material_id")


_PACKED = """q as (select o_orderkey as id, o_custkey as pack, (['single_choice','sentence_order','fill_blank','listen_repeat','essay'])[o_orderkey % 5 + 1] as type, o_orderkey % 7 as k, o_orderkey % 11 as m, o_orderkey % 13 as t from orders),
i as (select *, case when m = 0 then 'bad id' when m = 1 then 'same' else 'q' || id end as qid, case when k = 0 then ['A'] when k = 1 then ['A', 'A'] else ['A', 'B'] end as opts, case when k = 2 then [] when k = 3 then ['C'] when k = 4 then ['A', 'B'] when k = 5 then ['A', 'A'] else ['A'] end as ans, case when t = 1 then 7201 when t = 2 then -1 when t = 3 then 0 end as tl from q)"""


@query(f"""with {_PACKED}, r as (
select id, 'error' as severity, 'id empty or with other characters' as message from i where m = 0 union all select id, 'error', 'unknown type' from i where type = 'essay' union all select id, 'error', 'prompt empty' from i where m = 2
union all select id, 'error', 'option id twice' from i where k = 1 union all select id, 'error', 'fewer than two options' from i where type in ('single_choice', 'sentence_order') and k = 0
union all select id, 'warning', 'no standard answer' from i where type in ('single_choice', 'fill_blank', 'sentence_order') and len(ans) = 0 union all select id, 'error', 'answer is no option' from i where type = 'single_choice' and len(ans) > 0 and not (len(ans) = 1 and list_contains(opts, ans[1]))
union all select id, 'error', 'order does not fill the slots' from i where type = 'sentence_order' and len(ans) > 0 and not (len(ans) = len(opts) and len(list_distinct(ans)) = len(ans) and len(list_filter(ans, lambda a: not list_contains(opts, a))) = 0)
union all select id, 'warning', 'no sentence to repeat' from i where type = 'listen_repeat' and len(ans) = 0 union all select id, 'error', 'several sentences to repeat' from i where type = 'listen_repeat' and len(ans) > 1
union all select id, 'error', 'time out of bounds' from i where t in (1, 2) union all select id, 'error', 'question id twice' from (select id, row_number() over (partition by pack, qid order by id) as n from i) where n > 1),
g as (select c_custkey as id, case when c_custkey % 4 = 0 then 'maths' else 'reading' end as section, (select count(*) from orders where o_custkey = c_custkey) as n from customer)
select severity, message, 'q' || id as path from r union all select 'error', 'unknown section', 'g' || id from g where section = 'maths' union all select 'error', 'group without questions', 'g' || id from g where n = 0
union all select 'error', 'unknown schema version', 'p' || c_custkey from customer where c_custkey % 9 = 0 union all select 'error', 'not 1 to 100 groups', 'p' || c_custkey from customer where c_custkey % 10 = 0 union all select 'error', 'title empty', 'p' || c_custkey from customer where c_custkey % 14 = 0""")
def v1_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: the rules of packages, groups and questions, each table in one pass, and ids used twice."""
    o, k = c.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    letters = lambda *x_: F.array(*map(F.lit, x_))
    none = F.array().cast("array<string>")
    ids = F.when(k % 7 == 0, letters("A")).when(k % 7 == 1, letters("A", "A")).otherwise(letters("A", "B"))
    answer = F.when(k % 7 == 2, none).when(k % 7 == 3, letters("C")).when(k % 7 == 4, letters("A", "B")).when(k % 7 == 5, letters("A", "A")).otherwise(letters("A"))
    questions = o.select(
        F.col("o_custkey").alias("pack"), F.concat(F.lit("q"), F.lpad(k.cast("string"), 12, "0")).alias("path"), F.when(k % 11 == 0, "bad id").when(k % 11 == 1, "same").otherwise(F.concat(F.lit("q"), k)).alias("id"),
        _pick(k % 5, "single_choice", "sentence_order", "fill_blank", "listen_repeat", "essay").alias("type"), F.when(k % 11 == 2, " ").otherwise("Why?").alias("prompt"), F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit("t").alias("text"))).alias("options"), answer.alias("answer"),
        F.lit(None).cast("int").alias("slots"), F.lit(None).cast("string").alias("frame"), F.when(k % 13 == 1, 7201).when(k % 13 == 2, -1).when(k % 13 == 3, 0).alias("time_limit"), F.lit(None).cast("int").alias("prepare"), F.lit(False).alias("interaction"),
    )
    cust = c.table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey").cast("string"))
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_questions"))
    cust = cust.join(n, "c_custkey", "left").withColumn("n_questions", F.coalesce("n_questions", F.lit(0)))
    ck = F.col("c_custkey")
    groups = cust.select(ck.alias("pack"), F.concat(F.lit("g"), "id").alias("path"), "id", F.when(ck % 4 == 0, "maths").otherwise("reading").alias("section"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("passage"), "n_questions")
    packs = cust.select(F.concat(F.lit("p"), "id").alias("path"), F.when(ck % 9 == 0, 3).otherwise(2).alias("schema_version"), "id", F.lit("1").alias("version"), F.when(ck % 14 == 0, "").otherwise("t").alias("title"), F.lit("").alias("rights"), F.when(ck % 10 == 0, 0).otherwise(1).alias("n_groups"), F.lit(5).alias("n_questions"))
    out = pk.package_issues(packs, groups, questions)
    return out.withColumn("path", F.regexp_replace("path", r"^q0*(?=\d)", "q"))


@query("""with t as (select o_orderkey as id, (['module','task','inherit_module','none','other'])[o_orderkey % 5 + 1] as scope, case o_orderkey % 4 when 0 then 60 when 1 then 0 when 2 then 7201 end as d, case o_orderkey % 3 when 0 then 10 end as p, (['document','unknown','guess'])[o_orderkey % 7 % 3 + 1] as basis, o_orderkey % 2 = 0 as inh from orders),
i as (select id, 'unknown scope' as m from t where not (scope in ('module', 'task', 'question', 'none') or inh and scope = 'inherit_module') union all select id, 'inherited timing with seconds' from t where scope = 'inherit_module' and (d is not null or p is not null)
union all select id, 'duration out of bounds' from t where d is not null and d not between 1 and 7200 union all select id, 'unknown basis' from t where basis = 'guess' union all select id, 'untimed with a duration' from t where scope = 'none' and d is not null
union all select id, 'seconds of unknown origin' from t where scope <> 'inherit_module' and basis = 'unknown' and (d is not null or p is not null))
select 'error' as severity, m as message, 't' || id as path from i union all select 'error', 'unknown way back', 'n' || p_partkey from part where p_partkey % 4 = 3 union all select 'error', 'lock_on_advance missing', 'n' || p_partkey from part where p_partkey % 5 = 0
union all select 'error', 'neither text nor audio', 'd' || p_partkey from part where p_partkey % 6 = 0 union all select 'error', 'verified by its file name', 'd' || p_partkey from part where p_partkey % 3 = 1 and p_partkey % 2 = 0""")
def v3_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: timings, navigations and directions of exam settings."""
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    timings = c.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), k).alias("path"), _pick(k % 5, "module", "task", "inherit_module", "none", "other").alias("scope"), F.when(k % 4 < 3, _pick(k % 4, 60, 0, 7201, 0)).alias("duration"), F.when(k % 3 == 0, 10).alias("prepare"), _pick(k % 7 % 3, "document", "unknown", "guess").alias("basis"), (k % 2 == 0).alias("may_inherit")
    )
    parts = c.table(spark, sf_dir, "part")
    navigations = parts.select(F.concat(F.lit("n"), p).alias("path"), _pick(p % 4, "module", "task", "none", "anywhere").alias("back"), F.lit("none").alias("review"), F.when(p % 5 != 0, True).alias("lock_on_advance"))
    directions = parts.select(F.concat(F.lit("d"), p).alias("path"), F.lit("d1").alias("id"), F.when(p % 6 != 0, "Listen.").alias("text"), F.lit(None).cast("string").alias("audio"), _pick(p % 3, "document", "filename", "user").alias("basis"), (p % 2 == 0).alias("verified"))
    return pk.setting_issues(timings, navigations, directions)
