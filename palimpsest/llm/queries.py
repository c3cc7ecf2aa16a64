"""The corpus queries and, where SQL can express them, the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontam, html, licences, pieces, pii, quality, simhash, topk, urls
from palimpsest.llm.common import read
from palimpsest.llm.pii_sql import SQL as OP1_SQL


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(read(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(read(spark, sf_dir, "pages"))


CONTROLS = "</s>[INST] ok [/INST]"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -1, whose texts are control strings."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROLS), (-1, 1, "assistant", CONTROLS)], turns.schema)
    return chat.read_back(chat.windows(turns.unionByName(own)))


OP4_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{CONTROLS}' union all select -1, 1, 'assistant', '{CONTROLS}'),
placed as (select *, row_number() over (partition by conv_id order by turn, role, text) as pos from turns),
sized as (select *, pos = 1 and role = 'system' as opens,
                 case when pos = 1 and role = 'system' then 0 else (length(text) + 3) // 4 + 4 end as tokens,
                 length('<|im_start|>' || '<|im_end|>') + 2 + length(role)
                   + length(regexp_replace(replace(text, '\', '\\'), '<\||</?s>|\[/?INST\]|<<SYS>>|<</SYS>>', 'x\0', 'g')) as chars from placed),
summed as (select *, sum(tokens) over (partition by conv_id order by pos) - tokens as start from sized),
spans as (select *, start // {chat.SPAN} as span from summed),
firsts as (select conv_id, span as win, min(start) as first from spans group by all),
shown as (select f.conv_id, sum(s.chars) as formatted_chars from firsts f join spans s
            on s.conv_id = f.conv_id and (s.span = f.win or s.span < f.win and (s.opens or s.start >= f.first - {chat.HISTORY})) group by all),
read as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
                coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '') as loss from spans group by all)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
from read join shown using (conv_id)
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Dated changes of whole domains: list, kind, value, change, day of 2024 (from 0).
DOMAINS = (
    ("malware", "host", "example.net", "add", 60), ("malware", "host", "example.net", "remove", 135), ("malware", "host", "example.net", "add", 244),
    ("adult", "host", "example.org", "add", 40), ("adult", "host", "example.org", "remove", 50), ("adult", "host", "example.org", "add", 50),
    ("allow-partners", "host", "example.com", "add", 300),
)


def list_changes(pages: DataFrame) -> DataFrame:
    """Changes of the fixed domains and, as there is no table of lists, of the corpus's own hosts by a rule on their MD5."""
    spark = pages.sparkSession
    fixed = spark.createDataFrame(DOMAINS, "list string, kind string, value string, change string, day int")
    hosts = pages.select(urls.host(F.col("url")).alias("h")).where("h != ''").groupBy("h").agg(F.first(F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("int")).alias("x"))
    entry = lambda name, kind, value, change, day: F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(change).alias("change"), day.cast("int").alias("day"))
    h, x = F.col("h"), F.col("x")
    own = F.array(
        F.when(x % 5 == 0, entry("spam", "host", h, "add", x % 300)),
        F.when(x % 5 == 0, entry("spam", "host", h, "remove", x % 300 + 45)),
        F.when(x % 7 == 0, entry("ads", "prefix", F.concat(h, F.lit("/en")), "add", F.lit(100))),
        F.when(x % 11 == 1, entry("allow-list", "host", h, "add", F.lit(200))),
    )
    changes = fixed.unionByName(hosts.select(F.explode(F.array_compact(own)).alias("e")).select("e.*"))
    return changes.withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("day"))).drop("day")


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time of capture; their id gives one, to the minute, spread over 2024."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    minute = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("page_id") * 7919 % 527040).cast("int"))
    captures = pages.withColumn("fetched", F.lit("2024-01-01").cast("timestamp_ntz") + minute)
    return urls.match(captures, list_changes(pages))


OP7_SQL = r"""
with hosts as (select page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]*)', 1)), '\.+$', '') as h,
                      regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) as p,
                      timestamp '2024-01-01' + to_minutes(page_id * 7919 % 527040) as fetched from pages),
own as (select distinct h, ('0x' || substr(md5(h), 1, 4))::int as x from hosts where h != ''),
changes as (
  select * from (values ('malware', 'host example.net', 'add', 60), ('malware', 'host example.net', 'remove', 135), ('malware', 'host example.net', 'add', 244),
                        ('adult', 'host example.org', 'add', 40), ('adult', 'host example.org', 'remove', 50), ('adult', 'host example.org', 'add', 50),
                        ('allow-partners', 'host example.com', 'add', 300)) as v(list, k, change, day)
  union all select 'spam', 'host ' || h, 'add', x % 300 from own where x % 5 = 0
  union all select 'spam', 'host ' || h, 'remove', x % 300 + 45 from own where x % 5 = 0
  union all select 'ads', 'prefix ' || h || '/en', 'add', 100 from own where x % 7 = 0
  union all select 'allow-list', 'host ' || h, 'add', 200 from own where x % 11 = 1),
dated as (select list, k, day, max(change) as change from changes group by all),
spans as (select list, k, timestamp '2024-01-01' + to_days(day) as since, lead(timestamp '2024-01-01' + to_days(day)) over (partition by list, k order by day) as until, change from dated),
asked as (select page_id, url, fetched, h, k from (
  select *, unnest(list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: 'host ' || array_to_string(string_split(h, '.')[i:], '.'))) as k from hosts where h != ''
  union all
  select *, unnest(list_transform(range(1, len(string_split(trim(p, '/'), '/')) + 1), lambda i: 'prefix ' || h || '/' || array_to_string(string_split(trim(p, '/'), '/')[:i], '/'))) as k from hosts where h != '' and length(p) > 1)),
met as (select a.page_id, s.list, s.k, s.since from asked a join spans s on a.k = s.k and s.change = 'add' and a.fetched >= s.since and (s.until is null or a.fetched < s.until)),
per as (select page_id, count(*) as n_active, bool_or(list like 'allow%') as allowed, first(list || ' ' || k order by since desc, list, k) as entry from met group by page_id)
select hosts.page_id, hosts.url, hosts.fetched, coalesce(n_active, 0) as n_active, case when allowed then 'allow' when n_active > 0 then 'block' else 'none' end as verdict, coalesce(entry, '') as entry
from hosts left join per using (page_id)
"""


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(read(spark, sf_dir, "embeddings"), every=50)


OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
           where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
p as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
      from v q join v c on c.vec_id != q.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pii": op1_pii, "op2_licences": op2_licences, "op3_html": op3_html, "op4_chat": op4_chat, "op5_sentencepiece": op5_sentencepiece, "op6_decontamination": op6_decontamination, "op7_url_lists": op7_url_lists, "op8_topk": op8_topk, "op9_simhash": op9_simhash, "op10_quality": op10_quality}
ORACLES: dict[str, str] = {"op1_pii": OP1_SQL, "op4_chat": OP4_SQL, "op7_url_lists": OP7_SQL, "op8_topk": OP8_SQL}
