"""Named queries: thin steps from the given tables to the operators, with DuckDB text where SQL can say it."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Query
from ..session import scratch_path
from .archives import read_archives, write_archives
from .bit_packing import read_token_index, write_token_pages
from .chat import format_conversations, parse_conversations, text_part
from .decontamination import find_contamination
from .hashing import text_session
from .importance import resample
from .language_id import fit_language_model, identify_language
from .minhash import near_duplicates
from .mixing import mix_batches, word_count
from .periodic_runs import periodic_runs
from .quality_ordinal import OrdinalModel, fit_quality, grade_quality
from .quality_rules import quality_rules
from .suffix_dedup import remove_repeats
from .toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(text_session(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table with the library's key names: source_id, text, batch."""
    return as_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def as_records(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("source_id"), "text", F.col("source").alias("batch"))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text modulo ``modulus`` equals ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


OP2_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), wins as (
  select doc_id, i, array_to_string(w[i:i+4], ' ') as win
  from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from t where len(w) >= 5)
), dup as (
  select distinct doc_id, i + unnest([0, 1, 2, 3, 4]) as p
  from (select doc_id, i, count(*) over (partition by doc_id, win) as c from wins) where c >= 2
), rep as (select doc_id, count(*) as n from dup group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct line) as d
  from (select doc_id, unnest(string_split(text, chr(10))) as line from t)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), c as (
  select t.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(d, 0)::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words
  from t left join rep on rep.doc_id = t.doc_id left join lines on lines.doc_id = t.doc_id
), s as (
  select doc_id,
    len(list_filter(w, lambda x: list_contains(['a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or',
      'that','the','this','to','was','with','avec','dans','de','des','du','en','est','et','la','le','les','par','pour','que',
      'qui','sur','un','une','auf','das','dem','den','der','die','ein','eine','im','ist','mit','nicht','sich','und','von','zu',
      'al','con','del','el','las','los','no','por','se','su','y'], lower(x)))) as n_stop,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t
), f as (
  select doc_id, n_stop, len(ls) as n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*([-*]|\x{2022}|[0-9]+[.)]) '))) as n_bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[ \t\r]*$'))) as n_dots
  from s
)
select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
    and not coalesce(word_chars / n_words::double < 1.5 or word_chars / n_words::double > 25, false)
    and not coalesce(n_symbols / n_words::double > 0.3, false)
    and not (n_words >= 80 and n_stop / n_words::double < 0.01)
    and not coalesce(n_dup_lines / nullif(n_lines, 0)::double > 0.5, false)
    and not (n_words >= 50 and coalesce(n_bullets / nullif(n_lines, 0)::double > 0.9, false))
    and not (n_words >= 50 and coalesce(n_dots / nullif(n_lines, 0)::double > 0.5, false))
    and not (n_words >= 80 and n_words / nullif(n_lines, 0)::double < 1.2) as kept
from c join f using (doc_id)
"""


@query("op2_quality_rules", OP2_SQL)
def op2_quality_rules(spark, sf_dir):
    judged = quality_rules(documents(spark, sf_dir))
    return judged.select(
        F.col("source_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP5_SQL = r"""
with t as (
  select conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
    + length('<|turn|>') + length('<|body|>') + length('<|end|>') as chars from t
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id
"""


@query("op5_chat_format", OP5_SQL)
def op5_chat_format(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    # the one conversation of the contract whose texts look like control strings
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    turns = table.unionByName(odd).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    back = parse_conversations(format_conversations(turns))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


TOKENIZER, VOCAB_SIZE, END_ID = "byte_bpe_50k.json", 50_257, 2


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_pages")
def op3_token_pages(spark, sf_dir):
    path = scratch_path(spark, "token-pages")
    write_token_pages(documents(spark, sf_dir), path, tokenizer_file(), VOCAB_SIZE, END_ID)
    return read_token_index(spark, path).select(F.col("source_id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", "page")


OP7_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    cast('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15) as bigint) as h
  from documents
), b as (
  select source, sum(size)::bigint as source_size, 3.0::double * sum(size) as cap,
    [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from d group by source
), l as (
  select *, cap / weight as ratio,
    (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from b
), f as (select arg_min(level, ratio) as level, min(ratio) as ratio from l where level <= ratio),
t as (
  select l.source, source_size, case when f.ratio is null or l.ratio < f.ratio then cap else weight * f.level end as target
  from l, f
), w as (
  select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole,
    target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size as rest
  from t
), hs as (select source, h, sum(size) as s from d group by source, h),
u as (select *, sum(s) over (partition by source order by h rows unbounded preceding) as upto from hs),
e as (
  select w.source, min({'h': h, 's': s, 'upto': upto, 'rest': rest}) as e
  from u join w on u.source is not distinct from w.source where upto > rest group by w.source
), x as (
  select source, case when 2 * (e.rest - (e.upto - e.s)) >= e.s then e.h else e.h - 1 end as threshold from e
)
select doc_id, size, source_size, target, (size * (whole + case when threshold is null or h <= threshold then 1 else 0 end))::bigint as taken
from d join w on d.source is not distinct from w.source left join x on x.source is not distinct from d.source
"""


@query("op7_mix_weights", OP7_SQL)
def op7_mix_weights(spark, sf_dir):
    records = documents(spark, sf_dir).select("source_id", "batch", word_count(F.col("text")).alias("size"))
    mixed = mix_batches(records, (5, 2, 1))
    return mixed.select(F.col("source_id").alias("doc_id"), "size", F.col("batch_size").alias("source_size"), "target", "taken")


def quality_model(spark: SparkSession, sf_dir: str) -> OrdinalModel:
    """Grades from labels: 0 low quality, 1 good but toxic, 2 good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select(F.col("doc_id").alias("source_id"), (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))
    return fit_quality(documents(spark, sf_dir), ratings)


@query("op1_quality_ordinal")
def op1_quality_ordinal(spark, sf_dir):
    graded = grade_quality(documents(spark, sf_dir), quality_model(spark, sf_dir))
    return graded.select(F.col("source_id").alias("doc_id"), "expected_grade", "tail_probability", "kept")


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 4, 2)
    known = docs.where(~held).select(F.col("doc_id").alias("source_id"), "text", "lang")
    found = identify_language(docs.select(F.col("doc_id").alias("source_id"), "text"), fit_language_model(known))
    return found.select(F.col("source_id").alias("doc_id"), held_out(F.col("source_id"), 4, 2).alias("held_out"), "lang_pred", "score")


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("source_id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("source_id"), "toxic")
    scored = score_toxicity(docs, fit_toxicity(docs, labels.where(~held_out(F.col("source_id"), 5, 0))))
    return scored.select(
        F.col("source_id").alias("doc_id"), held_out(F.col("source_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


OP6_SQL = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents
), i as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark
), win as (
  select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[s:s + 9], ' ') as win
  from (select item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) as s from i where len(ws) > 0)
), sizes as (select distinct n from win),
dw as (
  select doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') as win
  from (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as s from w, sizes where len(ws) >= n)
), m as (select doc_id, dw.n, s, item_id from dw join win on win.win = dw.win and win.n = dw.n),
h as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(generate_series(s, s + n - 1)) from m) group by doc_id),
it as (
  select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from m) group by doc_id
)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join h on h.doc_id = w.doc_id left join it on it.doc_id = w.doc_id
"""


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")


@query("op6_decontaminate", OP6_SQL)
def op6_decontaminate(spark, sf_dir):
    found = find_contamination(documents(spark, sf_dir), benchmark_items(spark, sf_dir))
    return found.select(
        F.col("source_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
), s as (
  select distinct doc_id, sh from (
    select doc_id, array_to_string(ws[i:i+2], ' ') as sh from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) as i from w where len(ws) > 0))
), n as (select doc_id, count(*) as n from s group by doc_id),
-- any link shares one of the first 15 % + 1 shingles in order of frequency
f as (select sh, count(*) as c from s group by sh),
r as (select s.doc_id, s.sh, row_number() over (partition by s.doc_id order by c, s.sh) as k from s join f on f.sh = s.sh),
p as (select r.doc_id, sh from r join n on n.doc_id = r.doc_id where k <= floor(0.15 * n) + 1),
c as (select distinct a.doc_id as a, b.doc_id as b from p a join p b on a.sh = b.sh and a.doc_id < b.doc_id),
i as (select c.a, c.b, count(*) as i from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b and y.sh = x.sh group by c.a, c.b),
l as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n + nb.n - i)),
e as (select a, b from l union all select b, a from l),
reach as (select doc_id as node, doc_id as root from documents union select e.b, reach.root from reach join e on e.a = reach.node)
select d.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(root) as component_id, d.doc_id = min(root) as kept
from documents d join reach on reach.node = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""


@query("op4_minhash", OP4_SQL)
def op4_minhash(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)
    return found.select(F.col("source_id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP8_SQL = r"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (
  select doc_id, i, substr(h, 2 * i + 1, 100) as s
  from (select doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) as i from t where len(h) >= 100)
), m as (select s, min(doc_id) as first from w group by s),
g as (select w.doc_id, w.i, lag(w.i) over (partition by w.doc_id order by w.i) as before from w join m on m.s = w.s where m.first < w.doc_id),
k as (select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as grp from g),
sp as (select doc_id, min(i) as a, max(i) + 50 as b from k group by doc_id, grp),
r as (select *, lag(b, 1, 0) over (partition by doc_id order by a) as before from sp),
kept as (
  select r.doc_id, sum(b - a) as n, count(*) as spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as rest
  from r join t on t.doc_id = r.doc_id group by r.doc_id
)
select t.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(rest, h))) as kept_sha256
from t left join kept on kept.doc_id = t.doc_id
"""


@query("op8_suffix_dedup", OP8_SQL)
def op8_suffix_dedup(spark, sf_dir):
    records = documents(spark, sf_dir).select("source_id", F.col("text").alias("payload"))
    cut = remove_repeats(records, 50)
    return cut.select(F.col("source_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def crc32_sql(code_units: str) -> str:
    """DuckDB text for the unsigned crc32 of a list of byte values."""
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform({code_units}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]::bigint[]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384::bigint * (xor(c, b) & 1))), 4294967295::bigint)"""


OP13_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w0,
    {crc32_sql("list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda x: ascii(x)::bigint)")} as h from documents
), g as (select *, h // 10 as g, len(w0)::bigint as n from d),
pa as (select *, case when n > 0 then g % n end as a from g),
pp as (select *, 1 + (n - a) // (3 + g % 8) as p from pa),
t as (
  select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(w0, lambda x, i: case when i > a then w0[a + (i - 1 - a) % p + 1] else x end) else w0 end as w from pp
), wi as (select doc_id, n, unnest(w) as x, unnest(generate_series(0, n - 1)) as i from t where n > 0),
six as (
  select doc_id, i, x || ' ' || lead(x, 1) over o || ' ' || lead(x, 2) over o || ' ' || lead(x, 3) over o || ' ' || lead(x, 4) over o || ' ' || lead(x, 5) over o as s
  from wi window o as (partition by doc_id order by i)
), pairs as (select a.doc_id, b.i - a.i as q, a.i from six a join six b on a.doc_id = b.doc_id and a.s = b.s and a.i < b.i),
isl as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as grp from pairs),
st as (select doc_id, q, min(i) as start, count(*) + 5 as same from isl group by doc_id, q, grp),
runs as (select doc_id, start, same + q as length, min(q) as period from st where same >= q and same + q >= 12 group by doc_id, start, same + q),
m as (select doc_id, i + start + period as i from (select doc_id, start, period, unnest(generate_series(0, length - period - 1)) as i from runs)),
dropped as (select distinct doc_id, i from m),
kept as (
  select wi.doc_id, string_agg(x, ' ' order by wi.i) as s from wi left join dropped on dropped.doc_id = wi.doc_id and dropped.i = wi.i
  where dropped.i is null group by wi.doc_id
), r as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as s,
    min(struct_pack(l := -length, s := start, p := period)) as best from runs group by doc_id
)
select t.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, (-best.l)::bigint as length, best.p::bigint as period,
  (1000 * -best.l // best.p)::bigint as exponent_milli, sha256(coalesce(r.s, '')) as runs_sha256, sha256(coalesce(kept.s, '')) as collapsed_sha256
from t left join r on r.doc_id = t.doc_id left join kept on kept.doc_id = t.doc_id
"""


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (source_id, text): in one text of ten, by crc32 of the id, the words from a place on repeat a block."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    dealt = docs.select(F.col("doc_id").alias("source_id"), "text", F.floor(h / 10).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("chosen"))
    words = F.when(F.col("chosen"), F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    dealt = dealt.withColumn("words", words).withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    dealt = dealt.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return dealt.select("source_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs", OP13_SQL)
def op13_periodic_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_periodic_tails(docs), sequence="text")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", longest).select(
        F.col("source_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.expr("-1000 * best.l div best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def words_sql(table: str, key: str) -> str:
    return rf"""select {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from {table}"""


OP12_SQL = rf"""
with d as ({words_sql("documents", "doc_id")}), b as ({words_sql("benchmark", "item_id")}),
df as (select doc_id, unnest(ws) as f from d), bf as (select unnest(ws) as f from b),
v as (select f, hex(encode(f)) as x from (select f from df union select f from bf)),
k as (
  select f, {crc32_sql("list_transform(generate_series(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)")} % 10000 as bucket from v
), s as (select bucket, count(*) as s from df join k using (f) group by bucket),
t as (select bucket, count(*) as t from bf join k using (f) group by bucket),
gain as (
  select s.bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * ((select count(*) from df)::double + 10000)
    / ((s::double + 1) * ((select count(*) from bf)::double + 10000))))::bigint as gain
  from s left join t on t.bucket = s.bucket
), w as (select doc_id, sum(gain)::bigint as weight from df join k using (f) join gain using (bucket) group by doc_id),
r as (
  select d.doc_id, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint as h
  from d left join w on w.doc_id = d.doc_id
), sc as (select doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))))::bigint as score from r),
o as (select doc_id, row_number() over (order by score desc, doc_id) as n from sc where n_features >= 20)
select sc.doc_id, n_features, weight, score, case when n <= (select (10 * count(*)) // 100 from o) then n end::bigint as rank
from sc left join o on o.doc_id = sc.doc_id
"""


@query("op12_importance_resampling", OP12_SQL)
def op12_importance_resampling(spark, sf_dir):
    drawn = resample(documents(spark, sf_dir), benchmark_items(spark, sf_dir), features="text", percent=10, least=20)
    return drawn.withColumnRenamed("source_id", "doc_id")


OP11_SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
m as (select html, max(page_id) as keeper from p group by html),
h as (select p.page_id, strlen(p.html)::bigint as n, sha1(p.html) as x, keeper from p join m on m.html = p.html)
select page_id, n as payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (5 * i // 4 + 1)::int, 2))::int >> (3 - 5 * i % 4)::int) & 31) + 1, 1)), '') as payload_digest,
  case when keeper is null or page_id = keeper then 'response' else 'revisit' end as record_type,
  case when keeper is null or page_id = keeper then null else keeper end as refers_to
from h
"""


@query("op11_warc", OP11_SQL)
def op11_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("source_id"), F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content")
    )
    path = scratch_path(spark, "archives")
    write_archives(pages, path, media="text/html; charset=utf-8")
    back = read_archives(spark, path, payload=False)
    return back.select(
        F.col("source_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )
