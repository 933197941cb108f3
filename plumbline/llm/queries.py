"""One query per training-data operator, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    from pyspark.sql import functions as F

    from .decontam import matches

    found = matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", F.explode("_matches").alias("m")).select("doc_id", "m.*")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mih import search

    return search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0, k=20)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import crc_mod
    from .toxicity import DECISION, fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = score(docs, fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), holdout=(3, 1)), lang_col="lang")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= DECISION).cast("int").alias("predicted"), "flagged")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import crc_mod
    from .langid import fit, identify

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs, holdout=(3, 1)))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs, "source", "text", ratio=0.1, min_pages=5).selectExpr("doc_id", "source as host", "_n_lines as n_lines", "_n_dropped as n_dropped", "text as cleaned")


OP5_SQL = """
with lines as (
  select doc_id, source, text, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))) as keys
  from documents),
held as (
  select source, key, count(distinct text) as pages
  from (select source, text, unnest(keys) as key from lines) where key <> '' group by 1, 2),
totals as (select source, count(distinct text) as total from documents group by 1),
dropped as (
  select source, list(key) as keys from held join totals using (source) where pages >= 5 and pages > 0.1::double * total group by 1),
marked as (
  select l.*, coalesce(d.keys, []::varchar[]) as bad from lines l left join dropped d on l.source is not distinct from d.source)
select doc_id, source as host, coalesce(len(keys), 0)::bigint as n_lines,
  coalesce(len(list_filter(keys, lambda k: list_contains(bad, k))), 0)::bigint as n_dropped,
  case when text is not null then array_to_string(
    list_filter(string_split(text, chr(10)), lambda x: not list_contains(bad, trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)))), chr(10)) end as cleaned
from marked
"""


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)


OP6_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) end) as s from words),
rows_ as (select doc_id, len(s) as n, unnest(s) as x from sets),
pairs as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as shared from rows_ a join rows_ b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs where 100 * shared >= 80 * (na + nb - shared)),
edges as (select a, b from links union select b, a from links),
reach as (select a as doc_id, a as root from edges union select e.a, r.root from reach r join edges e on e.b = r.doc_id),
least_ as (select doc_id, min(root) as root from reach group by 1)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(l.root, s.doc_id) as component_id, coalesce(l.root, s.doc_id) = s.doc_id as kept
from sets s left join least_ l using (doc_id)
"""


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import crc_mod
    from .katz import score_texts

    out = score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), holdout=(5, 1), least=1)
    return out.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)))


#: crc32 of the id as text, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda crc, b: list_reduce(
    [1, 2, 3, 4, 5, 6, 7, 8]::bigint[], lambda y, i: case when y & 1 = 1 then xor(y >> 1, 3988292384::bigint) else y >> 1 end, xor(crc, b)), 4294967295::bigint), 4294967295::bigint)"""
_DISCOUNT = """select r, case when n > 0 and up > 0 and tail < 1 and x > 0.05 and x < 1 then x else 1 - 0.5::double / r end as d from (
  select *, ((r + 1) * up / (n * r::double) - tail) / (1 - tail) as x from (
    select r, n::double as n, lead(n) over (order by r)::double as up, case when first_value(n) over (order by r) > 0 then 6.0::double * last_value(n) over (order by r rows between unbounded preceding and unbounded following) / first_value(n) over (order by r) else 0 end as tail
    from {}) a) b where r <= 5"""
#: The model of op8 as text: words by UTF-8 with A-Z in lower case, one end a text, Good-Turing discounts up to 5.
OP8_SQL = r"""
with docs as (
  select doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') as w, {held} as held_out, row_number() over () as row
  from documents),
tok as (select row, held_out, unnest(w) as x, generate_subscripts(w, 1) as p from docs),
pos as (select row, held_out, x, coalesce(lag(x) over (partition by row order by p), ' start') as h from tok),
uni as (select x, count(*) as c from pos where not held_out group by 1),
bi as (select h, x, count(*) as c from pos where not held_out group by 1, 2),
tot as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from uni),
texts as (select count(*) as t from docs where not held_out),
n1 as (select r, (select count(*) from uni where c = r) as n from range(1, 7) s(r)),
n2 as (select r, (select count(*) from bi where c = r) as n from range(1, 7) s(r)),
d1 as ({d1}),
d2 as ({d2}),
u1 as (select x, uni.c, uni.c * coalesce(d1.d, 1) as m from uni left join d1 on uni.c = d1.r),
z as (select n, v, greatest(n, (select sum(m) from u1) + 0.5::double) as scale, (select sum(m) from u1) as mass from tot),
p1 as (select x, c, m / scale as p from u1, z),
b1 as (select h, bi.x, bi.c * coalesce(d2.d, 1) as m, p1.p as below from bi left join d2 on bi.c = d2.r join p1 on bi.x = p1.x),
hist as (select h, sum(m) as a, sum(below) as s from b1 group by 1),
his2 as (select hist.*, greatest(case when h = ' start' then (select t from texts) else p1.c end, a + 0.5::double) as d from hist left join p1 on hist.h = p1.x),
alpha as (select h, d, (1 - a / d) / greatest(1 - s, 1e-300) as alpha from his2),
each as (
  select pos.row, p1.c, log10((coalesce(p1.c, 0) + 0.5::double) / (z.n + 0.5::double * (z.v + 1))) as base,
    log10(case when b1.m is not null then b1.m / alpha.d else coalesce(alpha.alpha, 1) * coalesce(p1.p, 1 - z.mass / z.scale) end) as full_
  from pos cross join z left join p1 on pos.x = p1.x left join alpha on pos.h = alpha.h left join b1 on pos.h = b1.h and pos.x = b1.x)
select doc_id, n_tokens, n_known, (select n from tot) as train_tokens, base_score, score, held_out from docs
join (select row, count(*) as n_tokens, count(c) as n_known, sum(base) as base_score, sum(full_) as score from each group by row) e using (row)
"""
OP8_SQL = OP8_SQL.replace("{held}", f"coalesce({_CRC} % 5 = 1, false)").replace("{d1}", _DISCOUNT.format("n1")).replace("{d2}", _DISCOUNT.format("n2"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secretscan import digest, find_secrets

    return digest(find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


#: Spans by marking what a pattern matches: every other piece between the marks is a match, lengths give offsets.
OP10_SQL = r"""
with docs as (select doc_id, coalesce(source, '') as owner, coalesce(text, '') as t, row_number() over () as row from documents),
cut as (
  select row, unnest([0, 1, 2, 3]) as kind, unnest([
    string_split(regexp_replace(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)),
    string_split(regexp_replace(t, 'AKIA[A-Z0-9]+', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)),
    string_split(regexp_replace(t, '[0-9a-f]+', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)),
    string_split(regexp_replace(t, '[A-Za-z0-9+/_=-]+', chr(57344) || '\0' || chr(57344), 'g'), chr(57344))]) as parts from docs),
piece as (select row, kind, unnest(parts) as x, generate_subscripts(parts, 1) as i from cut),
at_ as (select row, kind, i, x, coalesce(sum(length(x)) over (partition by row, kind order by i rows between unbounded preceding and 1 preceding), 0)::bigint as a from piece),
hit as (
  select row, kind, a, a + length(x) as z, case when kind = 0 then regexp_extract(x, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) else x end as v
  from at_ where i % 2 = 0),
base as (select * from hit where kind = 0 and length(v) >= 8 or kind = 1 and length(v) >= 16 or kind = 2 and length(v) >= 32),
mixed as (
  select * from hit h where kind = 3 and length(v) >= 20 and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[0-9]')
    and not exists (select 1 from base b where b.row = h.row and b.a < h.z and h.a < b.z)),
bits as (
  select row, a, sum(-k / n::double * log2(k / n::double)) as e from (
    select row, a, c, count(*) as k, any_value(n) as n from (select row, a, unnest(string_split(v, '')) as c, length(v) as n from mixed) x group by 1, 2, 3) y group by 1, 2),
cand as (select * from base union all select m.* from mixed m join bits using (row, a) where e >= 3.5),
owned as (
  select v, sum(k)::bigint as repositories, count(*) as owners from (
    select v, owner, count(distinct copy) as k from (
      select v, owner, doc_id, min(md5(t)) as copy from cand join docs using (row) group by 1, 2, 3) x group by 1, 2) y group by 1),
said as (
  select row, kind, a, z, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || a || ':' || z as s, owners <= 1 or owners <= 2 and repositories <= 50 as live
  from cand join owned using (v)),
kept as (select * from said where kind < 3 or live)
select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  sha256(coalesce(string_agg(s, ',' order by a, kind) filter (kind < 3), '')) as base_sha256, coalesce(string_agg(s, ',' order by a, kind), '') as spans,
  count(*) filter (live) as n_live
from docs left join kept using (row) group by row, doc_id
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .periodic import best_run, find_runs, runs_digest, tiled

    docs = _table(spark, sf_dir, "documents").select("doc_id", tiled(F.col("text"), F.col("doc_id")).alias("text"))
    out = find_runs(docs, keep=("doc_id",)).withColumn("best", best_run(F.col("_runs")))
    return out.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), "best.*", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        runs_digest(F.col("_runs")).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality import judge_quality

    out = judge_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    base = [F.col("_counts")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    against = F.size(F.filter("_votes", lambda v: v < 0)).cast("long").alias("n_against")
    return out.select("doc_id", *base, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), against)


def _share(part: str, whole: str, good: int, bad: int, least: int = 1) -> str:
    up = good > bad
    return (
        f"case when {whole} < {least} then 0 when 100 * {part} {'>=' if up else '<='} {good} * {whole} then 1 "
        f"when 100 * {part} {'<' if up else '>'} {bad} * {whole} then -1 else 0 end"
    )


_VOTES = [
    "case when n_words >= 50 then 1 when n_words < 25 then -1 else 0 end",
    "case when n_words = 0 then 0 when word_chars between 3 * n_words and 10 * n_words then 1 when word_chars between 2 * n_words and 14 * n_words then 0 else -1 end",
    _share("n_symbols", "n_words", 3, 10), _share("n_dup_lines", "n_lines", 10, 30, 3), _share("n_repeat_words", "n_words", 8, 20), _share("n_worded", "n_words", 90, 80),
    _share("n_letters", "word_chars", 85, 75), _share("n_upper", "n_letters", 15, 40), _share("n_top_word", "n_words", 15, 30, 20), _share("n_ended_lines", "n_lines", 60, 20, 2),
]
_ODDS = " + ".join(["ln(prior / (1 - prior))", *(f"case v[{i}] when 1 then ln(a[{i}] / (1 - b[{i}])) when -1 then ln((1 - a[{i}]) / b[{i}]) else 0 end" for i in range(1, 11))])
_SHARE = "({x} + coalesce(sum({w}) filter (v[{i}] {s} 0), 0)) / ({y} + coalesce(sum({w}) filter (v[{i}] <> 0), 0))"
_ON_GOOD = [f"least(greatest({_SHARE.format(x=8, y=10, w='good', s='>', i=i)}, 0.6::double), 0.999::double)" for i in range(1, 11)]
_ON_BAD = [f"least(greatest({_SHARE.format(x=2, y=4, w='n - good', s='<', i=i)}, 1 - {a}), 0.999::double)" for i, a in enumerate(_ON_GOOD, 1)]
#: Expectation-maximisation as a recursion over the counts of vote patterns.
OP12_SQL = r"""
with recursive docs as (select doc_id, coalesce(text, '') as t, row_number() over () as row from documents),
split as (
  select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs),
starts as (select row, w, unnest(range(1, len(w) - 6)) as i from split),
windows as (select row, i, count(*) over (partition by row, array_to_string(w[i:i + 7], ' ')) as k from starts),
repeated as (select row, count(distinct i + j) as n from windows, range(8) r(j) where k > 1 group by 1),
tops as (select row, max(k) as n from (select row, x, count(*) as k from (select row, unnest(w) as x from split) y group by 1, 2) z group by 1),
counts as (
  select row, doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(repeated.n, 0)::bigint as n_repeat_words, len(lines) as n_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '[.!?"'')][\x20\x09-\x0D]*$'))) as n_ended_lines,
    length(regexp_replace(t, '[^A-Za-z\x{C0}-\x{10FFFF}]', '', 'g')) as n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{C0}-\x{10FFFF}]'))) as n_worded, coalesce(tops.n, 0) as n_top_word
  from split left join repeated using (row) left join tops using (row)),
voted as (select *, [{votes}]::int[] as v from counts),
patterns as (select v, count(*)::double as n from voted group by 1),
model(step, prior, a, b) as (
  select 0, 0.8::double, [{start a}], [{start b}]
  union all
  select step + 1, (sum(good) + 8) / (sum(n) + 10), [{a}], [{b}]
  from (select step, v, n, n / (1 + exp(-({odds}))) as good from model, patterns where step < 60) x group by step)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 1 / (1 + exp(-({odds}))) >= 0.5 as kept, len(list_filter(v, lambda x: x < 0))::bigint as n_against
from voted, model where step = 60
"""
for _name, _value in {"votes": _VOTES, "start a": ["0.9::double"] * 10, "start b": ["0.5::double"] * 10, "a": _ON_GOOD, "b": _ON_BAD, "odds": [_ODDS]}.items():
    OP12_SQL = OP12_SQL.replace(f"{{{_name}}}", ", ".join(_value))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by 1),
grams as (select lang, w, unnest([1, 2, 3, 4, 5]) as m from words),
starts as (select lang, m, w, unnest(range(1, len(w) - m + 2)) as i from grams),
f as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f from starts group by all having count(*) >= 100),
cuts as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from f where m > 1),
scores as (
  select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, n, (1000::hugeint * a * n // (x.f::hugeint * y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ')
    join f y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1:], ' ') join totals t on t.lang = c.lang),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, f, m, string_split(phrase, ' ') as w, unnest([2, 3, 4]) as part from f where m > 2),
within as (
  select lang, array_to_string(w[i:i + part - 1], ' ') as phrase, max(f) as f
  from (select *, unnest(range(1, m - part + 2)) as i from inner_ where part < m) x group by 1, 2)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n, score
from best b left join within using (lang, phrase) where within.f is null or 100 * within.f < 100 * a
qualify rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash": op6_minhash,
    "op7_main_text": op7_main_text,
    "op8_katz": op8_katz,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_secrets": op10_secrets,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality": op12_quality,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op6_minhash": OP6_SQL,
    "op8_katz": OP8_SQL,
    "op10_secrets": OP10_SQL,
    "op12_quality": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
