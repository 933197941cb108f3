"""Queries of evaluation over merged data sets, trees of unknown shape, thinking models, draws and templates."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import prompts as P
from ..functions import text as T
from ..operators import curate as C
from ..operators import metrics as M
from ..sources import trees as V
from .bindings import duck, view
from .queries import _BIN, _GOT, _HAS, _NOISE_LINES, _PERCENT, _PRED, _RANK, _UNIT, _c, _ruled, _ruled_sql, _types, query

# --- evaluation -----------------------------------------------------------------------------------------------

_ODD = f"""(select *, {_UNIT} as u, {_PERCENT} as pc, {_RANK} as rk from (
  select id, case when model = 3 then null else model end as model, dataset, answer, correct, case when model = 2 then 'none' else confidence end as confidence from {_PRED} p) q)"""
_BY = "model, dataset, merged"
_SAME = " and ".join(f"k.{c} is not distinct from {{0}}.{c}" for c in ("model", "dataset", "merged"))


@query("evaluate_merged", f"""
with r as (select *, false as merged from {_ODD} a union all select * replace (null as dataset), true as merged from {_ODD} b),
k as (select {_BY}, avg(correct::int::double) as accuracy, coalesce(avg(u), 0) as ave_conf, count(*) filter (answer <> '') as n, count(*) as m from r group by all),
e as (select {_BY}, sum(abs(mass - hits)) / sum(n) as ece from (
  select {_BY}, {_BIN} as b, count(*) as n, sum(correct::int) as hits, sum(u) as mass from r where u is not null group by all) x group by all),
s as (select {_BY}, rk, sum(correct::int)::double as pos, sum(1 - correct::int)::double as neg from r group by all),
w as (select *, coalesce(sum(pos) over (v rows between unbounded preceding and 1 preceding), 0) as p0, coalesce(sum(neg) over (v rows between unbounded preceding and 1 preceding), 0) as n0
  from s window v as (partition by {_BY} order by rk desc)),
o as (select {_BY}, case when sum(pos) = 0 or sum(neg) = 0 then 'nan'::double else sum(neg * (p0 + 0.5::double * pos)) / (sum(pos) * sum(neg)) end as auroc,
  case when sum(pos) = 0 or sum(neg) = 0 then 'nan'::double
    else sum(pos * (case when p0 + n0 = 0 then 1 else p0 / (p0 + n0) end + (p0 + pos) / (p0 + pos + n0 + neg)) / 2) / sum(pos) end as auprc from w group by all),
d as (select {_BY}, list({{'bin': bin, 'correct': correct, 'total': total}} order by bin) as bins from (
  select k.model, k.dataset, k.merged, n.bin, coalesce(sum(r.correct::int), 0)::bigint as correct, count(r.merged) as total from k cross join (select unnest(range(10))::int as bin) n
  left join r on {_SAME.format('r')} and r.pc is not null and least(floor(r.pc / 10), 9)::int = n.bin group by all) y group by all)
select k.model, k.dataset, k.merged, accuracy, ave_conf, format('{{}}/{{}} ({{:.1f}}%)', n, m, 100.0::double * n / m) as valid_sample_portion, coalesce(ece, 0) as ece, auroc, auprc,
  bins::json::varchar as reliability_diagram
from k left join e on {_SAME.format('e')} left join o on {_SAME.format('o')} left join d on {_SAME.format('d')}""")
def evaluate_merged(spark: SparkSession, d: str) -> DataFrame:
    """Per data set and over all data sets, with a null model and a model without a readable confidence."""
    rows = view(spark, d, "pred").withColumns({
        "confidence": F.when(_c("model") == 2, F.lit("none")).otherwise(_c("confidence")), "model": F.when(_c("model") != 3, _c("model")),
    })
    names = ["accuracy", "ave_conf", "valid_sample_portion", "ece", "auroc", "auprc", "reliability_diagram"]
    out = M.evaluate(rows, ["model", "dataset"], names, merge=["dataset"])
    return out.withColumn("reliability_diagram", F.to_json("reliability_diagram"))


_V = f"(select correct, greatest(least(case when value > 1 then value / 100 else value end, 1), 0) as u, greatest(least(value / 100, 1), 0) as rk from {_PRED} p)"


@query("scores_without_keys", f"""
with s as (select rk, sum(correct::int)::double as pos, sum(1 - correct::int)::double as neg from {_V} v group by 1),
w as (select *, coalesce(sum(pos) over (v rows between unbounded preceding and 1 preceding), 0) as p0, coalesce(sum(neg) over (v rows between unbounded preceding and 1 preceding), 0) as n0
  from s window v as (order by rk desc)),
o as (select sum(neg * (p0 + 0.5::double * pos)) / (sum(pos) * sum(neg)) as auroc,
  sum(pos * (case when p0 + n0 = 0 then 1 else p0 / (p0 + n0) end + (p0 + pos) / (p0 + pos + n0 + neg)) / 2) / sum(pos) as auprc from w),
c as (select list_distinct(quantile_cont(u, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as edges from {_V} v),
b as (select greatest(0, least(len(list_filter(edges, lambda e: e <= u)) - 1, len(edges) - 2)) as b, count(*) as n, sum(correct::int) as hits, sum(u) as mass from {_V} v cross join c group by 1)
select auroc, auprc, (select sum(abs(mass - hits)) / sum(n) from b) as ece_adaptive from o""")
def scores_without_keys(spark: SparkSession, d: str) -> DataFrame:
    """Nearly as many scores as rows, and no groups: order comes from ranges of the score."""
    rows = view(spark, d, "pred").withColumn("confidence", _c("value").cast("string"))
    return M.evaluate(rows, [], ["auroc", "auprc", "ece_adaptive"])


# --- trees ----------------------------------------------------------------------------------------------------


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


@query("path_projection", f"""
select prompt, 'response/task' as path_key, case prompt % 3 when 0 then t1 when 1 then t2 else t3 end as text from {duck('prompts')} g
union all select prompt, 'response/extra/1', c1 from {duck('prompts')} g where prompt % 2 = 0""")
def path_projection(spark: SparkSession, d: str) -> DataFrame:
    """Answers below a list, below prompt types and below other keys, and a place of a list that some items lack."""
    extra = F.when(_c("prompt") % 2 == 0, F.array("t1", "c1")).otherwise(F.array("t1"))
    listed = _json(task=F.array("t1", "t2"), extra=extra)
    typed = _json(task=F.struct(F.array("t1").alias("cot"), F.array("t2").alias("vanilla")), extra=extra)
    other = _json(task=F.struct(F.lit("no list").alias("a"), F.array("t3").alias("facts")), extra=extra)
    tree = F.when(_c("prompt") % 3 == 0, listed).when(_c("prompt") % 3 == 1, typed).otherwise(other)
    value = F.concat(F.lit('[{"id": "x", "response": '), tree, F.lit("}]"))
    found = V.items(view(spark, d, "prompts").select("prompt", value.alias("value")))
    whole, some = V.project(found, [["response", "task"]]), V.project(found, [["response", "extra", 1]], missing="skip")
    return whole.unionByName(some).select("prompt", "path_key", "text")


@query("latest_items", f"select prompt, 'a' as id, t2 as v from {duck('prompts')} g union all select prompt, 'b', c3 from {duck('prompts')} g")
def latest_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of lists and of objects in one load, of equal ids the last."""
    item = lambda key, v: _json(id=F.lit(key), v=v)
    each = [item("a", _c("t1")), F.lit('{"v": "no id"}'), item("a", _c("t2")), item("b", _c("c3")), F.lit("5")]
    listed = F.concat(F.lit(" ["), F.concat_ws(",", *each), F.lit("]"))
    keyed = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}": '), v) for k, v in zip("zyxwa", each, strict=True)]), F.lit("}"))
    texts = view(spark, d, "prompts").select("prompt", F.when(_c("prompt") % 2 == 0, listed).otherwise(keyed).alias("value"))
    return V.latest_items(V.items(texts), ["prompt"]).select("prompt", "id", F.variant_get("item", "$.v", "string").alias("v"))


@query("first_filled", f"select prompt, case when prompt % 3 = 0 then t1 when prompt % 3 = 1 then t2 else '' end as used from {duck('prompts')} g")
def first_filled(spark: SparkSession, d: str) -> DataFrame:
    """An empty list falls through to the next field, as a missing one does."""
    none = F.array().cast("array<string>")
    answer = F.when(_c("prompt") % 3 == 0, F.array("t1")).when(_c("prompt") % 3 == 1, none)
    gold = F.when(_c("prompt") % 3 == 1, F.array("t2")).otherwise(none)
    return view(spark, d, "prompts").select("prompt", F.array_join(T.first_filled(answer, gold), "|").alias("used"))


# --- draws ----------------------------------------------------------------------------------------------------


@query("drawn_passages", f"""
select prompt, array_to_string(list_transform(list_slice(list_sort(list_transform([1, 2, 3], lambda i: concat(md5(concat(prompt::varchar, '-', (i - 1)::varchar, '-42')), i::varchar))), 1, 2),
  lambda x: concat(right(x, 1), ':', [t1, t2, t3][right(x, 1)::int])), '|') as drawn from {duck('prompts')} g""")
def drawn_passages(spark: SparkSession, d: str) -> DataFrame:
    """Two of three passages drawn by digest."""
    named = F.transform(_types(), lambda t, i: F.concat((i + 1).cast("string"), F.lit(":"), t))
    return view(spark, d, "prompts").select("prompt", F.array_join(T.draw(named, 2, _c("prompt")), "|").alias("drawn"))


@query("answer_combinations", f"""
with a as (select distinct user_id, answer from {_PRED} p)
select x.user_id, concat(x.answer, '+', y.answer, '+', z.answer) as chosen from a x join a y on x.user_id = y.user_id and x.answer < y.answer join a z on x.user_id = z.user_id and y.answer < z.answer""")
def answer_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Every three of a user's distinct answers."""
    answers = view(spark, d, "pred").groupBy("user_id").agg(F.sort_array(F.collect_set("answer")).alias("a"))  # event types: a few
    return answers.select("user_id", F.explode(T.combinations(_c("a"), 3)).alias("c")).select("user_id", F.array_join("c", "+").alias("chosen"))


# --- responses ------------------------------------------------------------------------------------------------


@query("filter_funnel_thinking", f"""
select s as model, count(*) as seen, {', '.join(f"count(*) filter (reason = '{r}') as {r}" for r in C.REASONS)}, 0::bigint as tolerated, count(*) filter (reason is null) as kept
from {_ruled_sql(False, think="s % 2 = 1", closed="prompt % 6 <> 0")} x group by s""")
def filter_funnel_thinking(spark: SparkSession, d: str) -> DataFrame:
    """Every second model thinks first; a sixth of its responses never closes the thought."""
    thinks = _c("s") % 2 == 1
    text = F.when(thinks & (_c("prompt") % 6 != 0), F.concat(F.lit("Step 9: musing</think>\n"), _c("text"))).otherwise(_c("text"))
    rows = view(spark, d, "resp").withColumn("text", text).withColumn("think", thinks).withColumnRenamed("s", "model")
    return C.funnel(C.apply_rules(rows, _c("text"), _types(), _c("think")), ["model"])


_CONTENT = """concat(regexp_extract(text, '(?is)^(.*?)passage classifications', 1), 'Passage Classifications:', chr(10), '1. ', block[1], chr(10), '2. ', block[2], chr(10), '3. ', block[3], chr(10),
  case when (prompt * 4 + s) % 4 = 1 then '' else chr(10) end, rtrim(regexp_extract(text, '(?is)((?:final )?answer:.*)$', 1), chr(10)))"""


@query("kept_content", f"select prompt, s as model, regexp_replace({_CONTENT}, '(?i)\\[?\\s*final\\s+answer\\s*\\]?\\s*[:：]', 'Answer:', 'g') as content from {_ruled_sql(True)} x where reason is null")
def kept_content(spark: SparkSession, d: str) -> DataFrame:
    """What kept responses are rewritten to: a standard label block, and "Answer:" for "Final Answer:"."""
    return _ruled(spark, d, True).where("reject_reason is null").select("prompt", "model", "content")


@query("extract_by_prefix", f"""
select prompt, s, case when m then answer else '' end as answer, case when m then confidence when s = 0 then '0' else '100' end as confidence
from (select prompt, s, {_HAS} as m, {_GOT} from {duck('resp')} r) x where m or s < 2""")
def extract_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched responses by the path they stand at: two prefixes with fillers, all others are skipped."""
    rows = view(spark, d, "resp").select("prompt", "s", "text", F.concat(F.lit("response/m"), _c("s").cast("string"), F.lit("/x")).alias("path_key"))
    out = E.extract(rows, E.SPECS["ckpt_test"], by_prefix={"response/m0": "empty_0", "response/m1": "empty_100", "response/m0/x": "skip"})
    return out.select("prompt", "s", "answer", "confidence")


@query("extract_default", f"""
select prompt, s, answer, conf::varchar as confidence from {duck('resp')} r where prompt % 2 = 0 or s < 2""")
def extract_default(spark: SparkSession, d: str) -> DataFrame:
    """The oldest form of an answer, in brackets and marks."""
    marked = F.when(_c("prompt") % 2 == 0, F.concat(F.lit("**Final Answer**: ##"), _c("answer"), F.lit("##\n[Final Confidence]: ##"), _c("conf").cast("string"), F.lit("%##\n")))
    plain = F.when(_c("s") < 2, F.concat(F.lit("[Final Answer]: "), _c("answer"), F.lit("\nFinal Confidence: "), _c("conf").cast("string"), F.lit("%"))).otherwise(F.lit("Final Answer: x"))
    rows = view(spark, d, "resp").select("prompt", "s", F.coalesce(marked, plain).alias("text"))
    return E.extract(rows, E.SPECS["default"]).select("prompt", "s", "answer", "confidence")


_KINDS = ("counterfactual", "relevant", "consistent")


@query("parse_noise_kinds", f"select prompt, kind, content, p as partner from {_NOISE_LINES} z cross join (select unnest({list(_KINDS)}) as kind) k")
def parse_noise_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The three kinds of generated passages beside the irrelevant ones."""
    clean = lambda c: F.regexp_replace(c, r"\s+", " ")

    def text(kind: str) -> Column:
        name = E.PARTNERS[kind]
        return F.concat(F.lit("Passage 1: "), clean(_c("c1")), F.lit(f"\n{name} 1: "), _c("t1"), F.lit(f"\nso\n{name} 9: late\nPassage 2: "), clean(_c("c2")), F.lit(f"\n{name} 2: "), _c("t2"))

    every = F.flatten(F.array(*[E.generated_passages(text(k), k) for k in _KINDS]))
    return view(spark, d, "prompts").select("prompt", F.inline(every)).select("prompt", F.col("type").alias("kind"), "content", "partner")


def _rendered(template: str, values: Mapping[str, str]) -> str:
    """SQL that fills in a template."""
    parts = [values[x] if i % 2 else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
    return " || ".join(parts)


_FACTS = "'1. ' || t1 || chr(10) || list_position([t1, t2, t3], t2)::varchar || '. ' || t2 || chr(10) || list_position([t1, t2, t3], t3)::varchar || '. ' || t3"
_ASKED = {"question_type": "case when prompt::varchar like '1%' then 'bi' else 'oe' end", "question": "c1", "facts": f"({_FACTS})"}


@query("ask_prompts", " union all ".join(f"select prompt, '{task}' as task, '{kind or ''}' as prompt_type, {_rendered(t, _ASKED)} as shown from {duck('prompts')} g" for (task, kind), t in P.ASK.items()))
def ask_prompts(spark: SparkSession, d: str) -> DataFrame:
    """All templates that ask, filled in for every prompt."""
    ids = F.regexp_replace(_c("prompt").cast("string"), "^1", "s1")
    shown = [F.struct(F.lit(t).alias("task"), F.lit(k or "").alias("prompt_type"), P.ask_prompt(t, k, ids, _c("c1"), _types()).alias("shown")) for t, k in P.ASK]
    return view(spark, d, "prompts").select("prompt", F.inline(F.array(*shown)))


_WORDS = "len(list_filter(string_split_regex(c1, '\\s+'), lambda x: x <> ''))"
_SENTENCES = "len(list_filter(string_split_regex(c1, '[.!?]+'), lambda x: regexp_replace(x, '\\s', '', 'g') <> ''))"
_WRITTEN = {
    "query": "'q' || prompt::varchar", "gt_answer": "t1", "passage": "c1",
    "word_length": "case when n <= 0 then '10-50' else (round_even((case when n + 20 > 220 then 180 when n - 20 < 10 then 10 else n - 20 end) / 10.0::double, 0) * 10)::bigint::varchar || '-' || "
    "(round_even(least(case when n - 20 < 10 then 50 else n + 20 end, 220) / 10.0::double, 0) * 10)::bigint::varchar end",
    "sentence_length": "greatest(least(greatest(k, 1), 8) - 1, 1)::varchar || '-' || (least(greatest(k, 1), 8) + 1)::varchar",
}


@query("noise_templates", " union all ".join(
    f"select prompt, '{task}' as task, {_rendered(t, {k: f'({v})' for k, v in _WRITTEN.items()})} as shown from (select *, {_WORDS} as n, {_SENTENCES} as k from {duck('prompts')} g) x" for task, t in P.NOISE.items()))
def noise_templates(spark: SparkSession, d: str) -> DataFrame:
    """All templates that ask for passages, filled in for every prompt."""
    question = F.concat(F.lit("q"), _c("prompt").cast("string"))
    shown = [F.struct(F.lit(t).alias("task"), P.noise_prompt(t, question, F.array("t1"), _c("c1")).alias("shown")) for t in P.NOISE]
    return view(spark, d, "prompts").select("prompt", F.inline(F.array(*shown)))
