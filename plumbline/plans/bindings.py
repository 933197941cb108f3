"""The engine's input views over the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession


def _label(t: str) -> str:
    return f"case when {t} in ('gt_passage', 'consistent', 'counterfactual') then 'Highly Relevant' when {t} = 'relevant' then 'Relevant' else 'Irrelevant' end"


_NL = "chr(10)"

#: Judged predictions with a stated confidence, some of which is no number.
PRED = """
select event_id as id, user_id % 4 as model, event_type as dataset, event_type as answer,
  case when event_id % 37 = 0 then 'high' else concat(cast(cast(floor(least(value, 100)) as bigint) as string), '%') end as confidence, (user_id + event_id) % 3 = 0 as correct, user_id, value
from {events}
"""

#: Assistant turns with the turn before as truth.
QA = """
select conv_id, turn, text as prediction, truth
from (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) as truth from {conversations}) q
where role = 'assistant'
"""

_PROMPT = "cast(floor(doc_id / 3.0) as bigint)"

#: What a passage is by its labels, which may be missing.
_TYPE = "case when toxic = 1 then 'counterfactual' when quality = 1 then 'consistent' when quality = 0 then 'relevant' else 'irrelevant' end"

PASSAGES = f"""
select d.doc_id, cast(floor(d.doc_id / 3.0) as bigint) as prompt, cast(d.doc_id % 3 as int) + 1 as pos, {_TYPE} as type, d.text as content
from {{documents}} d left join {{labels}} l on d.doc_id = l.doc_id
"""


def _three(name: str, value: str) -> str:
    return ", ".join(f"max(case when doc_id % 3 = {i} then {value} end) as {name}{i + 1}" for i in range(3))


#: One row a prompt with three passages, empty ones where a document is missing. Types meet texts by prompt, so each text is shuffled once.
PROMPTS = f"""
select c.prompt, coalesce(t1, 'irrelevant') as t1, coalesce(t2, 'irrelevant') as t2, coalesce(t3, 'irrelevant') as t3, coalesce(c1, '') as c1, coalesce(c2, '') as c2, coalesce(c3, '') as c3
from (select {_PROMPT} as prompt, {_three('c', 'text')} from {{documents}} where doc_id is not null group by {_PROMPT}) c
left join (select {_PROMPT} as prompt, {_three('t', _TYPE)} from {{labels}} group by {_PROMPT}) t on c.prompt = t.prompt
"""

_THIRD = f"case when (prompt + s) % 5 = 0 then case when {_label('t3')} = 'Relevant' then 'Irrelevant' else 'Relevant' end else {_label('t3')} end"

#: Four sampled responses a prompt, some of them malformed.
RESP = f"""
select prompt, s, t1, t2, t3, l1, l2, l3, conf, answer, concat(
    case when k % 11 = 0 then '' when k % 7 = 0 then concat('Step 1: read', {_NL}, 'Step 2: compare', {_NL})
      else concat('Step 1: read', {_NL}, 'Step 2: compare', {_NL}, 'step 3 : weigh', {_NL}, 'Step 4: decide', {_NL}) end,
    case when k % 13 = 2 then concat('Passage Classifications:', {_NL}, '1. ', l1, {_NL}, '2. ', l2, {_NL}, {_NL})
      when k % 4 = 1 then concat('passage classifications: 1. ', lower(l1), ' 2. ', l2, ' 3. ', l3, {_NL})
      else concat('Passage Classifications:', {_NL}, '1. ', l1, {_NL}, '2. ', l2, {_NL}, '3. ', l3, {_NL}, {_NL}) end,
    case when k % 3 = 0 then 'Final Answer: ' else 'Answer: ' end, answer, {_NL},
    case when k % 17 = 5 then '' else concat('Confidence: ', cast(conf as string), '%', {_NL}) end) as text
from (
  select prompt, s, t1, t2, t3, prompt * 4 + s as k, {_label('t1')} as l1, {_label('t2')} as l2, {_THIRD} as l3, (prompt * 7 + s * 13) % 101 as conf,
    case when (prompt + s) % 2 = 0 then 'alpha river' else 'beta hill' end as answer
  from {{prompts}} g cross join (select 0 as s union all select 1 union all select 2 union all select 3) v) r
"""

VIEWS = {"pred": PRED, "qa": QA, "passages": PASSAGES, "prompts": PROMPTS, "resp": RESP}


def tables_of(sql: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(sql) if name}


def _dealt(prompts: DataFrame) -> DataFrame:
    """Prompts dealt out anew: rows are short where texts are pruned, but each makes four responses that are parsed.

    Adaptive execution gathers them by size into one or two tasks; a number asked for it leaves alone. In turn, not by
    prompt: that is how they lie already, so Spark would drop the step and gather them again.
    """
    spark = prompts.sparkSession
    return prompts.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: _dealt(view(spark, sf_dir, t)) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def duck(name: str) -> str:
    sql = VIEWS[name]
    return "(" + sql.format(**{t: duck(t) if t in VIEWS else t for t in tables_of(sql)}) + ")"
