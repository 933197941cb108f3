"""The three ways through the engine: generate and evaluate are one lazy plan each, curate checkpoints the groups of its ids."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import labels as L
from ..functions import prompts as P
from ..functions import text as T
from ..operators import curate as C
from ..operators import metrics as M
from ..sources.responder import Responder, replicas, respond


def latest(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Of rows with equal keys the last; rows without a key go."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return rows.where(known).withColumn("_last", last).where("_last = 1").drop("_last")


def passage_types(items: DataFrame, id_col: str = "id", passages_col: str = "passages") -> DataFrame:
    """Rows (id, types): lower-case types of the first three passages, of items that have three."""
    first = F.transform(F.slice(passages_col, 1, 3), lambda p: F.lower(p["type"]))
    return items.where(F.size(passages_col) >= 3).select(id_col, first.alias("types"))


def preferred_list(tree: Column) -> Column:
    """Of a map from prompt types to lists: vanilla, else cot, else test, else the first."""
    return F.coalesce(tree["vanilla"], tree["cot"], tree["test"], F.get(F.map_values(tree), F.lit(0)))


def annotate(rows: DataFrame, truths: Column, answer: Column, content: Column, confidence: Column) -> DataFrame:
    """rows with answer_used, confidence_value and is_correct; without truths nothing is correct."""
    used = F.coalesce(F.nullif(answer, F.lit("")), content, F.lit(""))
    return rows.withColumns({"answer_used": used, "confidence_value": T.confidence_words(confidence)}).withColumn("is_correct", T.judge(F.col("answer_used"), truths))


def task_grid(datasets: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Every data set with every task."""
    return datasets.withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))


def generate_noise(items: DataFrame, task: str, responder: Responder, **limits) -> DataFrame:
    """items with passages extended by the last three passages of one response each, which stand in generated too;
    status tells of failures."""
    kind = task.removeprefix("gen_")
    shown = items.withColumn("prompt", P.noise_prompt(task, F.col("question"), F.col("gt_answer"), F.coalesce("gt_passage", F.lit(""))))
    got = respond(shown.select("id", "prompt"), responder, **limits).select("id", "text", "status")
    rows = items.join(got, "id", "left").withColumn("_new", E.generated_passages(F.coalesce("text", F.lit("")), kind))
    kept = rows.withColumn("generated", F.slice("_new", F.greatest(F.size("_new") - 2, F.lit(1)), 3))
    if "passages" in items.columns:
        kept = kept.withColumn("passages", E.append_last(F.col("passages"), E.as_passages(F.col("_new"), items.schema["passages"].dataType.elementType, kind)))
    return kept.drop("_new", "text")


def ask(items: DataFrame, task: str, responder: Responder, facts: Column, prompt_type: str | None = None, samples: int = 1, **limits) -> DataFrame:
    """Long table (id, sample_id, prompt, text, status) of one task's responses."""
    shown = items.select("id", P.ask_prompt(task, prompt_type, F.col("id"), F.col("question"), facts).alias("prompt"))
    return respond(replicas(shown, samples), responder, **limits)


def evaluate(
    responses: DataFrame, items: DataFrame, task: str, prompt_type: str | None = None, unmatched: str = "skip", keys: Sequence[str] = ("model",),
    metrics: Sequence[str] | None = None, judge: Callable[[Column, Column], Column] = T.judge, adaptive: bool = False,
) -> DataFrame:
    """Metrics of responses (id, text and the keys) against items (id, truths, and types if labels are measured)."""
    found = E.extract(responses, E.spec_for(task, prompt_type), unmatched=unmatched)
    judged = found.join(items, "id").withColumn("correct", F.when(F.col("truths").isNotNull(), judge(F.col("answer"), F.col("truths"))))
    return M.evaluate(judged, list(keys), metrics, adaptive=adaptive)


def checkpointed(rows: DataFrame) -> DataFrame:
    """rows as a table in the checkpoint folder (a temporary one on one machine where none is set)."""
    sc = rows.sparkSession.sparkContext
    if rows.sparkSession.conf.get("spark.checkpoint.dir", None) is None and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
    return rows.checkpoint()


class Curated(tuple):
    """(triples, funnel), with the ruled rows that both read; close() frees them when both are done with."""

    ruled: DataFrame

    def close(self) -> None:
        self.ruled.unpersist()


def curate(responses: DataFrame, items: DataFrame, instruction: str, template: str, share: float = 0.0, tolerate: bool = False, policy: str = "reference", seed: int = 42) -> Curated:
    """Training triples with their model, and each model's funnel.

    responses: (id, model, sample_id, text, distill); items: (id, question, types, contents, truths). Ids that all
    models kept are balanced by prompt group, and each model's best response becomes a triple. The ruled rows are
    persisted (memory, then disk) until the caller calls close(): parsing is the costly step and four branches need it.
    The groups of the ids (short rows) are checkpointed by this call: the draw reads them five times, and Spark does not
    find persisted rows again in such copies of a plan. Ruled rows are without questions and contents, which
    join the chosen responses only. Of items that share an id, triples show the first by question and contents.
    """
    rows = responses.join(items.select("id", "types", "truths"), "id")
    ruled = C.apply_rules(rows, F.col("text"), F.col("types"), F.col("distill"), tolerate).persist()  # used by all that follows
    funnel = C.funnel(ruled, ["model"])
    kept = C.remove_longest(ruled.where("reject_reason is null"), ["model", "id"], F.col("content"), F.col("sample_id"), share)
    kept = C.only_common(kept, "id", "model")
    groups = kept.select("id", "types").dropDuplicates(["id"]).select("id", L.prompt_group(F.col("types")).alias("grp"))
    kept = kept.join(C.balance(checkpointed(groups), "id", "grp", seed), "id")
    marked = annotate(kept, F.col("truths"), F.col("model_answer"), F.col("content"), F.col("stated_confidence"))
    chosen = C.select_response(marked, ["model", "id"], F.col("is_correct"), F.col("confidence_value"), F.col("sample_id"), policy)
    shown_by = ["question", "contents"] if "{facts}" in template else ["question"]
    first = F.row_number().over(Window.partitionBy("id").orderBy(*shown_by))
    chosen = chosen.join(items.select("id", *shown_by, first.alias("_first")).where("_first = 1"), "id")
    shown = T.render(template, {"question": F.col("question"), "facts": T.training_facts(F.col("contents")) if "contents" in shown_by else F.lit("")})
    output = T.strip(F.coalesce("content", F.lit("")))
    marked_output = F.when(F.col("distill") & ~output.startswith("<think>"), F.concat(F.lit("<think>"), output)).otherwise(output)
    triples = chosen.select("model", "id", "grp", F.lit(instruction).alias("instruction"), shown.alias("input"), marked_output.alias("output"))
    out = Curated((triples, funnel))
    out.ruled = ruled
    return out
