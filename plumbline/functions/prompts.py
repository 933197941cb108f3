"""Prompt templates by task, in our own words, and what is derived from an item to fill them in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

_PAIRS = "Write three passages of {sentence_length} sentences and {word_length} words each. Put each on a line as `Passage N: text`"

#: Templates that make passages with a known relation to a question.
NOISE = {
    "gen_counterfactual": "Question: {query}\nTrue answer: {gt_answer}\n" + _PAIRS + " that supports another, wrong answer, and below it `Counterfactual Answer N: answer`.",
    "gen_relevant": "Question: {query}\nTrue answer: {gt_answer}\n" + _PAIRS + " on the question's topic that does not hold the answer, and below it `Shared Topic/Keywords N: words`.",
    "gen_irrelevant": "Question: {query}\nTrue answer: {gt_answer}\n" + _PAIRS + " that has nothing to do with the question, and below it `Topic N: topic`.",
    "gen_consistent": "Question: {query}\nTrue answer: {gt_answer}\nSource: {passage}\n" + _PAIRS + " that says the same as the source in other words, and below it `Alternative Expression N: answer`.",
}

_CLOSE = "End with a line `Final Answer: ...` and a line `Confidence: N%`."

#: Templates that ask a question.
ASK = {
    ("base_pure", None): "Question ({question_type}): {question}\n" + _CLOSE,
    ("base_without_rules", None): "Question ({question_type}): {question}\nPassages:\n{facts}\n" + _CLOSE,
    ("ckpt_test", None): "Question ({question_type}): {question}\nPassages:\n{facts}\nThink in steps `Step N:`, list `Passage Classifications:` with one of Highly Relevant, Relevant, Irrelevant for each, then `Answer: ...` and `Confidence: N%`.",
    ("base_sample", None): "Question ({question_type}): {question}\nPassages:\n{facts}\nThink in steps `Step N:`, list `Passage Classifications:` with one of Highly Relevant, Relevant, Irrelevant for each, then `Answer: ...` and `Confidence: N%`.",
    ("rag_test", "vanilla"): "Question ({question_type}): {question}\nFacts:\n{facts}\n" + _CLOSE,
    ("rag_test", "cot"): "Question ({question_type}): {question}\nFacts:\n{facts}\nReason step by step first. " + _CLOSE,
    ("rag_test", "multi-step"): "Question ({question_type}): {question}\nFacts:\n{facts}\nAfter each step write `Step N Confidence: N%`, and last `Final Output:` with `Answer: ...`.",
}


def noise_template(task: str) -> str:
    if task not in NOISE:
        raise KeyError(f"no template for {task}")
    return NOISE[task]


def ask_template(task: str, prompt_type: str | None = None) -> str:
    key = (task, prompt_type if task == "rag_test" else None)
    if key not in ASK:
        raise KeyError(f"no template for {task}, {prompt_type}")
    return ASK[key]


def question_type(item_id: Column) -> Column:
    """Yes/no questions have ids that begin with s."""
    return F.when(item_id.startswith("s"), "bi").otherwise("oe")


def noise_prompt(task: str, question: Column, answers: Column, passage: Column) -> Column:
    """The first answer, and lengths like the true passage's."""
    values = {
        "query": question,
        "gt_answer": F.get(answers, F.lit(0)),
        "passage": passage if task == "gen_consistent" else F.lit(""),
        "word_length": T.word_range(T.word_count(passage)),
        "sentence_length": T.sentence_range(T.sentence_count(passage)),
    }
    return T.render(noise_template(task), values)


def ask_prompt(task: str, prompt_type: str | None, item_id: Column, question: Column, facts: Column) -> Column:
    values = {"question_type": question_type(item_id), "question": question, "facts": T.numbered_facts(facts)}
    return T.render(ask_template(task, prompt_type), values)
