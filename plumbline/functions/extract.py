"""Pattern cascades that read answers, confidences and labels out of free-text responses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import recover_labels
from .text import let, strip

#: All patterns ignore case, let . match line ends and ^ and $ match at lines, with \n as the only line end.
FLAGS = "(?ismduU)"
_ONE_LABEL = r"(##Highly Relevant##|##Relevant##|##Irrelevant##)"
_ANY_LABEL = r"(##Highly Relevant##|##Relevant##|##Irrelevant##|Highly\s+Relevant|Relevant|Irrelevant)"
_BARE_LABEL = r"(Highly\s+Relevant|Relevant|Irrelevant)"


def _label_patterns(i: int, place: str) -> list[str]:
    """Where the label of passage i stands, tried in this order."""
    mention, loose = rf"(?:Passage\s+{i}|{place}\s+passage)", rf"(?:Passage\s+{i}|{place}\s+passage|passage\s+{i})"
    return [
        rf"Passage Classifications:.*?{i}\.\s*{_BARE_LABEL}",
        rf"Passage Analysis:.*?{i}\.\s*{_ONE_LABEL}",
        rf"{i}\.\s*{_ONE_LABEL}",
        rf"{mention}.*?{_ONE_LABEL}",
        rf"{mention}.*?{_BARE_LABEL}",
        rf"{loose}.*?(?:is|as|:)\s*{_ANY_LABEL}",
        rf"{loose}.*?(?:talks|discusses|mentions|says|states).*?{_ANY_LABEL}",
    ]


@dataclass(frozen=True)
class ExtractorSpec:
    """Fields with their patterns in order; rows without a required field are unmatched."""

    fields: dict[str, Sequence[str]]
    required: tuple[str, ...] = ("answer", "confidence")
    labels: tuple[str, ...] = field(default=())


#: Patterns by kind of response.
SPECS: dict[str, ExtractorSpec] = {
    "default": ExtractorSpec(
        {
            "answer": [r"\[*\**Final Answer\]*\**:\s*#+(.*?)#+", r"\[*\**Final Answer\]*\**:\s*(.*?)\n"],
            "confidence": [
                r"\[*\**Final Confidence\]*\**:\s*#+(\d+)%*#+",
                r"\[*\**Final Confidence\]*\**:\s*#*(\d+)%*#*\*+",
                r"\[*\**Final Confidence\]*\**:\s*#*(\d+)%+#*\**",
            ],
        }
    ),
    "ckpt_test": ExtractorSpec(
        {
            "passage_1_label": _label_patterns(1, "First"),
            "passage_2_label": _label_patterns(2, "Second"),
            "passage_3_label": _label_patterns(3, "Third"),
            "answer": [r"Answer:\s*(.*?)(?:\n|Confidence|$)", r"\[*\**Final Answer\]*\**:\s*\*+(.*?)\*+"],
            "confidence": [
                r"Confidence:\s*(\d+)\s*%",
                r"\[*\**Final Confidence\]*\**:\s*#+(\d+)%+#*",
                r"\[*\**Final Confidence\]*\**:\s*#+(\d+)%*#+",
            ],
        },
        labels=("passage_1_label", "passage_2_label", "passage_3_label"),
    ),
    "base": ExtractorSpec(
        {
            "answer": [r"Final Answer\**\s*:\s*\**\s*(.*?)(?:\n|$)"],
            "confidence": [r"Confidence\**\s*:\s*\**\s*([0-9]+(?:\.[0-9]+)?)\s*%?"],
        }
    ),
    "rag_plain": ExtractorSpec(
        {
            "answer": [
                r"Final Answer:\s*([^\n]+?)(?:\n|Confidence|$)",
                r"Final Answer:\s*(.+?)(?:Confidence:|$)",
                r"^Answer:\s*([^\n]+?)(?:\n|Confidence|$)",
            ],
            "confidence": [r"Confidence:\s*(\d+(?:\.\d+)?)\s*%", r"Confidence:\s*(\d+(?:\.\d+)?)"],
        }
    ),
    "rag_multi_step": ExtractorSpec(
        {
            "answer": [
                r"Answer:\s*([^\n]+?)(?:\n|$)(?!.*Answer:)",
                r"Final Output:.*?Answer:\s*([^\n]+?)(?:\n|Step\s+\d+\s+Confidence|$)",
                r"Answer:\s*(.+?)(?:\n|Step\s+\d+\s+Confidence|$)",
            ],
            "confidence": [
                r"Step\s+\d+\s+Confidence:\s*(\d+(?:\.\d+)?)\s*%[^\n]*$",
                r"Final\s+Confidence:\s*(\d+(?:\.\d+)?)\s*%",
                r"Confidence:\s*(\d+(?:\.\d+)?)\s*%?\s*$",
                r"Confidence:\s*(\d+(?:\.\d+)?)\s*%",
            ],
        }
    ),
}


def spec_for(task: str, prompt_type: str | None = None) -> ExtractorSpec:
    if task in ("base_without_rules", "base_pure"):
        return SPECS["base"]
    if task == "rag_test":
        return SPECS["rag_multi_step" if prompt_type == "multi-step" else "rag_plain"]
    if task not in SPECS:
        raise ValueError(f"no patterns for {task}")
    return SPECS[task]


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches, or null."""
    return F.coalesce(*[F.when(text.rlike(FLAGS + p), F.regexp_extract(text, FLAGS + p, 1)) for p in patterns])


def unmatched_strategy(path: Column, default: str, by_prefix: Mapping[str, str]) -> Column:
    """The strategy of the first prefix with which a path key begins, else the default."""
    out = None
    for prefix, strategy in by_prefix.items():
        hit = path.startswith(prefix)
        out = F.when(hit, F.lit(strategy)) if out is None else out.when(hit, F.lit(strategy))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def extract(
    responses: DataFrame, spec: ExtractorSpec, text_col: str = "text", unmatched: str = "skip", by_prefix: Mapping[str, str] | None = None, path_col: str = "path_key"
) -> DataFrame:
    """responses with a column for each field, and matched. unmatched: skip drops rows without a required field,
    empty_0 and empty_100 (also anything else) give them an empty answer with that confidence. by_prefix: other
    strategies for the rows whose path_col begins with a prefix; the first that fits counts."""
    text = F.col(text_col)
    found = responses.withColumns({f: first_match(text, p) for f, p in spec.fields.items()})
    ok = F.lit(True)
    for f in spec.required:
        ok = ok & F.col(f).isNotNull()
    found = found.withColumn("matched", ok)
    if spec.labels:
        recovered = recover_labels(text, [F.col(c) for c in spec.labels])
        found = found.withColumns(dict(zip(spec.labels, recovered, strict=True)))
    if unmatched == "skip" and not by_prefix:
        return found.where("matched")
    strategy = unmatched_strategy(F.col(path_col), unmatched, by_prefix) if by_prefix else F.lit(unmatched)
    filler = {"answer": F.lit(""), "confidence": F.when(strategy == "empty_0", F.lit("0")).otherwise(F.lit("100"))}
    found = found.where(F.col("matched") | (strategy != "skip"))
    return found.withColumns({f: F.when(F.col("matched"), F.col(f)).otherwise(filler.get(f, F.lit(None).cast("string"))) for f in spec.fields})


#: The lines and marks that the rules look for.
RULE_ANSWER = r"(?iuU)\[?\s*(?:Final\s+)?Answer\s*\]?\s*[:：]\s*([^\n]+)"
RULE_CONFIDENCE = r"(?iuU)\[?\s*Confidence\s*\]?\s*[:：]\s*([^\n]+)"
RULE_STEPS = r"(?iuU)step\s*\d+\s*[:：]"
RULE_STEP_FOUR = r"(?iuU)step\s*4\s*[:：]"


def rule_answer(text: Column) -> Column:
    return _line_value(text, RULE_ANSWER)


def rule_confidence(text: Column) -> Column:
    return _line_value(text, RULE_CONFIDENCE)


def _line_value(text: Column, pattern: str) -> Column:
    return let(strip(F.regexp_extract(text, pattern, 1)), lambda x: F.when(x != "", x))


def has_steps(text: Column) -> Column:
    return text.rlike(RULE_STEPS)


def has_step_four(text: Column) -> Column:
    return text.rlike(RULE_STEP_FOUR)


#: The partner line of each kind of generated passage.
PARTNERS = {
    "counterfactual": "Counterfactual Answer",
    "relevant": "Shared Topic/Keywords",
    "irrelevant": "Topic",
    "consistent": "Alternative Expression",
}


def generated_passages(text: Column, kind: str) -> Column:
    """Passages of a generation response: array of (content, type, partner).

    A line "Passage ...: p" opens a passage, a later line "<partner> ...: x" completes it (the last one counts);
    a line without ": " once stripped, such as "Passage 2:", is its own value; pairs that lack either line are left out.
    """
    item = "array<struct<content:string,type:string,partner:string>>"
    value = lambda x: F.when(F.instr(x, ": ") > 0, F.substr(x, F.instr(x, ": ") + 2)).otherwise(x)
    state = lambda done, p, a: F.struct(done.alias("done"), p.alias("p"), a.alias("a"))
    nothing = F.lit(None).cast("string")

    def closed(acc: Column) -> Column:
        whole = F.coalesce((acc["p"] != "") & (acc["a"] != ""), F.lit(False))
        one = F.array(F.struct(acc["p"].alias("content"), F.lit(kind).alias("type"), acc["a"].alias("partner"))).cast(item)
        return F.when(whole, F.concat(acc["done"], one)).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        return (
            F.when(line.startswith("Passage "), state(closed(acc), value(line), nothing))
            .when(line.startswith(PARTNERS[kind] + " "), state(acc["done"], acc["p"], value(line)))
            .otherwise(acc)
        )

    lines = F.transform(F.split(strip(text), "\n"), strip)
    return F.aggregate(lines, state(F.array().cast(item), nothing, nothing), step, closed)


def append_last(passages: Column, parsed: Column, n: int = 3) -> Column:
    """passages and the last n parsed ones (all, if fewer)."""
    tail = F.when(F.size(parsed) > n, F.slice(parsed, -n, n)).otherwise(parsed)
    return F.concat(F.coalesce(passages, F.slice(parsed, 1, 0)), tail)


def as_passages(parsed: Column, element: T.DataType, kind: str) -> Column:
    """Parsed passages in the element type of an item's passages: text alone, or a struct with the fields it has."""
    if not isinstance(element, T.StructType):
        return F.transform(parsed, lambda p: p["content"].cast(element))
    source = {"content": "content", "type": "type", PARTNERS[kind]: "partner"}
    field = lambda p, f: (p[source[f.name]] if f.name in source else F.lit(None)).cast(f.dataType).alias(f.name)
    return F.transform(parsed, lambda p: F.struct(*[field(p, f) for f in element.fields]))
