"""Passage types, labels and the label block of a response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: Labels, and the passage types each stands for.
HIGH, SOME, NONE = "Highly Relevant", "Relevant", "Irrelevant"
LABELS = (HIGH, SOME, NONE)
HIGH_TYPES = ("gt_passage", "consistent", "counterfactual")
#: How the parts of a label block are recognised.
BLOCK_TITLE = "passage classifications"
LIST_ITEM = r"(?U)^\s*\d+\.\s*(.+?)\s*$"
INLINE_ITEM = r"(?iuU)\d+\.\s*([^\d\n]+?)(?=\s*\d+\.|\s*(?:\n|answer|confidence|##|$))"
INLINE_BLOCK = r"(?isuU)passage\s+classifications\s*:?\s*(.+?)(?=\n\s*(?:answer|confidence|##|\z))"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
OTHER_ENDS = r"[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028-\u2029]"


def expected_label(type_: Column, fold: bool = False, marks: bool = False) -> Column:
    """The label a passage of this type should get; null for other types. fold: any case; marks: as ##label##."""
    t = F.lower(type_) if fold else type_
    label = F.when(t.isin(*HIGH_TYPES), HIGH).when(t == "relevant", SOME).when(t == "irrelevant", NONE)
    return F.concat(F.lit("##"), label, F.lit("##")) if marks else label


def expected_labels(types: Column) -> Column:
    """Labels of exactly three passages, or null."""
    found = F.transform(types, lambda t: expected_label(t))
    return F.when(F.size(types) == 3, let(found, lambda x: F.when(~F.exists(x, lambda y: y.isNull()), x)))


def prompt_group(types: Column) -> Column:
    """counterfactual before consistent before irrelevant (three passages, none of another type), else unknown."""
    return (
        F.when(F.exists(types, lambda t: t == "counterfactual"), "counterfactual")
        .when(F.exists(types, lambda t: t.isin("gt_passage", "consistent")), "consistent")
        .when((F.size(types) == 3) & F.forall(types, lambda t: t.isin("relevant", "irrelevant")), "irrelevant")
        .otherwise("unknown")
    )


def evaluation_group(types: Column) -> Column:
    """The evaluator's grouping: any case, any number of passages, null for none or for other types."""
    low = F.transform(types, lambda t: F.lower(t))
    return (
        F.when(F.size(types) == 0, F.lit(None).cast("string"))
        .when(F.exists(low, lambda t: t == "counterfactual"), "counterfactual")
        .when(F.exists(low, lambda t: t.isin("gt_passage", "consistent")), "consistent")
        .when(F.forall(low, lambda t: t.isin("relevant", "irrelevant")), "relevant_irrelevant")
    )


def canonical_label(c: Column) -> Column:
    """The label whose words stand in a text, with whatever marks and spaces around them."""
    return let(F.lower(c), lambda s: F.when(s.contains("highly"), HIGH).when(s.contains("irrelevant"), NONE).when(s.contains("relevant"), SOME))


def comparable_label(c: Column) -> Column:
    """Trimmed lower case; null if empty."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def _lines(text: Column) -> Column:
    """Without an empty last line. Spark compiles a pattern to split by for each row, except single characters."""
    lines = F.when(text.rlike(OTHER_ENDS), F.split(text, LINE_ENDS)).otherwise(F.split(text, "\n"))
    return let(lines, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def _is_stop(line: Column) -> Column:
    low = F.lower(line)
    return line.startswith("##") | ((low.contains("answer") | low.contains("confidence")) & line.contains(":"))


def _inline(text: Column) -> Column:
    """Labels of numbered items within a text, in order."""
    items = F.transform(F.regexp_extract_all(text, F.lit(INLINE_ITEM), F.lit(1)), lambda x: canonical_label(x))
    return F.filter(items, lambda x: x.isNotNull())


def _after_colon(line: Column) -> Column:
    return strip(F.when(line.contains(":"), F.substr(line, F.instr(line, ":") + 1)).otherwise(F.lit("")))


def _item(line: Column) -> Column:
    """What follows the number of a list item, which is never empty, or null."""
    return let(F.regexp_extract(line, LIST_ITEM, 1), lambda x: F.when(x != "", x))


def label_block(text: Column) -> Column:
    """The three labels of the label block, or null: by lines under its title, else numbered items within it.

    A fold over lines; state: labels, and 0 while reading, 1 at the block's end, 2 when it is spoilt. What is read off a
    line is named by let: Spark evaluates a lambda's repeated expressions each time.
    """
    state = lambda labels, mode: F.struct(labels.alias("labels"), mode.alias("mode"))
    none = F.array().cast("array<string>")
    counted = lambda labels: let(labels, lambda x: state(x, (F.size(x) == 3).cast("int")))

    def step(acc: Column, raw: Column) -> Column:
        def read(line: Column) -> Column:
            return (
                F.when(F.lower(line).contains(BLOCK_TITLE), counted(F.slice(F.concat(acc["labels"], _inline(_after_colon(line))), 1, 3)))
                .when(_is_stop(line), state(acc["labels"], F.lit(1)))
                .otherwise(let(_item(line), lambda item: F.when(item.isNull(), acc).otherwise(let(canonical_label(item), added))))
            )

        def added(label: Column) -> Column:
            spoilt = F.when(F.size(acc["labels"]) > 0, 1).otherwise(2)
            return F.when(label.isNull(), state(acc["labels"], spoilt)).otherwise(counted(F.concat(acc["labels"], F.array(label))))

        return F.when(acc["mode"] != 0, acc).otherwise(let(strip(raw), read))

    def chosen(x: Column) -> Column:
        return F.when(x["mode"] == 2, None).when(F.size(x["labels"]) == 3, x["labels"]).otherwise(let(F.slice(_inline(F.regexp_extract(F.lower(text), INLINE_BLOCK, 1)), 1, 3), lambda w: F.when(F.size(w) == 3, w)))

    def found(at: Column) -> Column:
        return F.when(at > 0, let(F.aggregate(_lines(F.substr(text, at)), state(none, F.lit(0)), step), chosen))

    return let(F.instr(F.lower(text), BLOCK_TITLE), found)


def normal_block(text: Column, labels: Column | None = None) -> Column:
    """The text with its label block in four standard lines and without later lines that begin with ##.

    Texts without a readable block are unchanged. labels: those of label_block, where they are known already.
    """
    state = lambda items, used, open_: F.struct(items.alias("items"), used.alias("used"), open_.alias("open"))

    def step(acc: Column, raw: Column) -> Column:
        def read(line: Column) -> Column:
            more = let(acc["items"] + _item(line).isNotNull().cast("int"), lambda items: state(items, acc["used"] + 1, items < 3))
            return F.when(_is_stop(line), state(acc["items"], acc["used"], F.lit(False))).otherwise(more)

        return F.when(~acc["open"], acc).otherwise(let(strip(raw), read))

    def rebuilt(x: Column) -> Column:
        lines, start = x["lines"], x["start"]
        one_line = F.size(_inline(_after_colon(F.element_at(lines, start)))) >= 3
        used = F.aggregate(F.slice(lines, start + 1, F.size(lines)), state(F.lit(0), F.lit(0), F.lit(True)), step)["used"]
        tail = F.filter(F.slice(lines, start + F.when(one_line, 0).otherwise(used) + 1, F.size(lines)), lambda y: ~strip(y).startswith("##"))
        numbered = F.transform(x["labels"], lambda y, i: F.concat((i + 1).cast("string"), F.lit(". "), y))
        return F.array_join(F.concat(F.slice(lines, 1, start - 1), F.array(F.lit("Passage Classifications:")), numbered, tail), "\n")

    titled = lambda lines: F.array_position(F.transform(lines, lambda y: F.lower(y).contains(BLOCK_TITLE)), True).cast("int")
    known = label_block(text) if labels is None else labels
    parts = let(_lines(text), lambda y: F.struct(y.alias("lines"), titled(y).alias("start"), known.alias("labels")))
    return let(parts, lambda x: F.when(x["labels"].isNull() | (x["start"] == 0), text).otherwise(rebuilt(x)))


def standard_answer(text: Column) -> Column:
    """"Final Answer:" becomes "Answer:"."""
    return F.regexp_replace(text, r"(?iuU)\[?\s*Final\s+Answer\s*\]?\s*[:：]", "Answer:")


#: Labels as they stand in free text, and the words for the places of passages.
_LABEL = r"((?:##)?(?:Highly\s+Relevant|Relevant|Irrelevant)(?:##)?)"
_MARKED = r"(?iuU)(##Highly Relevant##|##Relevant##|##Irrelevant##)"
_BARE = r"(?iuU)\b(Highly\s+Relevant|Relevant|Irrelevant)\b"
_PLACES = ("First", "Second", "Third")
#: What may stand between a passage's mention and its label, tried in this order.
_BETWEEN = (
    r".*?(?:is|as|:)\s*",
    r".*?(?:talks|discusses|mentions|says|states|confirms).*?",
    r".*?(?:so|therefore|thus|hence).*?",
    r".*?this.*?",
    r".{0,200}?",
)


def marked_label(c: Column) -> Column:
    """A label in any form as ##label##, or null."""
    s = F.lower(c)
    return F.when(s.contains("highly relevant"), f"##{HIGH}##").when(s.contains("irrelevant"), f"##{NONE}##").when(s.contains("relevant"), f"##{SOME}##")


def recover_labels(text: Column, found: list[Column]) -> list[Column]:
    """Labels of passages 1 to 3: as extracted, else near a mention of the passage, else the text's distinct labels
    in order (marked ones first), else empty."""
    near = []
    for i, c in enumerate(found):
        mention = rf"(?isuU)(?:Passage\s+{i + 1}|{_PLACES[i]}\s+passage)"
        tries = [F.when(text.rlike(p), marked_label(F.regexp_extract(text, p, 1))) for p in (mention + b + _LABEL for b in _BETWEEN)]
        near.append(F.coalesce(marked_label(c), c, *tries))
    every = F.concat(F.regexp_extract_all(text, F.lit(_MARKED), F.lit(1)), F.regexp_extract_all(text, F.lit(_BARE), F.lit(1)))
    distinct = F.array_distinct(F.filter(F.transform(every, lambda x: marked_label(x)), lambda x: x.isNotNull()))
    out, missing = [], F.lit(0)
    for c in near:
        out.append(F.coalesce(c, F.get(distinct, missing), F.lit("")))
        missing = missing + c.isNull().cast("int")
    return out
