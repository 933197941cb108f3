"""JSON of unknown shape as VARIANT: items of lists or objects, and projection along paths.

Defined cases: text that is no JSON has no items; values of an object or list that are no objects or lack an id are no
items of `latest_items`; a path that leads nowhere is an error, unless told to skip; a JSON null at its end is no
answer and gives no row, as do an empty list and an object without a list. The values of an object are tried in the
order of their names where the first list among them is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .json_io import model_of

#: Keys that are preferred among the lists of an object, in this order.
PREFERRED = ("vanilla", "cot", "test")
#: Endings of file names that are a key below every path.
PROMPT_TYPES = ("vanilla", "cot")


def read_texts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows (file, value) of whole JSON files."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_name").alias("file"), "value")


def items(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Each text's items, whether it holds a list or an object of them: its other columns, pos and item (VARIANT)."""
    listed = F.from_json(text_col, "array<variant>")
    keyed = F.map_values(F.from_json(text_col, "map<string,variant>"))  # in the text's order
    each = F.when(F.ltrim(text_col).startswith("["), listed).otherwise(keyed)
    return texts.select(*[c for c in texts.columns if c != text_col], F.posexplode(each).alias("pos", "item"))


def latest_items(found: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Rows (keys, id, pos, item): of the items of a file that have an id, the last of each id."""
    rows = found.withColumn("id", F.try_variant_get("item", "$.id", "string")).where("id is not null")
    last = rows.groupBy(*keys, "id").agg(F.max_by(F.struct("pos", "item"), "pos").alias("last"))
    return last.select(*keys, "id", "last.*")


def load(spark: SparkSession, directory: str) -> DataFrame:
    """Rows (file, id, pos, item) of a directory's JSON files, lists or objects alike; an error where there is none."""
    texts = read_texts(spark, directory)
    if texts.isEmpty():
        raise ValueError(f"no JSON files in {directory}")
    return latest_items(items(texts))


def json_path(path: Sequence[str | int]) -> str:
    def step(key: str | int) -> str:
        if isinstance(key, int):
            return f"[{key}]"
        if '"' in key and "'" in key:
            raise ValueError(f"a key with both kinds of quotes: {key}")
        return f"['{key}']" if '"' in key else f'["{key}"]'

    return "$" + "".join(map(step, path))


def at_path(tree: Column, path: Sequence[str | int], missing: str = "raise") -> Column:
    """What stands at a path of keys and list places; nothing there: an error, or null with missing="skip"."""
    if missing not in ("raise", "skip"):
        raise ValueError("missing is raise or skip")
    value = F.try_variant_get(tree, json_path(path), "variant")
    lost = F.raise_error(F.lit(f"path not found: {'/'.join(map(str, path))}"))
    return value if missing == "skip" else let(value, lambda v: F.when(v.isNull() & tree.isNotNull(), lost).otherwise(v))


def _is(kind: str, v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def first_text(value: Column) -> Column:
    """The text of a value: of a list its first, of an object the first of its preferred list, or of its first list."""
    head = lambda v: F.try_variant_get(v, "$[0]", "string")
    lists = lambda v: F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: _is("ARRAY", x))
    named = lambda v: [F.try_variant_get(v, json_path([k]), "variant") for k in PREFERRED]
    chosen = lambda v: F.coalesce(*[F.when(_is("ARRAY", x), x) for x in named(v)], F.get(lists(v), F.lit(0)))
    return let(value, lambda v: F.when(_is("ARRAY", v), head(v)).when(_is("OBJECT", v), head(chosen(v))).otherwise(F.try_variant_get(v, "$", "string")))


def project(found: DataFrame, paths: Sequence[Sequence[str | int]], missing: str = "raise", by_file: bool = False) -> DataFrame:
    """Rows (columns of found without item, id, path_key, text): each item's answer at each path.

    by_file: files whose names end in a prompt type have it as one more key below every path.
    """
    suffix = model_of(F.col("file")) if by_file else F.lit(None).cast("string")

    def one(path: Sequence[str | int]) -> Column:
        value, key = at_path(F.col("item"), path, missing), "/".join(map(str, path))
        text, keys = first_text(value), F.lit(key)
        if by_file:
            for kind in PROMPT_TYPES:
                deeper = first_text(at_path(F.col("item"), [*path, kind], missing))
                text, keys = F.when(suffix == kind, deeper).otherwise(text), F.when(suffix == kind, F.lit(f"{key}/{kind}")).otherwise(keys)
        return F.struct(keys.alias("path_key"), text.alias("text"))

    kept = [c for c in found.columns if c not in ("item", "id")]
    rows = found.select(*kept, F.try_variant_get("item", "$.id", "string").alias("id"), F.inline(F.array(*map(one, paths))))
    return rows.where("text is not null")
