"""JSON edges: item files, extracted files, metrics documents, resuming and file lists."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of an item and of an extracted row.
ITEM = (
    "id string, question string, answer array<string>, gold_answers array<string>, gt_answer array<string>, true_answer array<string>, "
    "consistent_answer array<string>, answer_bool boolean, gt_passage string, "
    "passages array<struct<content:string,type:string,`Counterfactual Answer`:string,`Shared Topic/Keywords`:string,Topic:string,`Alternative Expression`:string>>, "
    "`bm25-facts` array<string>, `Contriever-facts` array<string>"
)
EXTRACTED = (
    "array<struct<id:string,answer:string,confidence:string,passage_1_label:string,passage_2_label:string,passage_3_label:string,true_answer:array<string>>>"
)


def read_items(spark: SparkSession, path: str | Sequence[str], schema: str = ITEM) -> DataFrame:
    """Items of files that hold one JSON array each, with the file's name."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("file", F.col("_metadata.file_name"))


def read_extracted(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Rows of files that map path keys to lists of rows: (file, path_key, and the row's fields)."""
    text = spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_name"))
    rows = F.from_json("value", f"map<string,{EXTRACTED}>")
    return text.select("file", F.explode(rows).alias("path_key", "rows")).select("file", "path_key", F.inline("rows"))


def flatten_responses(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Long table of the nested response trees: (id, task, fact_source, prompt_type, sample_id, text).

    Trees have lists under the task, under task and prompt type, or under task, fact source and prompt type.
    """
    text = spark.read.option("wholetext", True).text(path).withColumn("file", F.col("_metadata.file_name"))
    items = text.select("file", F.explode(F.from_json("value", "array<struct<id:string,response:map<string,string>>>")).alias("i"))
    tasks = items.select("file", F.col("i.id").alias("id"), F.explode("i.response").alias("task", "tree"))
    level = lambda c: F.from_json(c, "map<string,string>")
    deep = tasks.withColumn("flat", F.from_json("tree", "array<string>"))
    one = deep.where("tree like '[%'").select("file", "id", "task", F.lit(None).cast("string").alias("fact_source"), F.lit(None).cast("string").alias("prompt_type"), "flat")
    two = deep.where("tree like '{%'").select("file", "id", "task", F.explode(level(F.col("tree"))).alias("key", "sub"))
    lists = two.where("sub like '[%'").select("file", "id", "task", F.lit(None).cast("string").alias("fact_source"), F.col("key").alias("prompt_type"), F.from_json("sub", "array<string>").alias("flat"))
    three = two.where("sub like '{%'").select("file", "id", "task", F.col("key").alias("fact_source"), F.explode(level(F.col("sub"))).alias("prompt_type", "leaf"))
    three = three.select("file", "id", "task", "fact_source", "prompt_type", F.from_json("leaf", "array<string>").alias("flat"))
    rows = one.unionByName(lists).unionByName(three)
    return rows.select("file", "id", "task", "fact_source", "prompt_type", F.posexplode("flat").alias("sample_id", "text"))


def nest_responses(responses: DataFrame) -> DataFrame:
    """The other way: one JSON tree for each id. Fact sources and prompt types may be null."""
    lists = responses.groupBy("id", "task", "fact_source", "prompt_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("sample_id", "text"))), lambda x: x["text"]).alias("texts"))
    leaf = lists.withColumn("tree", F.to_json("texts"))
    entry = lambda k, v: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), v)
    body = lambda key: F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry(F.col(key), F.col("tree")))), ","), F.lit("}"))
    plain = leaf.where("prompt_type is null").select("id", "task", "tree")
    typed = leaf.where("prompt_type is not null").groupBy("id", "task", "fact_source").agg(body("prompt_type").alias("tree"))
    sourced = typed.where("fact_source is not null").groupBy("id", "task").agg(body("fact_source").alias("tree"))
    every = plain.unionByName(typed.where("fact_source is null").select("id", "task", "tree")).unionByName(sourced)
    return every.groupBy("id").agg(body("task").alias("response"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resume_source(spark: SparkSession, input_path: str, output_path: str, check: bool = True) -> str:
    """The output where it can be continued, else the input. check: its first five rows need an id and a question."""
    if not exists(spark, output_path):
        return input_path
    if not check:
        return output_path
    head = read_items(spark, output_path).select("id", "question").limit(5).collect()
    return output_path if head and all(r["id"] is not None and r["question"] is not None for r in head) else input_path


def with_position(df: DataFrame, name: str = "position", file_col: str = "file") -> DataFrame:
    """Rows numbered from 0: by file name and place within the file where df has the file's name, else by partition.

    A file of one JSON array is read by one task, row after row; which partition holds which file is Spark's choice, so the
    places count from the file's first row and the files' sizes move them. Call it before rows are filtered or shuffled.
    """
    rows = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.col(file_col) if file_col in df.columns else F.shiftright("_m", 33)
    rows = rows.withColumn("_p", part)
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))  # one row for each file or partition
    starts = sizes.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_start"))
    return rows.join(starts, "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_start")).drop("_m", "_p", "_first", "_start")


def slice_items(df: DataFrame, start: int = 0, end: int | None = None, plain: bool = False) -> DataFrame:
    """Items start to end (end None or 0: to the last), bounds clamped; an empty range is all of a file of under five
    items. plain: the other tool's rule, which cuts only where there is an end and leaves empty ranges empty."""
    if plain and not end:
        return df
    rows = with_position(df)
    n = rows.count()
    lo, hi = max(0, min(start, n)), n if not end else max(0, min(end, n))
    if lo >= hi and not plain:
        lo, hi = (0, n) if n < 5 else (0, 0)
    return rows.where((F.col("position") >= lo) & (F.col("position") < hi)).drop("position")


def continue_in_place(spark: SparkSession, results: DataFrame, input_path: str, output_path: str, key: str = "id", schema: str = ITEM) -> int:
    """The whole file with the results of some of its items, in place of the output; returns the number of items.

    The whole file is the output where it can be continued, else the input. Items keep their order and, where results
    have none for them, their values; results for other ids follow in the order of the ids. Of several results of an id
    one at random would stay, so they are an error. The output is replaced at the end by a rename: a run that
    fails before leaves it as it was.
    """
    from .array_sink import write_array

    repeated = results.groupBy(key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"several results for {repeated[0][0]}")
    old = with_position(read_items(spark, resume_source(spark, input_path, output_path), schema)).drop("file")
    new = results.select(*[F.col(c).alias(f"_new_{c}") for c in results.columns], F.lit(True).alias("_has"))
    both = old.join(new, F.col(key) == F.col(f"_new_{key}"), "full")
    fresh = {c: F.when(F.col("_has"), F.col(f"_new_{c}")) for c in results.columns}
    kept = {c: F.when(F.col("_has"), fresh[c]).otherwise(F.col(c)) if c in fresh else F.col(c) for c in old.columns if c not in (key, "position")}
    added = {c: v for c, v in fresh.items() if c not in old.columns}
    rows = both.select(F.coalesce(key, f"_new_{key}").alias(key), *[v.alias(c) for c, v in {**kept, **added}.items()], F.col("position").alias("_at"))
    rows = rows.orderBy(F.col("_at").asc_nulls_last(), key)
    write_array(rows.drop("_at"), output_path)
    return read_items(spark, output_path, schema).count()


def list_files(spark: SparkSession, directory: str, names: Sequence[str] = ()) -> DataFrame:
    """Rows (path, file) of a directory's JSON files whose names hold any of names (all, without names)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(directory).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.where(F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.col("file").contains(n))) if names else files


def pending(inputs: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """What add mode still has to do."""
    return inputs.join(done.select(key), key, "left_anti")


def model_of(file: Column) -> Column:
    """The last part of a file's name at underscores, without the ending."""
    return F.element_at(F.split(F.regexp_replace(file, r"\.json$", ""), "_"), -1)


def is_distill(file: Column) -> Column:
    return file.contains("Distill")


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def array_text(df: DataFrame, limit: int = 100_000) -> str:
    """A small result as one pretty JSON array; larger ones belong to write_rows."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write them as lines")
    return json.dumps(rows, indent=4, ensure_ascii=False)


def metrics_documents(metrics: DataFrame, model_col: str = "model", task_col: str = "task") -> DataFrame:
    """One JSON document for each model: {model_name, task: {metric: value}}."""
    values = [c for c in metrics.columns if c not in (model_col, task_col)]
    per = metrics.select(model_col, task_col, F.to_json(F.struct(*values)).alias("v")).groupBy(model_col)
    doc = per.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(task_col, "v")))).alias("m"))
    return doc.select(F.col(model_col).alias("model_name"), F.to_json("m").alias("tasks"))


def latex_table(funnel: DataFrame, model_col: str, columns: Sequence[str]) -> str:
    """A funnel as a LaTeX table, a row a model by name; funnels are one row for each model."""
    clean = lambda x: str(x).replace("_", r"\_")
    rows = funnel.select(model_col, *columns).orderBy(model_col).collect()
    head = " & ".join(["Model", *map(clean, columns)]) + r" \\"
    body = [" & ".join(clean(r[c]) for c in [model_col, *columns]) + r" \\" for r in rows]
    return "\n".join([rf"\begin{{tabular}}{{l{'r' * len(columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", ""])
