"""Diagram annotations, question files and reply caches: JSON in, tables out, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key
from .shared import materialized

# Fixed values.
ENTITY_TYPES = ("Node", "Container")
PREDICATES = ("flows_to", "contains", "connects_to")
EMPTY_LABELS = ("", "none", "null", "n/a", "na", "-", "--")

ENTITY = "struct<id:string,text:string,type:string>"
RELATION = "struct<subject_id:string,predicate:string,object_id:string,edge_text:string,is_conflict:boolean,subject:string,object:string>"
ANNOTATION = f"image_id string, paper_id string, summary string, summary_annotation struct<functional_summary:string>, paper_info struct<paper_id:string>, entities array<{ENTITY}>, relations array<{RELATION}>, _corrupt_record string"
#: Questions in a file that is one JSON array.
ARRAY_ROWS = 20_000
OPTION = "struct<label:string,text:string>"
QUESTION = (
    "image_id string, paper_id string, level string, question_type string, question string, answer_type string, answer string, answer_text string, "
    f"options array<{OPTION}>, correct_option_indices array<int>, metadata string"
)


@dataclass
class Graphs:
    """All graphs of a corpus: graphs(image_id, paper_id, summary_text), entities(image_id, ord, id, text, type,
    norm_text) and relations(image_id, ord, subject_id, predicate, object_id, edge_text, is_conflict)."""

    graphs: DataFrame
    entities: DataFrame
    relations: DataFrame


def scanned(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Annotations of a folder (one JSON document in a file, or in a line) with file and position, and the faults
    (file, position, reason, start of the text) beside them.

    The files are parsed once, into a table in the shared folder, which both read. A document is at fault if it is no
    JSON object, has fields of other types than annotations, or has no entities at all.
    """
    raw = spark.read.schema(ANNOTATION).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    text = F.trim("_corrupt_record")
    reason = F.when(F.col("_corrupt_record").isNotNull(), F.when(text == "", "empty").when(~text.startswith("{"), "no object").otherwise("no JSON, or fields of other types"))
    reason = F.coalesce(reason, F.when(F.col("entities").isNull() & F.col("image_id").isNull(), "no annotation"))
    rows = raw.option("pathGlobFilter", "*.json").json(path).withColumn("file", F.col("_metadata.file_path"))
    held = materialized(_in_order(spark, rows).withColumnRenamed("idx", "position").withColumn("reason", reason))
    good = held.filter(F.col("reason").isNull()).drop("reason")
    bad = held.filter(F.col("reason").isNotNull()).select("file", "position", "reason", F.substring("_corrupt_record", 1, 80).alias("start"))
    return good, bad


def scan(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The annotations of scanned() without the faults."""
    return scanned(spark, path, lines)[0]


def read_annotations(spark: SparkSession, path: str) -> Graphs:
    return normalize(scan(spark, path))


def _summary() -> Column:
    """A summary is an object with a text, or the text itself."""
    return F.trim(F.coalesce(F.get_json_object("summary", "$.text"), F.when(~F.coalesce("summary", F.lit("")).startswith("{"), F.col("summary")), F.lit("")))


def _id(pos: Column, x: Column) -> Column:
    trimmed = F.trim(F.coalesce(x, F.lit("")))
    return F.when(trimmed == "", F.concat(F.lit("e"), pos)).otherwise(trimmed)


def label(x: Column) -> Column:
    text = F.trim(F.coalesce(x, F.lit("")))
    return F.when(F.lower(text).isin(*EMPTY_LABELS), "").otherwise(text)


def normalize(raw: DataFrame) -> Graphs:
    """Entities keep repeated ids; relations of unknown predicates or ends, and self-loops, are dropped."""
    graphs = raw.select("image_id", "paper_id", _summary().alias("summary_text"))
    e = raw.select("image_id", F.posexplode("entities").alias("ord", "e"))
    entities = e.select(
        "image_id", "ord", _id(F.col("ord"), F.col("e.id")).alias("id"), F.trim(F.coalesce("e.text", F.lit(""))).alias("text"),
        F.when(F.col("e.type").isin(*ENTITY_TYPES), F.col("e.type")).otherwise("Node").alias("type"),
    )
    r = raw.select("image_id", F.posexplode("relations").alias("ord", "r"))
    relations = r.select(
        "image_id", "ord", F.trim(F.coalesce("r.subject_id", F.lit(""))).alias("subject_id"), F.trim(F.coalesce("r.predicate", F.lit("flows_to"))).alias("predicate"),
        F.trim(F.coalesce("r.object_id", F.lit(""))).alias("object_id"), label(F.col("r.edge_text")).alias("edge_text"), F.coalesce("r.is_conflict", F.lit(False)).alias("is_conflict"),
    )
    return clean_graphs(graphs, entities, relations)


def clean_graphs(graphs: DataFrame, entities: DataFrame, relations: DataFrame, linked: bool = False) -> Graphs:
    """linked: the ends of all relations are known to be entities."""
    entities = entities.withColumn("norm_text", norm_key(F.col("text")))
    kept = relations.filter(
        F.col("predicate").isin(*PREDICATES) & (F.col("subject_id") != F.col("object_id"))
    ).withColumn("edge_text", label(F.col("edge_text")))
    if not linked:
        ids = entities.select("image_id", "id").distinct()
        kept = kept.join(
            ids.withColumnRenamed("id", "subject_id"), ["image_id", "subject_id"], "left_semi",
        ).join(ids.withColumnRenamed("id", "object_id"), ["image_id", "object_id"], "left_semi")
    return Graphs(graphs, entities, kept.select("image_id", "ord", "subject_id", "predicate", "object_id", "edge_text", "is_conflict"))


def normalize_annotation_ui(raw: DataFrame) -> Graphs:
    """The editor's more lenient reading: old names are taken, ids are given anew after blank texts went, an
    unknown predicate flows, and all relations go if the ids were not e0, e1, ... already."""
    stem = F.regexp_extract("file", r"([^/]*)\.json$", 1)
    summary = F.coalesce(F.nullif(_summary(), F.lit("")), F.trim("summary_annotation.functional_summary"), F.lit(""))
    graphs = raw.select("image_id", F.coalesce("paper_id", "paper_info.paper_id", stem).alias("paper_id"), summary.alias("summary_text"))
    e = raw.select("image_id", F.posexplode("entities").alias("pos", "e")).withColumn("was", F.trim(F.coalesce("e.id", F.lit(""))))
    ids_fit = e.groupBy("image_id").agg(F.bool_and(F.col("was") == F.concat(F.lit("e"), F.col("pos"))).alias("fit"))
    e = e.withColumn("text", F.trim(F.coalesce("e.text", F.lit("")))).filter("text <> ''")
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("pos")) - 1
    kind = F.when(F.col("e.type") == "Container", "Container").otherwise("Node")
    entities = e.select("image_id", order.alias("ord"), F.concat(F.lit("e"), order).alias("id"), "text", kind.alias("type"))
    r = raw.select("image_id", F.posexplode("relations").alias("ord", "r")).join(ids_fit.filter("fit"), "image_id", "left_semi")
    relations = r.select(
        "image_id", "ord", F.coalesce("r.subject_id", "r.subject", F.lit("")).alias("subject_id"), F.when(
            F.col("r.predicate").isin(*PREDICATES), F.col("r.predicate"),
        ).otherwise("flows_to").alias("predicate"),
        F.coalesce("r.object_id", "r.object", F.lit("")).alias("object_id"), F.trim(F.coalesce("r.edge_text", F.lit(""))).alias("edge_text"), F.coalesce("r.is_conflict", F.lit(False)).alias("is_conflict"),
    )
    return Graphs(graphs, entities.withColumn("norm_text", norm_key(F.col("text"))), relations)


def _in_order(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows with idx, their number from 0 on in order of file and place in it. Parts of files are counted first, so
    every part is numbered by itself."""
    place = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    sizes = place.groupBy("_file", "_block").agg(F.count("*").alias("_n"))  # a row for each part of a file
    before = sizes.select("_file", "_block", (F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_line"))
    numbered = place.join(F.broadcast(before), ["_file", "_block"]).withColumn("idx", (F.col("_before") + own - 1).cast("long"))
    return numbered.drop("_file", "_block", "_line", "_before")


def read_questions(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Question files (a JSON array in each, or an object a line) with idx, their place in all files; answers that are
    lists come as JSON text. `limit` keeps the first ones."""
    rows = _in_order(spark, spark.read.schema(QUESTION).option("multiLine", not lines).json(path))
    return rows.filter(F.col("idx") < limit) if limit else rows


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (key, value) of a file, or of a folder and all below it, as journals and append_cache() write them:
    the last line of a key counts, by its time if it has one, then by file and place."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    at = F.coalesce(F.get_json_object("value", "$.at").cast("double"), F.lit(0.0))
    place = F.struct(at.alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return last_wins(lines.select(F.get_json_object("value", "$.key").alias("key"), "value", place.alias("ord")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, on whatever file system it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return found.exists(place)


def append_cache(replies: DataFrame, path: str) -> None:
    """Adds replies (key and other columns) to a cache folder, as JSON lines with their time."""
    at = F.unix_micros(F.current_timestamp()) / 1e6
    names = [c for c in replies.columns if c != "key"]
    replies.select(F.to_json(F.struct("key", *names, at.alias("at"))).alias("value")).write.mode("append").text(path)


def last_wins(rows: DataFrame) -> DataFrame:
    """key, value of the row with the largest ord of each key."""
    return rows.filter("key is not null").groupBy("key").agg(F.max_by("value", "ord").alias("value"))


def pending(work: DataFrame, cached: DataFrame) -> DataFrame:
    """Work whose key is not cached, or only with an error."""
    done = cached.filter(F.get_json_object("value", "$.error").isNull()).select("key")
    return work.join(done, "key", "left_anti")


#: Metadata that is no text but a truth value, a number or a list.
TYPED = (
    "used_disambiguation", "is_unanswerable", "path_unique", "successor_count", "child_count", "path_node_ids",
    "intermediate_node_ids", "intermediate_displays",
)


def json_string(x: Column) -> Column:
    """x as a JSON string, with characters beyond ASCII as they are."""
    return F.when(x.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))


def question_json(multi: Column) -> Column:
    """A question as JSON text: answers of one choice and open ones are strings, of several choices lists; indices are
    left out of open questions, and metadata where there is none."""
    one = lambda c: F.when(multi, F.to_json(F.col(c))).otherwise(json_string(F.get(F.col(c), F.lit(0))))
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    entry = lambda e: F.concat(json_string(e["key"]), F.lit(": "), F.when(e["key"].isin(*TYPED), e["value"]).otherwise(json_string(e["value"])))
    meta = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), entry), ", "), F.lit("}"))
    texts = [field(c, json_string(F.col(c).cast("string"))) for c in ("image_id", "paper_id", "level", "question_type", "question", "answer_type")]
    more = [field("answer", one("answer")), field("options", F.to_json("options")), field("answer_text", one("answer_text"))]
    more += [
        F.when(F.col("correct_option_indices").isNotNull(), field("correct_option_indices", F.to_json("correct_option_indices"))),
        F.when(F.size("metadata") > 0, field("metadata", meta)),
    ]
    return F.concat(F.lit("{"), F.concat_ws(", ", *texts, *more), F.lit("}"))


def write_dataset(questions: DataFrame, path: str) -> None:
    """Questions of the generators, one JSON object a line, a folder per split."""
    lines = questions.select("split", question_json(F.col("answer_type") == "multi_select").alias("value"))
    lines.write.mode("overwrite").partitionBy("split").text(path)


def write_questions(questions: DataFrame, path: str, jsonl: bool = True) -> None:
    """One folder per split: JSON lines, or files of JSON arrays, of about ARRAY_ROWS questions each."""
    if jsonl:
        questions.write.mode("overwrite").partitionBy("split").json(path)
        return
    parts = max(1, -(-questions.count() // ARRAY_ROWS))
    part = F.pmod(F.xxhash64("image_id", "question"), F.lit(parts))
    rows = questions.groupBy("split", part.alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*[c for c in questions.columns if c != "split"]))).alias("value")
    )
    rows.drop("part").write.mode("overwrite").partitionBy("split").text(path)


def write_annotations(g: Graphs, path: str) -> None:
    """Graphs as annotations, a JSON document a line: what scan(lines=True) reads."""
    e = g.entities.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "text", "type"))).alias("e"))
    r = g.relations.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "subject_id", "predicate", "object_id", "edge_text", "is_conflict"))).alias("r")
    )
    pick = lambda array, *names: F.coalesce(F.transform(array, lambda x: F.struct(*[x[n].alias(n) for n in names])), F.array())
    rows = g.graphs.join(e, "image_id", "left").join(r, "image_id", "left")
    rows = rows.select(
        "image_id", "paper_id", F.struct(F.col("summary_text").alias("text")).alias("summary"),
        pick("e", "id", "text", "type").alias("entities"),
        pick("r", "subject_id", "predicate", "object_id", "edge_text", "is_conflict").alias("relations"),
    )
    rows.write.mode("overwrite").json(path)


def write_manifest(statistics: DataFrame, config: dict, path: str) -> None:
    """One nested row: the configuration and the counts of every split."""
    rows = statistics.agg(F.collect_list(F.struct(*statistics.columns)).alias("statistics"))
    rows.select(F.create_map(*[F.lit(str(v)) for kv in config.items() for v in kv]).alias("config"), "statistics").write.mode("overwrite").json(path)


def _mime() -> Column:
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return F.when(kind.isin("jpg", "jpeg"), "image/jpeg").otherwise("image/png")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, image (base64) and mime of the image files in a folder, as they are; other kinds count as PNG."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,webp}").load(path).select(
        "path", F.base64("content").alias("image"), _mime().alias("mime"),
    )


def question_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id (the file's name), image (its bytes) and mime of the image files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,webp}").load(path)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("image_id"), F.col("content").alias("image"), _mime().alias("mime"))
