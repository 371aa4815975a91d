"""Readers and writers with fixed schemas; bad input fails instead of turning into nulls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import canonical_triplet, selection
from plumbline.operators.prefix import sums_before

SAMPLE = "text STRING"
ASSIGNMENT = "text_id BIGINT, cluster_label INT, domain STRING, is_noise BOOLEAN, distance_to_centroid DOUBLE, text STRING"
QA = (
    "triplet STRING, cluster_label INT, domain STRING, domain_triplet_index INT, source_train_index INT, "
    "text STRING, question STRING, answer STRING, qa_prompt STRING"
)
SCORES = "MAP<STRING, ARRAY<STRUCT<loss: DOUBLE, ppl: DOUBLE, n_tokens: INT>>>"
PAIRS = f"model_triplet STRING, eval_triplet STRING, model_dir STRING, base {SCORES}, unlearn {SCORES}"


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``; a row for which ``ok`` does not hold fails the job when it is read."""
    return df.filter(F.when(ok, True).otherwise(F.raise_error(message).cast("boolean")))


def read_jsonl(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """(source_row_id, text) of JSON lines; malformed lines and lines that are no objects fail."""
    return spark.read.schema(f"source_row_id BIGINT, `{field}` STRING").option("mode", "FAILFAST").json(path).select("source_row_id", F.coalesce(field, F.lit("")).alias("text"))


def read_json_array(spark: SparkSession, path: str, schema: str = SAMPLE) -> DataFrame:
    """Rows of files that hold one JSON array each, with ``file`` and position in it; texts must be present."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"ARRAY<STRUCT<{schema}>>", {"mode": "FAILFAST"}).alias("rows"))
    rows = whole.select("file", F.posexplode("rows").alias("sample_idx", "r")).select("file", "sample_idx", "r.*")
    return require(rows, F.col("text").isNotNull(), "a row has no text")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    return require(read_json_array(spark, path, QA), F.col("question").isNotNull() & F.col("answer").isNotNull(), "a row lacks a required field")


def read_triplets(spark: SparkSession, root: str) -> DataFrame:
    """(triplet, split, sample_idx, text) of ``root/triplet_*/{train,validation,val,test}.json``.

    ``validation.json`` goes before ``val.json``; other files are ignored.
    """
    rows = read_json_array(spark, f"{root}/triplet_*/{{train,validation,val,test}}.json")
    name = F.regexp_extract("file", r"([^/]+)/[^/]+\.json$", 1)
    split = F.regexp_extract("file", r"/([^/]+)\.json$", 1)
    rows = rows.select(canonical_triplet(name).alias("triplet"), split.alias("found"), F.when(split == "val", "validation").otherwise(split).alias("split"), "sample_idx", "text")
    best = F.max("found").over(Window.partitionBy("triplet", "split"))  # "validation" > "val"
    return rows.withColumn("best", best).filter("found = best").drop("found", "best")


def select_triplets(df: DataFrame, names: str | None = None, first: int = 0, last: int = 9999) -> DataFrame:
    """The triplets of a list or of a range of numbers (both ends included)."""
    if names:
        chosen = df.sparkSession.range(1).select(F.explode(selection(F.lit(names))).alias("n")).select(canonical_triplet(F.col("n")).alias("triplet")).distinct()
        return df.join(F.broadcast(chosen), "triplet", "left_semi")
    return df.filter(F.regexp_extract("triplet", r"(\d+)$", 1).cast("int").between(first, last))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(ASSIGNMENT).option("mode", "FAILFAST").csv(path, header=True, enforceSchema=False, multiLine=True, escape='"')
    default = F.when(F.col("cluster_label") == -1, "noise").otherwise(F.concat(F.lit("cluster_"), F.col("cluster_label").cast("string")))
    return rows.withColumn("domain", F.coalesce(F.nullif(F.trim("domain"), F.lit("")), default))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Nested metric pairs; the old split names forget and retain become train and validation."""
    raw = spark.read.schema(PAIRS).option("mode", "FAILFAST").json(path)
    new = lambda c: F.transform_keys(c, lambda k, _: F.when(k == "forget", "train").when(k == "retain", "validation").otherwise(k))
    return raw.withColumns({c: new(c) for c in ("base", "unlearn")})


def read_source(spark: SparkSession, kind: str, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Registry of readers by name, with columns renamed."""
    readers = {"json": lambda: read_jsonl(spark, path), "json_array": lambda: read_json_array(spark, path), "text": lambda: spark.read.text(path).withColumnRenamed("value", "text"), "parquet": lambda: spark.read.parquet(path), "csv": lambda: spark.read.csv(path, header=True)}
    return readers[kind]().withColumnsRenamed(rename or {})


def add_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """``df`` numbered from 0 in the given order; runs a job at once, as ``sums_before`` does."""
    return sums_before(df, list(order), **{name: F.lit(1)})


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_triplets(df: DataFrame, path: str) -> None:
    """One JSON array per triplet and split, as one-line text files below ``triplet=/split=`` folders."""
    arrays = df.groupBy("triplet", "split").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("sample_idx", "text"))), lambda r: F.struct(r["text"].alias("text")))).alias("value"))
    arrays.write.mode("overwrite").partitionBy("triplet", "split").text(path)


def assignment_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CSV form (distance as %.6f or empty) and JSON form (number or null) of the same rows."""
    d = F.col("distance_to_centroid")
    return df.withColumn("distance_to_centroid", F.when(d.isNull(), "").otherwise(F.format_string("%.6f", d))), df


def write_assignments(df: DataFrame, csv_path: str, json_path: str) -> None:
    as_csv, as_json = assignment_rows(df)
    as_csv.write.mode("overwrite").csv(csv_path, header=True, escape='"')
    write_jsonl(as_json, json_path)


def summary_rows(df: DataFrame) -> DataFrame:
    """Cluster summary for CSV: ratio as %.8f, keywords joined by a bar."""
    return df.withColumn("ratio", F.format_string("%.8f", "ratio")).withColumn("keywords", F.array_join("keywords", "|"))


def write_long(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("model_triplet").parquet(path)


def manifest(spark: SparkSession, upstream: dict[str, str], **new: str) -> DataFrame:
    """One row (key, value) map: upstream's entries, ``created`` kept if set, ``updated`` now, and the new entries over all."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    literal = lambda d: F.map_from_arrays(F.array(*map(F.lit, d)), F.array(*map(F.lit, d.values()))) if d else F.expr("cast(map() as map<string,string>)")
    created = F.map_from_arrays(F.array(F.lit("created")), F.array(now))
    keep = F.when(F.map_contains_key(literal(upstream), "created"), literal(upstream)).otherwise(F.map_concat(literal(upstream), created))
    over = F.map_concat(literal(new), F.map_from_arrays(F.array(F.lit("updated")), F.array(now)))
    return spark.range(1).select(F.map_concat(F.map_filter(keep, lambda k, _: ~F.map_contains_key(over, k)), over).alias("manifest"))


def merge_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, body): new sections replace old ones of their name, all others stay."""
    return old.alias("o").join(new.alias("n"), "section", "full").select("section", F.coalesce("n.body", "o.body").alias("body"))


def resumable(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What is still to do."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes and files below a path, and when it was changed."""
    fs, p = _fs(spark, path)
    s = fs.getContentSummary(p)
    return s.getLength(), s.getFileCount(), fs.getFileStatus(p).getModificationTime()


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_object(df: DataFrame, path: str) -> None:
    """A one-row table as an indented JSON object; characters beyond ASCII stay as they are."""
    body = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    df.coalesce(1).select(body.alias("value")).write.mode("overwrite").text(path)


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_shards(spark: SparkSession, path: str, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file, name, dtype, shape, data) of the tensors in safetensors files whose name fulfils ``name``.

    A file is an eight-byte length, so many bytes of JSON (name to type, shape and place), and the tensors' bytes.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    little = F.concat(*(F.substring(F.col("content"), i, 1) for i in range(8, 0, -1)))
    size = F.conv(F.hex(little), 16, 10).cast("int")
    head = F.from_json(F.decode(F.expr("substring(content, 9, n)"), "UTF-8"), "map<string, struct<dtype: string, shape: array<bigint>, data_offsets: array<bigint>>>")
    tensors = files.withColumn("n", size).select("file", "content", "n", F.explode(head).alias("name", "t")).filter("name != '__metadata__'")
    kept = tensors.filter(name(F.col("name"))) if name else tensors
    data = F.expr("substring(content, int(9 + n + t.data_offsets[0]), int(t.data_offsets[1] - t.data_offsets[0]))")
    return kept.select("file", "name", "t.dtype", "t.shape", data.alias("data"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def invalidate(spark: SparkSession, root: str, stages: list[str], again: str) -> list[str]:
    """Remove the outputs of all stages after ``again``; returns their names."""
    gone = []
    for name in stages[stages.index(again) + 1 :]:
        fs, p = _fs(spark, f"{root}/{name}")
        if fs.exists(p):
            fs.delete(p, True)
            gone.append(name)
    return gone
