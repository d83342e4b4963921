"""Record sources and sinks: latest batch wins, tolerant replies, manifests, shards, nested output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import md5_int


def read_records(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """JSON lines (`json`), JSON arrays (`json_array`), CSV with a header (`csv`) or Parquet, under a declared schema."""
    reader = spark.read.schema(schema)
    if kind == "json_array":
        return reader.json(path, multiLine=True)
    return reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path)


def read_batches(spark: SparkSession, path: str, item: str, items: str = "items", packed: bool = False) -> DataFrame:
    """Rows of batch files below `path`, each a JSON object whose list `items` holds rows of schema `item`: batch_file, pos and the row's fields.

    A file that can't be read, or has no such list, gives one row with `bad` and null fields. File and position order the rows for `latest_wins`.
    `packed`: many small batch files are kept as rows (batch_file, text) of Parquet files, as `write_batches` keeps them, since a file, and for some a
    folder, for each makes the listing and opening of files the main cost.
    """
    schema = f"{items} array<struct<{item}>>, _corrupt string"
    if packed:
        files = spark.read.schema("batch_file string, text string").parquet(path)
        read = files.select("batch_file", F.from_json("text", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("_j")).select("batch_file", "_j.*")
    else:
        read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True, recursiveFileLookup=True).withColumn("batch_file", F.col("_metadata.file_path"))
    rows = read.select("batch_file", (F.col("_corrupt").isNotNull() | F.col(items).isNull()).alias("bad"), F.col(items).alias("_items"))
    return rows.select("batch_file", "bad", F.posexplode_outer(F.when(~F.col("bad"), F.col("_items"))).alias("pos", "_row")).select("batch_file", "bad", "pos", "_row.*")


def write_batches(df: DataFrame, path: str, name: Column, text: Column) -> None:
    """Small batch files, a row of `df` for each, as rows (batch_file, text) of Parquet files."""
    df.select(name.alias("batch_file"), text.alias("text")).write.parquet(path)


def batch_report(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row: batch files, those that can't be read, rows, distinct keys, and keys of `wanted` that no readable file has."""
    good = rows.where("NOT bad AND pos IS NOT NULL")
    missing = wanted.select(key).distinct().join(good.select(key).distinct().hint("merge"), key, "left_anti").agg(F.count("*").alias("n_missing"))
    files = rows.groupBy("batch_file").agg(F.max("bad").alias("bad")).agg(F.count("*").alias("n_files"), F.count(F.when(F.col("bad"), 1)).alias("n_bad"))
    held = good.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))
    return files.crossJoin(held).crossJoin(missing)  # a row each


def write_records(df: DataFrame, path: str, kind: str = "json", by: tuple[str, ...] = ()) -> None:
    """A partitioned directory of JSON lines, CSV or Parquet."""
    writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    writer.format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def long_enough(df: DataFrame, text: str = "text", min_chars: int = 80) -> DataFrame:
    """Rows whose stripped text has at least `min_chars` characters, with the stripped text."""
    return df.withColumn(text, F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")).where(F.length(text) >= min_chars)


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a total order: the whole row is compared inside an aggregate, so nothing is sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def reply_json(reply: Column, schema: str) -> Column:
    """The outermost {...} of a model's reply after its last reasoning mark, parsed; null fields where that fails."""
    body = F.regexp_replace(reply, r"(?s)^.*(</think>|assistantfinal)", "")
    return F.from_json(F.regexp_extract(body, r"(?s)\{.*\}", 0), schema)


def reply_variant(reply: Column) -> Column:
    """What a model's reply says, whatever its shape: the outermost {...} after its last reasoning mark, parsed, else the outermost [...], if it
    holds objects only; null if neither can be read. A list is given as `{"items": [...]}`."""
    body = F.regexp_replace(reply, r"(?s)^.*(</think>|assistantfinal)", "")

    def strict(text: Column) -> Column:
        # inside brackets, as the parser reads one value and passes over what follows it
        held = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
        return F.when(F.size(held) == 1, F.get(held, F.lit(0)))

    text = F.regexp_extract(body, r"(?s)\[.*\]", 0)
    objects = F.try_variant_get(strict(text), "$", "array<variant>")
    fit = (F.size(objects) > 0) & F.forall(objects, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return F.coalesce(strict(F.regexp_extract(body, r"(?s)\{.*\}", 0)), F.when(fit, F.try_parse_json(F.concat(F.lit('{"items": '), text, F.lit("}")))))


def typed(reply: Column, path: str, kind: str) -> Column:
    """The value at `path` of a reply if it has the very type (`int`, `boolean`, `string`): "3" is no number and 1 no truth value. Else null."""
    names = {"int": "BIGINT", "boolean": "BOOLEAN", "string": "STRING"}
    found = F.try_variant_get(reply, path, "variant")
    return F.when(F.schema_of_variant(found) == names[kind], F.try_variant_get(reply, path, "bigint" if kind == "int" else kind))


def parse_rate(df: DataFrame, ok: Column, by: list[str]) -> DataFrame:
    """Share of rows whose verdict satisfies its schema."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(ok.cast("int")).cast("long").alias("n_ok"), F.round(F.avg(ok.cast("double")), 6).alias("rate"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` rows, and the `old` rows of other keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_hit(hits: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """One row per key, its first hit in order, with the sorted list of the labels that found it."""
    return hits.groupBy(key).agg(F.min_by(label, F.struct(*order)).alias("first_query"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("queries"))


def todo(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units whose output is not there yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def shard(key: Column, n: int) -> Column:
    """Shard number by md5, the same wherever it is computed."""
    return md5_int(key) % n


def batches(df: DataFrame, group: str, order: list[str], size: int, item: Column) -> DataFrame:
    """Work batches of `size` rows inside each group: number, rows and the joined items."""
    numbered = df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    numbered = numbered.withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("int"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_rn", item.alias("item")))), lambda x: x["item"])
    return numbered.groupBy(group, "batch").agg(F.count("*").alias("n"), F.array_join(items, "|").alias("items"))


def fill_template(template: str, **fields: Column) -> Column:
    """`template` with {name} replaced by each field; other names stay as they are."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def row_digest(*cols: str) -> Column:
    """SHA-256 of a row's columns as text, joined by a unit separator; null as a record separator, which differs from the empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in cols]), 256)


def field_manifest(name: str, df: DataFrame) -> DataFrame:
    """(name, position, field, type) of a table's columns, as its metadata file lists them."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "name string, position int, field string, type string")


def file_manifest(spark: SparkSession, path: str, name: str, kind: str, schema: str) -> DataFrame:
    """(name, file, n_rows, n_bytes, sha256) of the data files of a written table: what a receiver checks them by."""
    files = file_digests(spark, path).where(F.col("path").rlike(r"/part-[^/]*$"))
    rows = read_records(spark, path, schema, kind).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    held = rows.select(bare(F.col("path")).alias("file"), "n_rows")
    return files.select(F.lit(name).alias("name"), bare(F.col("path")).alias("file"), "n_bytes", "sha256").join(held.hint("merge"), "file", "left").select("name", "file", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "n_bytes", "sha256")


def table_digest(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """(name, n_rows, digest): one digest of a table whatever the order of its rows.

    Row digests are sorted and digested in 4096 shards, and the shards' digests once more, so no task gathers the table.
    """
    rows = df.select(row_digest(*cols).alias("d")).withColumn("shard", F.substring("d", 1, 3))
    joined = lambda c: F.sha2(F.array_join(c, ""), 256).alias("d")
    shards = rows.groupBy("shard").agg(F.count("*").alias("n"), joined(F.array_sort(F.collect_list("d"))))
    whole = F.array_sort(F.collect_list(F.struct("shard", "d")))  # at most 4096
    return shards.groupBy(F.lit(name).alias("name")).agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(whole, lambda x: x["d"]), ""), 256).alias("digest"))


def manifest(files: DataFrame, source: str) -> DataFrame:
    """Per source: files that were cached, downloaded or failed (`status`), and the entry's status, ok without a failure, else partial."""
    n = lambda x: F.count(F.when(F.col("status") == x, 1)).alias(f"n_{x}")
    counts = files.groupBy(source).agg(n("cached"), n("downloaded"), n("failed"))
    return counts.withColumn("status", F.when(F.col("n_failed") == 0, "ok").otherwise("partial"))
