"""Corpora: JSON lines, folders of text files, tables, and a synthetic one; all as (doc_id, title, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stopwords as _stopwords

FIELDS = "id string, title string, text string"
EXTENSIONS = (".txt", ".md", ".text")


def titled(raw: DataFrame) -> DataFrame:
    """(.., title, text) of raw (.., id, title, text): an empty title is the id, text is indexed after the title, documents without text go."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("id"), F.lit(""))
    return raw.filter(F.coalesce("text", F.lit("")) != "").withColumn("text", F.concat_ws(" ", title, "text")).withColumn("title", title).drop("id")


def json_field(line: Column, field: str) -> Column:
    """A field as a text scan finds it: the first "field", the next colon, blanks, then a string or raw text up to , or }.

    \\n, \\t, \\\\ and \\" are undone and any other \\x is x; an open string ends with the line; a missing field is empty.
    """
    head = f'"{field}"[^:]*: *'
    quoted = F.regexp_extract(line, head + r'"([^"\\]*+(?:\\[\s\S][^"\\]*+)*+\\?)', 1)
    plain = F.regexp_extract(line, head + r'([^",}][^,}]*)', 1)
    text = F.replace(quoted, F.lit("\\\\"), F.lit("\u0001"))
    for code, char in (("\\n", "\n"), ("\\t", "\t")):
        text = F.replace(text, F.lit(code), F.lit(char))
    text = F.replace(F.regexp_replace(text, r"(?s)\\(.)", "$1"), F.lit("\u0001"), F.lit("\\"))
    return F.when(line.rlike(head + '"'), text).otherwise(plain)


def read_jsonl(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """(doc_id, title, text) of JSON lines with string fields id, title, text; ids are dense, in file and line order.

    The strict reader leaves out malformed lines. compat reads fields by `json_field`, which salvages them, takes null
    as the word, and does not know \\u escapes.
    """
    at = ["_file", "_start"]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    if compat:
        lines = spark.read.text(path).select("value", *place).filter("value <> ''")
        raw = lines.select(*(json_field(F.col("value"), f).alias(f) for f in ("id", "title", "text")), *at)
    else:
        raw = spark.read.schema(FIELDS).json(path).select("id", "title", "text", *place)
    return _in_file_order(titled(raw)).select("doc_id", "title", "text")


def _in_file_order(rows: DataFrame) -> DataFrame:
    """rows (.., _file, _start) of a scan with dense ids `doc_id` in the order of files and lines; no text is moved or kept.

    The running id that a scan gives its rows has no gaps within a block of a file; so a count per block, and the first
    running id in it, make a row's place known. The files are read twice, in the same blocks.
    """
    placed = rows.withColumn("_line", F.monotonically_increasing_id())
    blocks = placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    found, before = [], 0
    for r in sorted(blocks.collect()):  # a row per block of a file: what the driver has planned anyway
        found.append((r["_file"], r["_start"], before - r["_first"]))
        before += r["_n"]
    offsets = rows.sparkSession.createDataFrame(found, "_f string, _s long, _offset long")
    same = (placed["_file"] == offsets["_f"]) & (placed["_start"] == offsets["_s"])
    return placed.join(F.broadcast(offsets), same).withColumn("doc_id", F.col("_line") + F.col("_offset"))


def _files(scan: DataFrame) -> list[str]:
    """The paths of all files of a scan, empty ones too, from its own listing: the driver gets them as one string.

    Asking file by file costs a call each, and Hadoop's listing of a local folder may start a process for each file.
    """
    jvm = scan.sparkSession.sparkContext._jvm
    listed = scan._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().allFiles()
    files = scan.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.FileStatus, listed.size())
    listed.copyToArray(files)
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(files)
    joined = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(paths).mkString("\0")
    return joined.split("\0") if joined else []


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) of the .txt, .md and .text files below path, by path; the title is the file's name and is not indexed.

    Empty files count. Spark's readers leave them out, so they come from its listing. Files whose names begin
    with _ or . are those of writers at work, as for all of Spark's readers, and are left out.
    """
    # this reader makes no Hadoop task and no settings of its own for each file, as the whole-text one does
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = sorted((p, name) for p in _files(texts) if (name := p.rsplit("/", 1)[-1]).endswith(EXTENSIONS))
    listed = spark.createDataFrame([(i, *x) for i, x in enumerate(sorted(found))], "doc_id long, path string, title string")
    if not found:
        return listed.select("doc_id", "title", F.lit("").alias("text"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    texts = texts.select(plain(F.col("path")).alias("_path"), F.col("content").cast("string").alias("text"))
    return listed.withColumn("_path", plain(F.col("path"))).join(texts, "_path", "left").select("doc_id", "title", F.coalesce("text", F.lit("")).alias("text"))


def spread(df: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """A small table over all cores: one row group is one task's. Tables of more than that many bytes a core stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * task_bytes else df


def write_directory(docs: DataFrame, path: str) -> int:
    """Writes each row of docs (title, text) as the file `title` in the folder path, by tasks; how many there are."""
    from pyarrow import fs

    def put(batches):
        import pyarrow as pa

        store, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for title, text in zip(batch.column("title").to_pylist(), batch.column("text").to_pylist(), strict=True):
                with store.open_output_stream(f"{folder}/{title}") as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return docs.select("title", "text").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def from_table(df: DataFrame, id_column: str, text_column: str, title_column: str | None = None) -> DataFrame:
    """(doc_id, title, text) of a table with a unique integer key; without a title column the key is the title."""
    key = df[id_column].cast("long")
    title = df[title_column].cast("string") if title_column else F.lit(None).cast("string")
    return titled(df.select(key.alias("doc_id"), key.cast("string").alias("id"), title.alias("title"), df[text_column].alias("text")))


def read_stopwords(spark: SparkSession, path: str) -> frozenset[str]:
    """Words of a stopword file; none if there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return frozenset()
    return _stopwords.parse("\n".join(r[0] for r in spark.read.text(path).collect()))


_TOPICS = {
    "storage": "page block extent journal replica quorum segment checksum snapshot manifest".split(),
    "networks": "packet router latency congestion handshake gateway subnet multicast beacon relay".split(),
    "learning": "gradient embedding kernel regression sampler classifier tensor attention prior loss".split(),
    "systems": "scheduler interrupt cache mutex allocator thread pipeline register driver firmware".split(),
}
_FRAMES = ("The {0} of a {1} decides how its {2} behaves.", "A {0} without {1} is a {2} in name only.", "Measured over {0}, each {1} gains from {2}.", "Engineers compare {0} with {1} before they trust {2}.")


def synthetic(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(id, title, text) of n made-up documents on a few topics, the same for the same seed."""
    pick = lambda salt, of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    topic = pick("topic", list(_TOPICS))
    word = lambda salt: F.coalesce(*(F.when(topic == t, pick(salt, ws)) for t, ws in _TOPICS.items()))
    lines = []
    for k in range(4):
        frame = pick(f"frame{k}", _FRAMES)
        for j in range(3):
            frame = F.replace(frame, F.lit("{%d}" % j), word(f"word{k}{j}"))
        lines.append(F.when(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(f"use{k}")), F.lit(4)) >= k, frame))
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.concat_ws(" ", word("t1"), word("t2")).alias("title"), F.concat_ws(" ", *lines).alias("text"))
