"""Documents cut at their headings into chunks of a bounded size, in a batch or as a stream into a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.retrieval import page_text
from lodestone.sources.scratch import list_done

#: Characters that count as a token; the deepest heading that starts a section; tokens of a chunk, wanted and at least.
CHARS, DEEPEST, TARGET, LEAST = 4, 2, 4_000, 500


def marked_headings(html: Column) -> Column:
    """Text of a page's HTML, its headings as lines of # marks, its paragraphs and list items as paragraphs."""
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{level}\b[^>]*>\s*(.*?)\s*</h{level}>", "\u0002" + "#" * level + " $1\u0002")
    lines = F.split(F.regexp_replace(text, r"(?i)<(?:p|br|li|div|tr)\b[^>]*>|</(?:p|li|div|tr)>", "\u0003"), "[\u0002]")
    paragraphs = F.transform(lines, lambda x: F.array_join(F.filter(F.transform(F.split(x, "\u0003"), page_text), lambda p: p != ""), "\n\n"))
    return F.array_join(F.filter(paragraphs, lambda x: x != ""), "\n")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _headed(docs: DataFrame, deepest: int) -> DataFrame:
    """Sections of the texts that have headings: ``section``, ``heading``, ``level``, ``content`` and ``path``, the headings above."""
    line, level = F.col("line"), F.length(F.regexp_extract("line", "^(#+) ", 1))
    own = docs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("level", F.when(level.between(1, deepest), level).otherwise(0))
    # a section is a heading and the lines up to the next; what comes before the first is section 0
    along = Window.partitionBy("id").orderBy("pos")
    numbered = own.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(along))
    is_head = F.col("level") > 0
    lines = F.array_sort(F.collect_list(F.when(~is_head, F.struct("pos", "line"))))
    sections = numbered.groupBy("id", "section").agg(F.max(F.when(is_head, F.regexp_replace(line, "^[# ]+", ""))).alias("heading"), F.max("level").alias("level"), trimmed(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("content"))
    # the headings above: of each higher level the last one, unless one of a higher level came after it
    order, above = Window.partitionBy("id").orderBy("section"), []
    for j in range(1, deepest):
        last = F.last(F.when(F.col("level") == j, F.struct("section", "heading")), True).over(order)
        reset = F.max(F.when((F.col("level") > 0) & (F.col("level") < j), F.col("section"))).over(order)
        above.append(F.when((F.col("level") > j) & (last["section"] > F.coalesce(reset, F.lit(-1))), last["heading"]))
    path = F.array_compact(F.array(*above)) if above else F.array().cast("array<string>")
    return sections.filter((F.col("level") > 0) | (F.col("content") != "")).select("id", "section", F.coalesce("heading", F.lit("")).alias("heading"), "level", "content", path.alias("path"))


def _plain(docs: DataFrame) -> DataFrame:
    """Sections of the texts without headings: their paragraphs, named by their first sentence or words."""
    parts = F.filter(F.transform(F.split("text", r"\r?\n\s*\r?\n"), trimmed), lambda p: p != "")
    own = docs.select("id", F.posexplode(parts).alias("section", "content"))
    end = F.length(F.regexp_extract("content", r"^[^.!?]+[.!?]", 0))
    at = F.length(F.regexp_extract(F.substring("content", 1, 81), r"(?s)^(.*) ", 1))
    name = F.when(end.between(2, 100), F.substring(F.col("content"), F.lit(1), end)).when(F.length("content") < 100, F.col("content")).otherwise(F.concat(F.substring(F.col("content"), F.lit(1), F.when(at < 20, 80).otherwise(at)), F.lit("...")))
    return own.select("id", "section", name.alias("heading"), F.lit(1).alias("level"), "content", F.array().cast("array<string>").alias("path"))


def chunk_sections(docs: DataFrame, id_col: str, text_col: str, deepest: int = DEEPEST, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """Chunks of texts: sections, joined as long as a chunk has under ``least`` tokens or stays within ``target``.

    A section begins at a heading of up to ``deepest`` # marks; a text without any is cut
    into paragraphs. Returns the id, ``chunk`` from 0, ``heading`` and ``level`` of its
    first section, ``path`` (the headings above it), ``text`` and ``content_hash``. Blank
    texts and nulls have no chunks; texts are told apart by their ids, and repeated rows
    of one id and text count once.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0).dropDuplicates()
    has = F.exists(F.split("text", "\n"), lambda x: F.length(F.regexp_extract(x, "^(#+) ", 1)).between(1, deepest))
    split = own.withColumn("headed", has)
    sections = _headed(split.filter("headed"), deepest).unionByName(_plain(split.filter("not headed")))
    whole = F.when(F.col("heading") == "", F.col("content")).otherwise(F.concat(F.lit("## "), "heading", F.lit("\n\n"), "content"))
    sized = sections.select("*", F.floor(F.length("content") / CHARS).alias("tokens"), F.floor(F.length(whole) / CHARS).alias("full"), whole.alias("whole"))
    # a fold over the sizes of a text's sections says where chunks begin
    sizes = sized.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("section", "tokens", "full"))).alias("all"))
    first = F.struct(F.lit(-1).cast("long").alias("tokens"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, x: Column) -> Column:
        begins = (s["tokens"] < 0) | ((s["tokens"] + x["full"] > target) & (s["tokens"] >= least))
        return F.struct(F.when(begins, x["tokens"]).otherwise(s["tokens"] + x["full"]).alias("tokens"), F.when(begins, F.array_append(s["starts"], x["section"].cast("int"))).otherwise(s["starts"]).alias("starts"))

    starts = sizes.select("id", F.aggregate("all", first, step, lambda s: s["starts"]).alias("starts"))
    placed = sized.join(starts, "id").withColumn("start", F.array_max(F.filter("starts", lambda s: s <= F.col("section"))))
    part = F.struct("section", F.when(F.col("section") == F.col("start"), F.col("content")).otherwise(F.col("whole")).alias("text"))
    head = lambda c: F.min(F.struct("section", c))[c].alias(c)
    text = trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n\n"))
    made = placed.groupBy("id", "start").agg(head("heading"), head("level"), head("path"), text.alias("text")).filter("text <> ''")
    number = (F.row_number().over(Window.partitionBy("id").orderBy("start")) - 1).alias("chunk")
    return made.select(F.col("id").alias(id_col), number, "heading", "level", "path", "text", F.sha2("text", 256).alias("content_hash"))


class ChunkStore:
    """Chunks of a stream of documents, each content once: a trigger's new chunks lie in a folder of its own, which a repeated trigger overwrites."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self, but: int | None = None) -> DataFrame:
        """All chunks; but those of one trigger."""
        names = [n for n in list_done(self.spark, self.path) if n != f"batch={but}"]
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], self.schema)

    def add(self, made: DataFrame, batch: int) -> None:
        """Add the chunks whose content isn't there yet; of equal ones the first by id and place."""
        first = made.withColumn("__k", F.row_number().over(Window.partitionBy("content_hash").orderBy(*made.columns[:2]))).filter("__k = 1").drop("__k")
        first.join(self.read(batch).select("content_hash"), "content_hash", "left_anti").select(made.columns).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def chunk_stream(docs: DataFrame, path: str, id_col: str, text_col: str, **sizes: int) -> ChunkStore:
    """Chunk a stream of documents into the store below ``path`` until its input is used up; called again, it goes on from there."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    store = ChunkStore(spark, f"{path}/chunks", f"{id_col} {kind}, chunk int, heading string, level int, path array<string>, text string, content_hash string")
    add = lambda rows, batch: store.add(chunk_sections(rows, id_col, text_col, **sizes), batch)
    docs.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return store
