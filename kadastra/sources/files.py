"""Readers and writers of the formats that collections come in, all through Spark's own sources but for folders of one file a row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow.fs as arrow_fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trimmed from both ends of a text.
BLANKS = " \t\r\n"


def read_survey(spark: SparkSession, path: str, schema: T.StructType, *, encoding: str = "UTF-8", exclude: Column | None = None, sep: str = ",") -> DataFrame:
    """Respondents from CSV with a header; unnamed columns go, and rows that the predicate on the id excludes."""
    df = spark.read.option("header", True).option("encoding", encoding).option("sep", sep).option("multiLine", True).schema(schema).csv(path)
    df = df.select(*(c for c in df.columns if not c.startswith("Unnamed")))
    return df if exclude is None else df.where(~exclude)


def read_folder(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(name, text, source): one row per file, named by its file name; empty files are skipped."""
    file = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # it comes as part of a URI, where a plus is itself
    df = spark.read.text(path, wholetext=True).select(F.regexp_replace(file, r"\.[^.]*$", "").alias("name"), F.col("value").alias("text"))
    return df.where(F.trim("text", F.lit(BLANKS)) != "").withColumn("source", F.lit(source))


def interview_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Columns commune and num of names like entretien_<commune>_<num>; the commune may hold underscores."""
    pattern = r"^entretien_(.+)_(\d+)$"
    return df.withColumns({"commune": F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), "num": F.regexp_extract(name, pattern, 2).try_cast("int")})


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(name, summary, description) of files of blocks parted by --- lines, each with a ### heading."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^---\s*$")).alias("b"))
    part = lambda p: F.nullif(F.trim(F.regexp_extract("b", p, 1), F.lit(BLANKS)), F.lit(""))
    return blocks.select(part(r"(?m)^###\s*(.+)$").alias("name"), part(r"(?s)Résumé\s*:\s*(.*?)(?=\n\s*Description\s*:|\z)").alias("summary"), part(r"(?s)Description\s*:\s*(.*)").alias("description")).where("name is not null")


def keyed_lines(spark: SparkSession, path: str, pattern: str = r"La commune de (.+?)(?= (?:a|est|compte|possède)\b|[.,]|$)") -> DataFrame:
    """(key, text) of lines; the pattern's first group is the key and may hold several words."""
    return spark.read.text(path).select(F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias("key"), F.col("value").alias("text")).where("key is not null")


def interviews(df: DataFrame, text: str = "text") -> DataFrame:
    """(commune, num, block_no, body) of transcripts of `### Commune : X | Entretien N` blocks."""
    b = df.select(F.posexplode(F.split(text, r"(?m)(?=^### Commune\s*:)")).alias("block_no", "b"))
    head = r"(?m)^### Commune\s*:\s*(.+?)\s*\|\s*Entretien\s*(\d+)\s*$"
    return b.select(F.regexp_extract("b", head, 1).alias("commune"), F.regexp_extract("b", head, 2).try_cast("int").alias("num"), "block_no", F.trim(F.regexp_replace("b", head, ""), F.lit(BLANKS)).alias("body")).where("commune <> ''")


def interview_turns(blocks: DataFrame) -> DataFrame:
    """(commune, num, turn, role, text) of blocks' Q: and R: lines."""
    t = blocks.select("commune", "num", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?ms)^([QR]\s*:.*?)(?=^[QR]\s*:|\z)"), F.lit(1))).alias("turn", "t"))
    return t.select("commune", "num", "turn", F.substring("t", 1, 1).alias("role"), F.trim(F.regexp_replace("t", r"^[QR]\s*:", ""), F.lit(BLANKS)).alias("text"))


def read_features(spark: SparkSession, path: str, properties: Sequence[str], *, multi_line: bool = True) -> DataFrame:
    """(properties, rings) of GeoJSON polygons: a collection for each file, or one for each line."""
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", props), T.StructField("geometry", geometry)])))])
    f = spark.read.schema(schema).json(path, multiLine=multi_line).select(F.explode("features").alias("f"))
    rings = F.transform("f.geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select(*(F.col(f"f.properties.{p}").alias(p) for p in properties), rings.alias("rings"))


def triples(lines: DataFrame, prefixes: DataFrame, line: str = "value") -> DataFrame:
    """(s, p, o, lang) of N-Triples lines, known namespaces shortened by the table (namespace, prefix)."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+))?(?:\^\^<[^>]*>)?|(_:\S+))\s*\.'
    g = lambda k: F.regexp_extract(line, pattern, k)
    t = lines.where(F.col(line).rlike(pattern)).select(F.regexp_replace(g(1), "[<>]", "").alias("s"), g(2).alias("p"), F.when(g(3) != "", g(3)).when(g(6) != "", g(6)).otherwise(g(4)).alias("o"), F.nullif(g(5), F.lit("")).alias("lang"))
    space = lambda c: F.regexp_extract(c, r"^(.*[/#])[^/#]*$", 1)
    for c in ("s", "p", "o"):
        side = F.broadcast(prefixes.select(F.col("namespace").alias("_n"), F.col("prefix").alias("_p")))  # a list of namespaces
        t = t.join(side, space(F.col(c)) == F.col("_n"), "left").withColumn(c, F.when(F.col("_p").isNotNull(), F.concat("_p", F.lit(":"), F.substring(F.col(c), F.char_length("_n") + 1, F.char_length(c)))).otherwise(F.col(c))).drop("_n", "_p")
    return t


def flags(df: DataFrame, columns: Sequence[str], question: str = "question") -> DataFrame:
    """Question tables: X marks as booleans, rows without a question left out."""
    return df.where(F.trim(F.coalesce(question, F.lit(""))) != "").withColumns({c: F.coalesce(F.upper(F.trim(c)) == "X", F.lit(False)) for c in columns})


def read_results(spark: SparkSession, path: str, entry: T.StructType, *, by_line: bool = False) -> DataFrame:
    """(config, entry fields) of run files, or lines, that map configurations to lists of entries."""
    text = spark.read.text(path, wholetext=not by_line)
    m = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(entry)))).alias("config", "rows"))
    return m.select("config", F.explode("rows").alias("r")).select("config", "r.*")


def scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Score columns as numbers; rows with any that is missing or no number are left out."""
    return df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), ",", ".").try_cast("double") for c in columns}).dropna(how="any", subset=list(columns))


def group_texts(df: DataFrame, key: str, text: str, order: str, sep: str = "\n") -> DataFrame:
    """(key, n, text): a group's texts joined in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(key).agg(F.count("*").alias("n"), F.array_join(parts, sep).alias("text"))


def blocks_of(df: DataFrame, order: str, n: int) -> DataFrame:
    """Column block: which run of n rows a row of a table with dense numbers belongs to."""
    return df.withColumn("block", F.floor(F.col(order) / n).cast("long"))


def row_text(columns: Sequence[str], sep: str = "\n") -> Column:
    """`col: value` of all columns that aren't null."""
    return F.concat_ws(sep, *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))


def write_texts(df: DataFrame, path: str, key: str = "commune", text: str = "text", mode: str = "overwrite") -> None:
    """One folder of text for each key."""
    df.select(key, text).repartition(key).write.partitionBy(key).mode(mode).text(path)


def write_files(df: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One file `<name>.txt` in the folder for each row whose name and text aren't null; names are URL-encoded, so a name may hold any character.

    Tasks write through Arrow's file systems, whose URIs are those of Spark's paths. Spark's own writer makes a folder for each
    name, and on a local disk without Hadoop's native library starts a process for the mode of every folder and file. A task that is run again writes the same files.
    """
    arrow_fs.FileSystem.from_uri(path)[0].create_dir(arrow_fs.FileSystem.from_uri(path)[1])

    def write(rows: Iterator[Row]) -> None:
        store, root = arrow_fs.FileSystem.from_uri(path)
        for file, value in rows:
            with store.open_output_stream(f"{root}/{file}.txt") as out:
                out.write(value.encode())

    rows = df.where(F.col(name).isNotNull() & F.col(text).isNotNull()).select(F.url_encode(name).alias("_file"), F.col(text).alias("_value"))
    rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "_file").foreachPartition(write)


def export(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """CSV with a header, or JSON lines."""
    (df.write.mode(mode).option("header", True).csv if kind == "csv" else df.write.mode(mode).json)(path)


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line): rows of a Markdown table, bars in values escaped."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in columns)), F.lit(" |")).alias("line"))
