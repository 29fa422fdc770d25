"""Files: JSON lines strict and tolerant, JSON arrays, query and id lists, text per document, shards, caches; and writers that can be resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A file that is one JSON list; of equal keys the last stays (the order inside a file is kept by Spark's reader)."""
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("_at", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c not in (key, "_at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("_r")).select(key, "_r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict: a line that does not read fails the query."""
    return spark.read.schema(schema).json(path, mode="FAILFAST", lineSep="\n")


def json_lines_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that do not read (a torn last line) are left out; blank lines too."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    rows = spark.read.schema(full).json(path, mode="PERMISSIVE", lineSep="\n")
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """One query a line; blank lines and lines that begin with # are left out."""
    return spark.read.text(path).select(F.trim("value").alias("query")).filter("query <> '' AND query NOT LIKE '#%'")


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select(F.col(ids.columns[0]).cast("string").alias("value")).distinct().sort("value").write.mode("overwrite").text(path)


def documents_with_text(documents: DataFrame, folder: str) -> DataFrame:
    """documents (slug) with the text of folder/slug.txt; documents without a file are left out."""
    texts = documents.sparkSession.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("slug"), F.col("value").alias("text"))
    return documents.join(texts, "slug")


def extract(spark: SparkSession, folder: str, parsers: dict) -> DataFrame:
    """path, text, n_words for files of a folder by suffix; parsers: suffix -> (bytes -> text). Unknown suffixes and failures give ''."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path, body in zip(pdf["path"], pdf["content"], strict=True):
                parse = parsers.get(path[path.rfind(".") :].lower())
                try:
                    out.append(parse(body) if parse else "")
                except ValueError:
                    out.append("")
            yield pd.DataFrame({"path": pdf["path"], "text": out})

    from ..functions.text import word_count
    from ..functions.web import page_text

    files = spark.read.format("binaryFile").load(folder).filter("length > 500").select("path", "content")
    return files.mapInPandas(run, "path string, text string").select("path", page_text(F.col("text")).alias("text"), word_count(F.col("text")).alias("n_words"))


def plain_text(body: bytes) -> str:
    return body.decode("utf-8", "replace")


def legacy_doc(body: bytes) -> str:
    """Printable runs of an old binary document; ``functions.web.legacy_text`` cleans them."""
    return body.decode("latin-1")


def docx(body: bytes) -> str:
    """Paragraphs, then table rows with cells joined by a bar, from the document part of a .docx file (standard library only)."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(body)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(str(e)) from e
    tag = lambda e: re.sub(r"^\{.*\}", "", e.tag)
    text = lambda e: "".join(x.text or "" for x in e.iter() if tag(x) == "t").strip()
    inside = {id(p) for t in root.iter() if tag(t) == "tbl" for p in t.iter()}
    parts = [text(p) for p in root.iter() if tag(p) == "p" and id(p) not in inside]
    parts += [" | ".join(c for x in r if tag(x) == "tc" and (c := text(x))) for r in root.iter() if tag(r) == "tr"]
    return "\n\n".join(p for p in parts if p)


def merge_shards(spark: SparkSession, paths: str | list[str], schema: str, key: str) -> DataFrame:
    """Shards of JSON lines; of equal keys the row of the last file, by its whole path, stays."""
    rows = spark.read.schema(schema).json(paths).withColumn("_f", F.col("_metadata.file_path"))
    rest = [c for c in rows.columns if c not in (key, "_f")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_f").alias("_r")).select(key, "_r.*")


def append_missing(new: DataFrame, path: str, *keys: str) -> None:
    """Resumable sink: rows whose keys the table lacks are added."""
    spark = new.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        new = new.join(spark.read.parquet(path).select(*keys), [*keys], "left_anti")
    new.write.mode("append").parquet(path)


def request_key(request: Column, digits: int = 20) -> Column:
    """The cache key of a request written as canonical JSON."""
    return F.substring(F.sha2(request, 256), 1, digits)


def cached(requests: DataFrame, cache: DataFrame, request: str = "request") -> DataFrame:
    """requests with the cached response, null where there is none yet."""
    return requests.withColumn("key", request_key(F.col(request))).join(cache, "key", "left")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New keys are inserted; of known keys only missing values (null or blank) are filled."""
    from ..functions.text import present

    o, n = old.alias("o"), new.alias("n")
    cols = [c for c in old.columns if c != key]
    fill = lambda c: F.coalesce(present(F.col(f"o.{c}")) if dict(old.dtypes)[c] == "string" else F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(fill(c) for c in cols))


def gaps(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries: slug, urls. (slug, stem, url) without a file of that stem: the slug for the first address, slug_2, slug_3, ... for others."""
    e = entries.select("slug", F.posexplode("urls").alias("i", "url"))
    stem = F.when(F.col("i") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), (F.col("i") + 1).cast("string")))
    return e.select("slug", stem.alias("stem"), "url").join(files.select("stem"), "stem", "left_anti")


def upsert_points(points: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each id."""
    rest = [c for c in points.columns if c != key]
    return points.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("_r")).select(key, "_r.*")


def collection_name(mode: Column) -> Column:
    return F.concat(F.lit("corpus_"), F.replace(mode, F.lit("+"), F.lit("_")))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report table; at most so many rows, which is its purpose."""
    rows = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in df.limit(most).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
