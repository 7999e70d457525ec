"""Readers: files to parsed rows. A reader is any object with `read(spark, path, strict) -> Parsed`."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.errors import FormatError

#: file, sent_no (order within the file), sent_id, line_no (order within the sentence) and the ten columns.
COLUMNS = ("id", "word", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
#: Sentence blocks end at lines that are blank once trimmed.
_BLANK = r"\n\s*\n"


@dataclass
class Parsed:
    rows: DataFrame
    skipped: DataFrame  # file, sent_no of sentences left out


class CorpusReader(Protocol):
    def read(self, spark: SparkSession, path: str, strict: bool = False) -> Parsed: ...


def trimmed(x: Column) -> Column:
    """Without white space at the ends, tabs included: a row that ends in empty columns is shorter for it."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _blocks(files: DataFrame) -> DataFrame:
    """file, sent_no, lines: blocks of lines between blank lines. files: file, value."""
    text = F.regexp_replace(F.col("value"), "\r\n", "\n")
    return files.select("file", F.posexplode(F.split(text, _BLANK)).alias("sent_no", "block")).select("file", "sent_no", F.split("block", "\n").alias("lines"))


class ConlluReader:
    """Tab-separated rows of ten columns. A sentence with a shorter row is left out as a whole; with `strict` the first such
    row is an error that names file and line."""

    def __init__(self, pattern: str = "*.conllu"):
        self.pattern = pattern

    def files(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", self.pattern).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def read(self, spark: SparkSession, path: str, strict: bool = False) -> Parsed:
        return self.parse(self.files(spark, path), strict)

    def parse(self, files: DataFrame, strict: bool = False) -> Parsed:
        if strict:
            _first_fault(files)
        blocks = _blocks(files).withColumn("lines", F.transform("lines", trimmed))
        data = F.filter("lines", lambda x: (x != "") & ~x.startswith("#"))
        ids = F.filter("lines", lambda x: x.startswith("# sent_id = ") | x.startswith("# sent_id="))
        last = F.try_element_at(ids, F.lit(-1))  # the last of several counts
        sentences = blocks.select("file", "sent_no", data.alias("data"), trimmed(F.regexp_replace(last, "^# sent_id ?= ?", "")).alias("sent_id")).where(F.size("data") > 0)
        whole = F.forall("data", lambda x: F.size(F.split(x, "\t")) >= 10)
        rows = sentences.where(whole).select("file", "sent_no", F.nullif("sent_id", F.lit("")).alias("sent_id"), F.posexplode(F.transform("data", lambda x: F.split(x, "\t"))).alias("line_no", "f"))
        return Parsed(rows.select("file", "sent_no", "sent_id", "line_no", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(COLUMNS)]), sentences.where(~whole).select("file", "sent_no"))


def _first_fault(files: DataFrame) -> None:
    split = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).withColumn("line", trimmed(F.col("line")))
    lines = split.where((F.col("line") != "") & ~F.col("line").startswith("#") & (F.size(F.split("line", "\t")) < 10))
    bad = lines.orderBy("file", "at").limit(1).collect()
    if bad:
        raise FormatError(f"{bad[0].file}:{bad[0].at + 1}: expected 10 tab-separated fields")


class PlainTextReader:
    """Lines are sentences; words, numbers and other signs are tokens. Only word and spacing are filled."""

    def __init__(self, pattern: str = "*.txt"):
        self.pattern = pattern

    def read(self, spark: SparkSession, path: str, strict: bool = False) -> Parsed:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", self.pattern).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
        return self.parse(files)

    def parse(self, files: DataFrame) -> Parsed:
        lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("sent_no", "line"))
        pairs = F.expr(r"regexp_extract_all(line, '(\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}])(\\s?)', 1)")
        gaps = F.expr(r"regexp_extract_all(line, '(\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}])(\\s?)', 2)")
        tok = lines.select("file", "sent_no", F.posexplode(F.arrays_zip(pairs.alias("word"), gaps.alias("gap"))).alias("line_no", "t"))
        none = [F.lit(None).cast("string").alias(c) for c in COLUMNS[2:9]]
        glue = F.when(F.col("t.gap") == "", F.lit("SpaceAfter=No"))
        rows = tok.select("file", "sent_no", F.lit(None).cast("string").alias("sent_id"), "line_no", (F.col("line_no") + 1).cast("string").alias("id"), F.col("t.word").alias("word"), *none, glue.alias("misc"))
        return Parsed(rows, rows.limit(0).select("file", "sent_no"))
