"""Delimited text lines to typed rows, the faulty ones apart with the reason."""

from __future__ import annotations

import csv
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.functions.ordering import running_offsets

QUOTING, COLUMN_COUNT, BAD_VALUE = "quoting", "column_count", "bad_value"
#: Stands for a line end within a record, where the parser must see one record; also a control character.
_LINE_END = "\x1e"


@dataclass(frozen=True)
class Format:
    """Column names, constructors of typed values (they raise ValueError), what must not be in any line."""

    columns: tuple[str, ...]
    types: dict[str, str] = field(default_factory=dict)
    build: dict[str, Callable[[str], object]] = field(default_factory=dict)
    delimiter: str = ","
    forbidden: re.Pattern | None = None


def parse(line: str | None, fmt: Format) -> tuple[list | None, str | None]:
    """The typed values of a record, or the first reason against it.

    A NULL or empty line has the wrong number of columns. A record may hold line ends only within quotes; elsewhere they
    stay in the value, for its constructor to judge.
    """
    if not line:
        return None, COLUMN_COUNT
    flat = line.replace("\r", _LINE_END).replace("\n", _LINE_END)
    try:
        fields = next(csv.reader([flat], delimiter=fmt.delimiter, strict=True, doublequote=True))
    except csv.Error:
        return None, QUOTING
    if '"' in flat and not _quotes_whole_fields(flat, fields):
        return None, QUOTING
    if len(fields) != len(fmt.columns):
        return None, COLUMN_COUNT
    if fmt.forbidden is not None and fmt.forbidden.search(flat):
        return None, BAD_VALUE
    try:
        return [fmt.build.get(c, _text)(x.replace(_LINE_END, "\n")) for c, x in zip(fmt.columns, fields, strict=True)], None
    except ValueError:
        return None, BAD_VALUE


def _quotes_whole_fields(line: str, fields: list[str]) -> bool:
    """The parser takes a quote within an unquoted field for text; walking the line by the lengths of its fields finds those."""
    at = 0
    for x in fields:
        if line.startswith('"', at):
            at += len(x) + x.count('"') + 3
        elif '"' in x:
            return False
        else:
            at += len(x) + 1
    return at == len(line) + 1


def _text(x: str) -> str | None:
    return None if x == "_" else x


def split_lines(df: DataFrame, line: str, fmt: Format) -> DataFrame:
    """`df` with the columns of `fmt` (NULL in faulty rows) and `reason` (NULL in valid ones). One pass, no shuffle;
    one row out for each row in, so both parts come from the same read. Names of added columns must be free in `df`."""
    names = [*fmt.columns, "reason"]
    if clash := set(names) & set(df.columns):
        raise ValueError(f"column names in use: {sorted(clash)}")
    added = [T.StructField(c, T._parse_datatype_string(fmt.types.get(c, "string"))) for c in names]
    schema = T.StructType([*df.schema.fields, *added])
    kinds = [pa.from_numpy_dtype("int64") if f.dataType == T.LongType() else pa.string() for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            out: list[list] = [[] for _ in names]
            for x in b.column(line).to_pylist():
                values, reason = parse(x, fmt)
                for at, v in zip(out, [*(values or [None] * len(fmt.columns)), reason], strict=True):
                    at.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def assemble_records(lines: DataFrame, file: str, order: str, line: str, max_lines: int = 1000) -> DataFrame:
    """`file`, `order` (of the first line) and `line`: physical lines joined, by line ends, to records where quotes span them.

    A line begins a record if the number of quotes before it in its file is even. `order` is unique within a file. A record of
    more than `max_lines` lines has a quote that was never closed: each of its lines stands for itself, to be judged alone.
    Running counts are made over ranges of all files, so no task has to hold a file; NULL lines count as empty ones.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    rows = lines.select(F.col(file).alias("__file"), F.col(order).alias("__order"), text.alias("__line"))
    quotes = running_offsets(rows.withColumn("__n", F.length("__line") - F.length(F.replace("__line", F.lit('"'), F.lit("")))), ["__file", "__order"], {"__all": "__n"})
    first = quotes.groupBy(F.col("__file").alias("__of")).agg(F.min("__all").alias("__none"))
    begun = quotes.join(first, F.col("__file").eqNullSafe(F.col("__of"))).withColumn("__begins", ((F.col("__all") - F.col("__none")) % 2 == 0).cast("long"))
    nr = running_offsets(begun.select("__file", "__order", "__line", "__begins"), ["__file", "__order"], {"__nr": "__begins"}).withColumn("__nr", F.col("__nr") + F.col("__begins"))
    sizes = nr.groupBy("__nr").agg(F.count(F.lit(1)).alias("__n"))
    cut = nr.join(sizes, "__nr").withColumn("__alone", F.when(F.col("__n") > max_lines, F.col("__order")))
    parts = F.sort_array(F.collect_list(F.struct("__order", "__line")))
    joined = cut.groupBy("__file", "__nr", "__alone").agg(parts.alias("__p"))  # at most max_lines
    return joined.select(F.col("__file").alias(file), F.get("__p", F.lit(0))["__order"].alias(order), F.array_join(F.transform("__p", lambda x: x["__line"]), "\n").alias(line))


def read_delimited(spark: SparkSession, path: str, fmt: Format) -> DataFrame:
    """Records of text files with file, record_no (order within the file), line, the columns of `fmt` and reason."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("record_no"), F.col("value").alias("line"))
    return split_lines(assemble_records(read, "file", "record_no", "line"), "line", fmt)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejected(parsed: DataFrame, fmt: Format) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).drop(*fmt.columns)


#: The universal part-of-speech tags.
UPOS = frozenset("ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split())
_ID = re.compile(r"[1-9][0-9]*|[1-9][0-9]*-[1-9][0-9]*|[0-9]+\.[1-9][0-9]*")
_CONTROL = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cc") + "�]")


def _filled(x: str) -> str:
    if not x.strip():
        raise ValueError("blank")
    return x


def _sent_id(x: str) -> str:
    if x == "_":
        raise ValueError("no sentence id")
    return _filled(x)


def _token_id(x: str) -> str:
    if not _ID.fullmatch(x):
        raise ValueError("token id")
    return x


def _head(x: str) -> int | None:
    if x == "_":
        return None
    if not (x.isascii() and x.isdigit()):
        raise ValueError("head")
    x = x.lstrip("0") or "0"
    return int(x) if len(x) < 19 or len(x) == 19 and x <= "9223372036854775807" else None  # valid, but no bigint: NULL, never another number


def _upos(x: str) -> str | None:
    if x != "_" and x not in UPOS:
        raise ValueError("upos")
    return _text(x)


TOKEN_LINES = Format(
    columns=("sent_id", "id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"),
    types={"head": "bigint"},
    build={"sent_id": _sent_id, "id": _token_id, "form": _filled, "head": _head, "upos": _upos},
    forbidden=_CONTROL,
)
