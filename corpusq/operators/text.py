"""Text and annotations of ranges. Ranges come as a DataFrame with a key, start_pos and end_pos; all work is by joins
on positions, so any number of ranges is served at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.errors import BadRange
from corpusq.model import Corpus
from corpusq.operators.counts import token_count

KWIC_WIDTH = 5


def _positions(ranges: DataFrame, key: str) -> DataFrame:
    ok = ranges.where("end_pos > start_pos")
    return ok.select(key, "start_pos", "end_pos", F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("pos"))


def _units(corpus: Corpus, ranges: DataFrame, key: str, whole: bool) -> DataFrame:
    """key, pos, form, glued: what is printed of each range. A multi-word token prints its form for its words, and a range
    that begins inside one prints nothing for its words; with `whole`, only those fully inside the range count."""
    at = _positions(ranges, key)
    words = corpus.tokens("word", "no_space_after")
    pos = F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("pos")
    covered = corpus.mwt.where("end_pos > start_pos").select(F.col("start_pos").alias("m_start"), F.col("end_pos").alias("m_end"), "form", F.col("no_space_after").alias("m_glued"), pos)
    j = at.join(words, "pos", "left").join(covered, "pos", "left")
    used = F.col("m_start").isNotNull() & ((F.col("m_start") >= F.col("start_pos")) & (F.col("m_end") <= F.col("end_pos")) if whole else F.lit(True))
    first = used & (F.col("pos") == F.col("m_start"))
    rows = j.where(~used | first)
    return rows.select(key, "pos", F.when(first, F.col("m_end")).otherwise(F.col("pos") + 1).alias("unit_end"), F.when(first, F.col("form")).otherwise(F.coalesce("word", F.lit(""))).alias("form"), F.coalesce(F.when(first, F.col("m_glued")).otherwise(F.col("no_space_after")), F.lit(False)).alias("glued"))


def _joined(units: F.Column) -> F.Column:
    """Forms with a blank after each that is not glued, but not after the last."""
    body = F.aggregate(units, F.lit(""), lambda acc, x: F.concat(acc, x["form"], F.when(x["glued"], "").otherwise(" ")))
    last = F.element_at(units, -1)["glued"]
    return F.when(last, body).otherwise(F.substr(body, F.lit(1), F.length(body) - 1))


def surface_texts(corpus: Corpus, ranges: DataFrame, key: str) -> DataFrame:
    """`ranges` with text. An empty range has the empty text."""
    units = _units(corpus, ranges, key, whole=False).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "form", "glued"))).alias("units"))
    texts = units.select(key, _joined(F.col("units")).alias("text"))
    return ranges.join(texts, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def surface_text(corpus: Corpus, start: int, end: int) -> str:
    one = corpus.spark.createDataFrame([(0, start, end)], "key int, start_pos bigint, end_pos bigint")
    return surface_texts(corpus, one, "key").first().text


def surface_units(corpus: Corpus, ranges: DataFrame, key: str) -> DataFrame:
    """key, start_pos, end_pos, byte_start, byte_end, form of every printed unit: byte offsets into the range's text."""
    u = _units(corpus, ranges, key, whole=True)
    w = Window.partitionBy(key).orderBy("pos")
    before = F.coalesce(F.sum(F.octet_length("form") + F.when(F.col("glued"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return u.withColumn("byte_start", before.cast("bigint")).select(key, F.col("pos").alias("start_pos"), F.col("unit_end").alias("end_pos"), "byte_start", (F.col("byte_start") + F.octet_length("form")).alias("byte_end"), "form")


def kwic(corpus: Corpus, hits: DataFrame, width: int = KWIC_WIDTH) -> DataFrame:
    """doc_name, start_pos, end_pos, left, match, right: `width` tokens on both sides, across sentences and documents."""
    n = token_count(corpus)
    h = hits.select("start_pos", "end_pos", "doc_idx").distinct()
    part = lambda i, a, b: F.struct(F.lit(i).alias("part"), a.alias("a"), b.alias("b"))
    s, e = F.col("start_pos"), F.col("end_pos")
    three = h.select("start_pos", "end_pos", F.explode(F.array(part(0, F.greatest(s - width, F.lit(0)), s), part(1, s, e), part(2, e, F.least(e + width, F.lit(n))))).alias("p"))
    ranges = three.select(F.struct("start_pos", "end_pos", "p.part").alias("key"), F.col("p.a").alias("start_pos"), F.col("p.b").alias("end_pos"))
    texts = surface_texts(corpus, ranges, "key").select("key.*", "text")
    wide = texts.groupBy("start_pos", "end_pos").agg(*[F.max(F.when(F.col("part") == i, F.col("text"))).alias(c) for i, c in enumerate(("left", "match", "right"))])
    return h.join(wide, ["start_pos", "end_pos"]).join(corpus.documents.select("doc_idx", "doc_name"), "doc_idx").select("doc_name", "start_pos", "end_pos", "left", "match", "right")


def context_tokens(corpus: Corpus, hits: DataFrame, layer: str, width: int) -> DataFrame:
    """start_pos, end_pos, pos, relative, value of every position around and in each hit; no value is the empty string."""
    n = token_count(corpus)
    w = hits.select("start_pos", "end_pos").select("*", F.explode(F.sequence(F.greatest(F.col("start_pos") - width, F.lit(0)), F.least(F.col("end_pos") + width, F.lit(n)) - 1)).alias("pos"))
    values = corpus.tokens(layer).select("pos", F.coalesce(F.col(f"`{layer}`").cast("string"), F.lit("")).alias("value"))
    return w.join(values, "pos").select("start_pos", "end_pos", "pos", (F.col("pos") - F.col("start_pos")).alias("relative"), "value")


def collocations(corpus: Corpus, hits: DataFrame, layer: str, width: int) -> DataFrame:
    """relative, value, n over the windows of all hits."""
    return context_tokens(corpus, hits, layer, width).groupBy("relative", "value").agg(F.count(F.lit(1)).alias("n"))


def layer_texts(corpus: Corpus, ranges: DataFrame, key: str, layer: str) -> DataFrame:
    """`ranges` with text: the surface for word, else the values there are, with single blanks."""
    if layer == "word":
        return surface_texts(corpus, ranges, key)
    values = corpus.tokens(layer).select("pos", F.col(f"`{layer}`").cast("string").alias("v"))
    got = _positions(ranges, key).join(values, "pos").where("v IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("u"))
    texts = got.select(key, F.array_join(F.transform("u", lambda x: x["v"]), " ").alias("text"))
    return ranges.join(texts, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def annotation(corpus: Corpus, pos: int, layer: str) -> str | None:
    if layer not in corpus.layers:
        return None
    r = corpus.tokens(layer).where(F.col("pos") == pos).select(F.col(f"`{layer}`").cast("string").alias("v")).first()
    return r and r.v


def annotations(corpus: Corpus, positions: DataFrame, layer: str) -> DataFrame:
    """pos, value; no value is the empty string."""
    values = corpus.tokens(layer).select("pos", F.coalesce(F.col(f"`{layer}`").cast("string"), F.lit("")).alias("value"))
    return positions.select("pos").join(values, "pos")


def annotations_long(corpus: Corpus, start: int, end: int, layers: list[str] | None = None) -> DataFrame:
    """pos, layer, value, kind of the values there are in [start, end)."""
    if start > end:
        raise BadRange(f"{start} > {end}")
    layers = [x for x in (layers or corpus.layers) if x in corpus.layers]
    t = corpus.tokens(*layers).where((F.col("pos") >= start) & (F.col("pos") < end))
    pairs = [F.struct(F.lit(x).alias("layer"), F.col(f"`{x}`").cast("string").alias("value"), F.lit(corpus.layer_kind(x)).alias("kind")) for x in layers]
    return t.select("pos", F.explode(F.array(*pairs)).alias("p")).select("pos", "p.*").where("value IS NOT NULL")


def mwt_covering(corpus: Corpus, pos: int) -> DataFrame:
    return corpus.mwt.where((F.col("start_pos") <= pos) & (F.col("end_pos") > pos))


def mwts_in(corpus: Corpus, start: int, end: int) -> DataFrame:
    return corpus.mwt.where((F.col("start_pos") < end) & (F.col("end_pos") > start))


def no_space_after(corpus: Corpus, pos: int) -> bool:
    r = corpus.tokens("no_space_after").where(F.col("pos") == pos).first()
    return bool(r and r.no_space_after)


def empty_nodes_of(corpus: Corpus, sent_idx: int) -> DataFrame:
    return corpus.empty_nodes.where(F.col("sent_idx") == sent_idx)
