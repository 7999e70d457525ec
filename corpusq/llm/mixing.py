"""Mixing sources to target weights with soft memberships.

Every document belongs to domains: one with a source to that source, one without to the likeliest by the posterior of a
classifier fitted on documents with sources, in steps of 1 / `GRID`. Documents of the same membership share a rate (expected
uses), so the sizes of all memberships, one distributed sum, are all that the fit needs: projected-gradient least squares on
rates, 0 <= rate <= allowed repeats, so that the expected size of each domain meets its target. Documents with a source move
first, then all, so that those without serve the domains that fall short. Rates become whole uses by systematic selection
along the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.functions.storage import written
from corpusq.llm.abuse import features, hashed
from corpusq.llm.samples import bounded_sample
from corpusq.llm.sizes import TOKENIZER, encoding

#: The classifier is fitted on at most this many documents with sources, chosen by hash of the id.
MAX_LABELLED = 5_000
BITS = 16
#: A document without source belongs to so many domains at most, in whole parts of 1 / GRID. This bounds the memberships.
MEMBERSHIPS, GRID = 3, 8
STEPS, TOLERANCE = 2_000, 1e-7
#: Documents of one size are dealt to so many parts by hash, as one size may hold a third of all.
PARTS = 256
#: Fractions of uses are whole numbers in this unit, so that sums don't depend on their order.
UNIT = 1_000_000_000
OTHER = "(other)"


class NaiveBayes:
    """Multinomial over hashed unigrams and bigrams; evidence grows with the root of the length, as words depend on one another."""

    def __init__(self, texts: list[str], labels: list[str], domains: list[str]):
        self.domains = domains
        at = {d: i for i, d in enumerate(domains)}
        counts = np.full((len(domains), 1 << BITS), 0.1)
        y = np.array([at[x] for x in labels], np.int64)
        f, doc = _words(texts)
        np.add.at(counts, (y[doc], f), 1)
        self.log = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        self.prior = np.log((np.bincount(y, minlength=len(domains)) + 1) / (len(y) + len(domains)))

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        f, doc = _words(texts)
        n = np.bincount(doc, minlength=len(texts))
        sums = np.stack([np.bincount(doc, w[f], len(texts)) for w in self.log], 1)
        z = self.prior + sums / np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    h, sent, doc = hashed(texts)
    f, where = features(h, sent)
    return f & ((1 << BITS) - 1), doc[where] if len(where) else where


def fit_domains(documents: DataFrame, domains: list[str], max_labelled: int = MAX_LABELLED) -> NaiveBayes:
    """A classifier of the documents' sources; sources that no mix names are one domain."""
    known = documents.where("source IS NOT NULL").select("doc_id", "source", "text")
    rows = bounded_sample(known, "doc_id", "text", max_labelled).toArrow()
    labels = [s if s in domains else OTHER for s in rows["source"].to_pylist()]
    return NaiveBayes(rows["text"].to_pylist(), labels, domains)


def in_parts(posterior: np.ndarray) -> np.ndarray:
    """Whole parts that add up to GRID, of the MEMBERSHIPS likeliest domains of each row."""
    n, k = posterior.shape
    rank = np.argsort(-posterior, axis=1, kind="stable")
    kept = np.zeros((n, k))
    at = np.arange(n)[:, None], rank[:, :MEMBERSHIPS]
    kept[at] = posterior[at]
    parts = np.floor(kept / kept.sum(1, keepdims=True) * GRID + 0.5).astype(np.int64)
    parts[np.arange(n), rank[:, 0]] += GRID - parts.sum(1)
    return parts


def memberships(documents: DataFrame, model: NaiveBayes, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens, parts (by domain, of GRID): one pass over the texts."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        at = {d: i for i, d in enumerate(model_domains)}
        own = [[GRID * (i == j) for j in range(len(at))] for i in range(len(at))]
        for b in batches:
            texts, source = b.column("text").to_pylist(), b.column("source").to_pylist()
            sizes = [len(e.encode_ordinary(t)) if t else 0 for t in texts]
            parts = [None if s is None else own[at.get(s, at[OTHER])] for s in source]
            free = [i for i, s in enumerate(source) if s is None]
            if free:
                for i, p in zip(free, in_parts(sent.value.posteriors([texts[i] for i in free])).tolist(), strict=True):
                    parts[i] = p
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "source", "n_tokens", "parts"])

    model_domains = model.domains
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("source", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("parts", T.ArrayType(T.IntegerType()))])
    return documents.select("doc_id", "source", "text").mapInArrow(run, schema)


def project(member: np.ndarray, size: np.ndarray, own: np.ndarray, target: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Rates of memberships (rows of `member`, shares of domains) by projected gradient on the squared distance of the
    expected domain sizes from `target`; steps are scaled by the domains' supply. Those of documents with a source (`own`)
    move alone until they rest, then all."""
    rate = np.zeros(len(size))
    for movable in (own, np.ones(len(size), bool)):
        supply = (size * movable) @ member
        for _ in range(STEPS):
            lack = np.divide(target - (rate * size) @ member, supply, out=np.zeros(len(target)), where=supply > 0)
            new = np.where(movable, np.clip(rate + member @ lack, 0, caps), rate)
            moved, rate = np.abs(new - rate).max(initial=0), new
            if moved < TOLERANCE:
                break
    return rate


def fit_rates(members: DataFrame, targets: DataFrame, domains: list[str]) -> dict[str, dict]:
    """Per mix: rates of the memberships that are used, targets, supplies. The driver sees one number per membership, of
    which there are at most as many as the domains, MEMBERSHIPS and GRID allow."""
    k, at = len(domains), {d: i for i, d in enumerate(domains)}
    got = members.where("n_tokens > 0").groupBy(F.col("source").isNotNull().alias("own"), "parts").agg(F.sum("n_tokens").alias("n")).collect()
    got.sort(key=lambda r: (r.own, r.parts))
    parts = [r.parts for r in got]
    member, size, own = np.array(parts, float).reshape(-1, k) / GRID, np.array([r.n for r in got], float), np.array([r.own for r in got], bool)
    total, supply = float(size.sum()), (size * own) @ member if len(got) else np.zeros(k)
    mixes: dict[str, dict] = {}
    for r in targets.where("mix_name IS NOT NULL AND source IS NOT NULL").orderBy("mix_name", "source").collect():
        m = mixes.setdefault(r.mix_name, {"target": np.zeros(k), "repeats": np.zeros(k), "named": []})
        m["target"][at[r.source]] = (r.target_share or 0) * (r.budget_ratio or 0) * total
        m["repeats"][at[r.source]] = max(r.max_repeats or 0, 0)
        m["named"].append(r.source)
    for m in mixes.values():
        top = member.argmax(1) if len(got) else np.zeros(0, int)
        rate = project(member, size, own, m["target"], m["repeats"][top])
        m["rates"] = [(bool(o), p, domains[t], float(r)) for o, p, t, r in zip(own, parts, top, rate, strict=True) if r > 1e-9]
        m |= {"supply": supply, "expected": np.bincount(top, rate * size, k)}
    return mixes


_PLACE = ["mix_name", "domain", "n_tokens"]


def draws(members: DataFrame, mixes: dict[str, dict], domains: list[str]) -> DataFrame:
    """mix_name, doc_id, source, domain, n_tokens, uses of every document used."""
    rows = [(m, *r) for m, x in mixes.items() for r in x["rates"]]
    rates = members.sparkSession.createDataFrame(rows, "mix_name string, own boolean, parts array<int>, domain string, rate double")
    drawn = members.where("n_tokens > 0").withColumn("own", F.col("source").isNotNull()).join(F.broadcast(rates), ["own", "parts"])  # a row per mix and membership
    rated = written(drawn.select("mix_name", "doc_id", "source", "domain", "n_tokens", "rate").withColumn("row", F.monotonically_increasing_id()), "rated")
    whole = written(systematic(rated), "whole")
    return repaired(whole, mixes, domains).where("uses > 0").select("mix_name", "doc_id", "source", "domain", "n_tokens", "uses")


def _part() -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS)).alias("part")


def _order() -> list:
    return [F.xxhash64("doc_id"), "doc_id", "row"]


def systematic(rated: DataFrame) -> DataFrame:
    """`rated` with whole `uses`, floor or ceiling of rate: along the sizes of a domain, a document gets one more where the sum
    of the rates' fractions passes a whole number. The sums run over sizes first, then over the parts of a size, then within
    a part, so that no task goes through all documents of a domain or of a size."""
    cut = rated.withColumns({"part": _part(), "over": F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("bigint")})
    by_part = cut.groupBy(*_PLACE, "part").agg(F.sum("over").alias("all"))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.withColumn("in_size", F.coalesce(F.sum("all").over(upto(*_PLACE).orderBy("part")), F.lit(0)))
    by_size = by_part.groupBy(*_PLACE).agg(F.sum("all").alias("all")).withColumn("in_domain", F.coalesce(F.sum("all").over(upto("mix_name", "domain").orderBy("n_tokens")), F.lit(0)))
    before = before.drop("all").join(by_size.drop("all"), _PLACE)
    inside = Window.partitionBy(*_PLACE, "part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("upto", F.sum("over").over(inside)).join(before, [*_PLACE, "part"])
    end = F.col("in_domain") + F.col("in_size") + F.col("upto") + UNIT // 2
    uses = F.floor("rate") + F.floor(end / UNIT) - F.floor((end - F.col("over")) / UNIT)
    return summed.withColumn("uses", uses.cast("bigint")).select(*rated.columns, "uses")


def repaired(whole: DataFrame, mixes: dict[str, dict], domains: list[str]) -> DataFrame:
    """`whole` with single uses added or taken away where rounding left a domain off its expected size.

    Only sizes up to the difference matter, so a histogram of these is all the driver sees; it fills the difference from the
    largest size down, and of each size as many documents as needed, in hash order, change by one use.
    """
    expected = {(m, d): float(x["expected"][i]) for m, x in mixes.items() for i, d in enumerate(domains)}
    caps = {(m, d): int(x["repeats"][i]) for m, x in mixes.items() for i, d in enumerate(domains)}
    spark = whole.sparkSession
    off, rows = {}, []
    for r in whole.groupBy("mix_name", "domain").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("n")).collect():
        key = r.mix_name, r.domain
        off[key] = round(expected[key] - r.n) if expected[key] > 0 else 0
        rows.append((*key, off[key], caps[key]))
    if not rows:
        return whole
    differs = F.broadcast(spark.createDataFrame(rows, "mix_name string, domain string, off bigint, cap bigint"))  # a row per mix and source
    can = whole.join(differs, ["mix_name", "domain"]).where("n_tokens <= abs(off) AND CASE WHEN off > 0 THEN uses < cap ELSE uses > 0 END")
    take: list[tuple] = []
    for r in can.groupBy(*_PLACE).count().orderBy("mix_name", "domain", F.desc("n_tokens")).collect():
        key = r.mix_name, r.domain
        n = min(r["count"], abs(off[key]) // r.n_tokens)
        if n:
            take.append((*key, r.n_tokens, n, 1 if off[key] > 0 else -1))
            off[key] -= take[-1][4] * n * r.n_tokens
    if not take:
        return whole
    chosen = F.broadcast(spark.createDataFrame(take, "mix_name string, domain string, n_tokens bigint, take bigint, by bigint"))  # at most a row per token of difference
    near = can.join(chosen, _PLACE).select(*_PLACE, "row", "doc_id", "take", "by", _part())
    counted = near.groupBy(*_PLACE, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*_PLACE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy(*_PLACE, "part").orderBy(*_order()))
    open_parts = near.join(counted.select(*_PLACE, "part", before.alias("before")), [*_PLACE, "part"]).where("before < take")
    changed = open_parts.withColumn("nr", at).where("before + nr <= take").select("mix_name", "row", "by")
    return whole.join(changed, ["mix_name", "row"], "left").select(*[c for c in whole.columns if c != "uses"], (F.col("uses") + F.coalesce("by", F.lit(0))).alias("uses"))


def mix(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, dict[str, dict], list[str]]:
    """Draws for every mix of `targets` (a table of fixed size), the fitted mixes, the domains.

    Documents with NULL or empty text have no size and are not drawn. A mix of sources without documents is short of them;
    a source in no mix gets rate 0. Nothing is drawn more often than its source's max_repeats, a document without source
    not more often than those of its likeliest domain. Rows with the same or no id are documents of their own. The draws
    depend on the rows only, not on how they are partitioned.
    """
    domains = sorted({r.source for r in targets.select("source").distinct().collect() if r.source is not None}) + [OTHER]
    model = fit_domains(documents, domains, max_labelled)
    members = written(memberships(documents, model, path), "members")
    mixes = fit_rates(members, targets, domains)
    return draws(members, mixes, domains), mixes, domains


def shares(drawn: DataFrame, mixes: dict[str, dict], domains: list[str]) -> DataFrame:
    """Per mix and source: target and actual share and size, documents, uses, most uses of one, own supply within the
    allowed repeats, and whether that suffices."""
    spark = drawn.sparkSession
    rows = [(m, d, float(x["target"][i]), float(x["supply"][i] * x["repeats"][i])) for m, x in mixes.items() for i, d in enumerate(domains) if d in x["named"]]
    want = spark.createDataFrame(rows, "mix_name string, source string, target_tokens double, supply_tokens double")
    got = drawn.withColumnRenamed("source", "doc_source").groupBy("mix_name", F.col("domain").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.sum(F.when(F.col("doc_source").isNull(), F.col("uses") * F.col("n_tokens")).otherwise(0)).alias("tokens_without_source"))
    w = Window.partitionBy("mix_name")  # a few sources each
    return (
        want.join(got, ["mix_name", "source"], "left")
        .fillna(0, ["n_docs", "n_uses", "most_uses", "tokens", "tokens_without_source"])
        .withColumn("target_share", F.try_divide("target_tokens", F.sum("target_tokens").over(w)))
        .withColumn("actual_share", F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(w)))
        .withColumn("target_met", F.col("supply_tokens") >= F.col("target_tokens"))
    )
