"""Queries over the problems of problems 2-4: hierarchies, heavy keys, faulty rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.operators.eager_aggregate import eager_join_aggregate
from corpusq.operators.hierarchy import resolve_hierarchy
from corpusq.operators.latest import latest_valid
from corpusq.sources.delimited import TOKEN_LINES, accepted, rejected, split_lines

#: Neighbouring positions kept together where deliveries are told apart.
POSITION_BLOCK = 4096
#: A word or lemma is heavy from this share of all positions on.
HEAVY_SHARE = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The valid delivery of each position; only the named columns are read."""
    return latest_valid(table(spark, sf_dir, "tokens").select("pos", *columns, "ingested_at"), "pos", block=POSITION_BLOCK).drop("ingested_at")


def _hierarchy(spark: SparkSession, sf_dir: str, label: str | None = None, paths: bool = True) -> DataFrame:
    # A head of 0 or NULL is no token's tok_in_sent, so its chain ends there.
    t = tokens(spark, sf_dir, "sent_idx", "tok_in_sent", "head", *([label] if label else []))
    return resolve_hierarchy(t, "sent_idx", "tok_in_sent", "head", label, paths, size_source=table(spark, sf_dir, "tokens"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir, paths=False).where("cyclic").select("pos")


def p2_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with its top token, depth, number of tokens below, path and deprels on the way."""
    r = _hierarchy(spark, sf_dir, "deprel")
    return r.select(
        "pos", "sent_idx", F.col("root").alias("top_tok"), "depth", "n_below", "cyclic",
        F.expr("array_join(transform(path, x -> string(x)), '/')").alias("path"),
        F.expr("array_join(transform(labels, x -> coalesce(x, '_')), '/')").alias("deprel_path"),
    )


def p2_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each token and token below it, with the distance."""
    r = _hierarchy(spark, sf_dir)
    return r.where("depth > 0").select("sent_idx", F.posexplode("path").alias("distance", "tok"), F.col("tok_in_sent").alias("below_tok")).where("distance > 0").select("sent_idx", "tok", "below_tok", F.col("distance").cast("long"))


def _both_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, n_left, n_right: each string's positions as word and as lemma, by eager aggregation through the full join of all
    positions on word = lemma, which has their product of rows for every string."""
    together = tokens(spark, sf_dir, "word", "lemma").groupBy("word", "lemma").agg(F.count(F.lit(1)).alias("n"))
    words, lemmas = together.select(F.col("word").alias("term"), "n"), together.select(F.col("lemma").alias("term"), "n")
    return eager_join_aggregate(words, lemmas, ["term"], how="full", count_left="n", count_right="n", by_key=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _both_layers(spark, sf_dir)
    total = both.agg(F.sum("n_left").alias("total"))  # one row
    layers = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(n).alias("n")) for x, n in (("word", "n_left"), ("lemma", "n_right"))])).alias("p")
    per = both.where("term IS NOT NULL").select("term", layers).select("p.*", "term")
    return per.join(F.broadcast(total)).where(f"n * {HEAVY_SHARE} >= total").select("layer", "term")


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word, lemma and language of the component: positions, and those of them that end without a space."""
    t = tokens(spark, sf_dir, "comp", "word", "lemma", "no_space_after").withColumn("glued", F.expr("CAST(coalesce(no_space_after, false) AS BIGINT)"))
    comps = table(spark, sf_dir, "components").select("comp", F.coalesce("lang", F.lit("?")).alias("lang"))
    out = None
    for layer in ("word", "lemma"):
        x = eager_join_aggregate(t, comps, ["comp"], by_left=[layer], by_right=["lang"], sum_left=["glued"], salts=16).select(F.lit(layer).alias("layer"), F.col(layer).alias("term"), "lang", F.col("n_rows").alias("n_positions"), F.col("sum_glued").alias("n_glued"))
        out = x if out is None else out.unionByName(x)
    return out.where("term IS NOT NULL")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word in two components: how many pairs of positions a join of the components on word has, by tag of the left."""
    t = tokens(spark, sf_dir, "comp", "word", "upos")
    a = t.where("comp = 'fr'").select("word", "upos")
    b = t.where("comp = 'es'").select("word", F.col("upos").alias("upos_es"))
    return eager_join_aggregate(a, b, ["word"], by_left=["upos"], by_right=["upos_es"]).withColumnRenamed("n_rows", "n_pairs")


def p3_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per two components and tags: how many pairs of positions a join of each component with all others on word has."""
    t = tokens(spark, sf_dir, "comp", "word", "upos")
    other = t.select("word", F.col("comp").alias("other_comp"), F.col("upos").alias("other_upos"))
    pairs = eager_join_aggregate(t, other, ["word"], by_left=["comp", "upos"], by_right=["other_comp", "other_upos"])
    return pairs.where("comp <> other_comp").withColumnRenamed("n_rows", "n_pairs")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "raw_rows").where("line_no IS NULL OR line_no <> 1")  # line 1 is a heading
    return split_lines(lines, "line", TOKEN_LINES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(_raw(spark, sf_dir), TOKEN_LINES).select("raw_id", "reason")


def p4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid lines as tokens."""
    return accepted(_raw(spark, sf_dir)).select("raw_id", "sent_id", "id", F.col("form").alias("word"), "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


_VALID = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY ingested_at DESC) AS rn FROM tokens) WHERE rn = 1)"
_UP = f"""valid AS (SELECT * FROM {_VALID}),
link AS (SELECT a.sent_idx, a.tok_in_sent AS tok, b.tok_in_sent AS up, a.deprel, a.pos FROM valid a LEFT JOIN valid b ON a.sent_idx = b.sent_idx AND a.head = b.tok_in_sent),
walk AS (
  SELECT sent_idx, tok, 0 AS depth, tok AS top, CAST(tok AS VARCHAR) AS path, coalesce(deprel, '_') AS rels FROM link WHERE up IS NULL
  UNION ALL
  SELECT l.sent_idx, l.tok, w.depth + 1, w.top, l.tok || '/' || w.path, coalesce(l.deprel, '_') || '/' || w.rels FROM link l JOIN walk w ON l.sent_idx = w.sent_idx AND l.up = w.tok)"""
_BELOW = """below AS (
  SELECT sent_idx, up AS tok, tok AS below_tok, 1 AS distance FROM link WHERE up IS NOT NULL AND (sent_idx, tok) IN (SELECT (sent_idx, tok) FROM walk)
  UNION ALL
  SELECT b.sent_idx, l.up, b.below_tok, b.distance + 1 FROM below b JOIN link l ON b.sent_idx = l.sent_idx AND b.tok = l.tok WHERE l.up IS NOT NULL)"""

QUERIES = {"p2_found": p2_found, "p2_tree": p2_tree, "p2_below": p2_below, "p3_found": p3_found, "p3_terms": p3_terms, "p3_pairs": p3_pairs, "p3_all_pairs": p3_all_pairs, "p4_found": p4_found, "p4_tokens": p4_tokens}

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_LINES = rf"""WITH lines AS (SELECT raw_id, coalesce(line, '') AS line FROM raw_rows WHERE line_no IS NULL OR line_no <> 1),
cut AS (SELECT *, regexp_full_match(line, '(?s){_FIELD}(,{_FIELD})*') AS quoted, regexp_extract_all(line || ',', '(?s)({_FIELD}),', 1) AS f FROM lines),
bare AS (SELECT *, list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM cut),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 11 THEN 'column_count'
  WHEN regexp_matches(line, '[\x00-\x1f\x7f-\x{{9f}}\x{{fffd}}]') OR v[1] = '_' OR regexp_full_match(v[1], '[\s\x{{a0}}]*') OR regexp_full_match(v[3], '[\s\x{{a0}}]*')
  OR NOT regexp_full_match(v[2], '[1-9][0-9]*(-[1-9][0-9]*)?|[0-9]+[.][1-9][0-9]*') OR NOT regexp_full_match(v[8], '_|[0-9]+')
  OR v[5] NOT IN ('_', 'ADJ', 'ADP', 'ADV', 'AUX', 'CCONJ', 'DET', 'INTJ', 'NOUN', 'NUM', 'PART', 'PRON', 'PROPN', 'PUNCT', 'SCONJ', 'SYM', 'VERB', 'X') THEN 'bad_value' END AS reason FROM bare)"""
SQL = {
    "p4_found": f"{_LINES} SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL",
    "p4_tokens": f"""{_LINES} SELECT raw_id, v[1] AS sent_id, v[2] AS id, v[3] AS word, nullif(v[4], '_') AS lemma, nullif(v[5], '_') AS upos, nullif(v[6], '_') AS xpos, nullif(v[7], '_') AS feats,
TRY_CAST(v[8] AS BIGINT) AS head, nullif(v[9], '_') AS deprel, nullif(v[10], '_') AS deps, nullif(v[11], '_') AS misc FROM judged WHERE reason IS NULL""",
    "p2_found": f"WITH RECURSIVE {_UP} SELECT pos FROM link WHERE (sent_idx, tok) NOT IN (SELECT (sent_idx, tok) FROM walk)",
    "p2_tree": f"""WITH RECURSIVE {_UP}, {_BELOW}
SELECT l.pos, l.sent_idx, w.top AS top_tok, CAST(w.depth AS BIGINT) AS depth, CASE WHEN w.tok IS NOT NULL THEN coalesce(n.n, 0) END AS n_below, w.tok IS NULL AS cyclic, w.path, w.rels AS deprel_path
FROM link l LEFT JOIN walk w USING (sent_idx, tok) LEFT JOIN (SELECT sent_idx, tok, count(*) AS n FROM below GROUP BY ALL) n USING (sent_idx, tok)""",
    "p2_below": f"WITH RECURSIVE {_UP}, {_BELOW} SELECT sent_idx, tok, below_tok, CAST(distance AS BIGINT) AS distance FROM below",
    "p3_found": f"""WITH valid AS (SELECT * FROM {_VALID}), t AS (SELECT 'word' AS layer, word AS term FROM valid UNION ALL SELECT 'lemma', lemma FROM valid)
SELECT layer, term FROM t WHERE term IS NOT NULL GROUP BY layer, term HAVING count(*) * {HEAVY_SHARE} >= (SELECT count(*) FROM valid)""",
    "p3_terms": f"""WITH valid AS (SELECT v.*, coalesce(c.lang, '?') AS lang FROM {_VALID} v JOIN components c USING (comp)), t AS (SELECT 'word' AS layer, word AS term, lang, no_space_after FROM valid UNION ALL SELECT 'lemma', lemma, lang, no_space_after FROM valid)
SELECT layer, term, lang, count(*) AS n_positions, CAST(count(*) FILTER (no_space_after) AS BIGINT) AS n_glued FROM t WHERE term IS NOT NULL GROUP BY ALL""",
    "p3_pairs": f"""WITH valid AS (SELECT * FROM {_VALID}), a AS (SELECT word, upos, count(*) AS n FROM valid WHERE comp = 'fr' GROUP BY ALL), b AS (SELECT word, upos AS upos_es, count(*) AS n FROM valid WHERE comp = 'es' GROUP BY ALL)
SELECT upos, upos_es, CAST(sum(a.n * b.n) AS BIGINT) AS n_pairs FROM a JOIN b USING (word) GROUP BY ALL""",
    "p3_all_pairs": f"""WITH valid AS (SELECT * FROM {_VALID}), a AS (SELECT comp, word, upos, count(*) AS n FROM valid GROUP BY ALL)
SELECT a.comp, a.upos, b.comp AS other_comp, b.upos AS other_upos, CAST(sum(a.n * b.n) AS BIGINT) AS n_pairs FROM a JOIN a b ON a.word = b.word AND a.comp <> b.comp GROUP BY ALL""",
}
