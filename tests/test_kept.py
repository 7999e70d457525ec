"""The valid tokens that are written once: all of them, by an exchange that is small and doesn't stay on the disk."""

import os
import time

import pytest
from pyspark.sql import functions as F

from corpusq.functions import storage
from corpusq.model import from_deliveries, kept

PLACE = {"comp": "en", "doc_in_comp": 0, "sent_idx": 0, "sent_in_doc": 0, "doc_idx": 0, "sent_end": 9000, "doc_end": 9000, "head": 0}


@pytest.fixture(scope="module")
def deliveries(spark, tmp_path_factory):
    """9,000 positions, every third delivered again with another word and other features."""
    d = tmp_path_factory.mktemp("deliveries")
    first = spark.range(9000).select(F.col("id").alias("pos"), F.lit(0).alias("at"))
    t = first.union(first.where("pos % 3 = 0").withColumn("at", F.lit(1)))
    t = t.withColumns({k: F.lit(v) for k, v in PLACE.items()}).withColumn("tok_in_sent", F.col("pos").cast("int"))
    t = t.withColumns({c: F.lit("x") for c in ("lemma", "upos", "xpos", "deprel", "deps")}).withColumns({"no_space_after": F.lit(False), "ingested_at": F.timestamp_seconds("at")})
    t.withColumns({"word": F.expr("concat('w', at)"), "feats": F.expr("if(at = 0, 'Number=Sing|Tense=Past', 'Number=Plur')")}).drop("at").write.parquet(f"{d}/tokens.parquet")
    of = {
        "sentences": "0 sent_idx, 0 sent_in_doc, 0 doc_idx, 0L start_pos, 9000L end_pos, '1' sent_id, timestamp'2024-01-01' ingested_at",
        "corpus_docs": "0 doc_idx, 0 doc_in_comp, 'en' comp, 'a.conllu' doc_name, 0L start_pos, 9000L end_pos, timestamp'2024-01-01' ingested_at",
        "components": "0 comp_id, 'en' comp, '' comp_path, 'en' lang",
        "alignment_meta": "'a' align_name, 'en' source_component, 'en' target_component, '' edges, 'sentence' source_layer, 'sentence' target_layer, true directed",
        "alignment_edges": "'a' align_name, 0 src_doc, 0 src_sent, 0 tgt_doc, 0 tgt_sent",
    }
    for name, columns in of.items():
        spark.range(1).selectExpr(*columns.split(", ")).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := os.path.basename(files.apply(i).getPath())).startswith("shuffle_")}


def left(spark, before):
    """Shuffle files since then, once Spark had up to ten seconds to delete them in the background."""
    for _ in range(100):
        if not (now := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return now


def test_exchanges_of_parts_are_gone(spark):
    """Nothing of a part is left as the next begins, and Spark's setting is as it was."""
    before, seen = shuffle_files(spark), []
    part = lambda k: (seen.append(left(spark, before)), F.col("id") % 3 == k)[1]
    df = storage.written_in_parts(spark.range(3000).repartition("id"), "parts", (part(k) for k in range(3)))
    assert seen == [set()] * 3 and not left(spark, before)
    assert sorted(r.id for r in df.collect()) == list(range(3000)) and spark.conf.get(storage.CLEAN) == "false"


def test_valid_tokens_are_whole(spark, deliveries):
    df = kept(from_deliveries(spark, deliveries, None)).tokens("word", "feats", "feats.Number", "feats.Tense")
    assert df.count() == 9000 and df.select("pos").distinct().count() == 9000
    got = {tuple(r) for r in df.select(F.expr("pos % 3 = 0"), "word", "`feats.Number`", "`feats.Tense`").distinct().collect()}
    assert got == {(True, "w1", "Plur", None), (False, "w0", "Sing", "Past")}


def test_one_part_and_many_give_the_same(spark, deliveries):
    raw = from_deliveries(spark, deliveries, None)
    one, many = (kept(raw, n).tokens(*raw.layers) for n in (1, 5))
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0


def test_features_are_not_exchanged_beside_feats(spark, deliveries):
    raw = from_deliveries(spark, deliveries, None)
    plan = raw.tokens("feats", "feats.Number", "feats.Tense").where("pos % 2 = 1")._jdf.queryExecution().executedPlan().toString()
    above, below = plan[: plan.index("Exchange")], plan[plan.index("Exchange") :]
    assert "Number=" in above and "Number=" not in below and "pos" in below and "% 2" in below
    assert "Number=" in (p := raw.tokens("feats.Number")._jdf.queryExecution().executedPlan().toString())[p.index("Exchange") :]
