from corpusq.streaming.ingest import append_rows
from tests.fixtures import HERONS, conllu


def test_files_are_taken_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i in range(2):
        (src / f"{i}.conllu").write_text(conllu(HERONS[i : i + 1]))
        append_rows(spark, str(src), out, str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(out).count() == (6, 14)[i]
