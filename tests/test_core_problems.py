"""Hierarchies, eager aggregation, faulty lines: against brute force on small inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.operators import hierarchy
from corpusq.operators.eager_aggregate import eager_join_aggregate
from corpusq.operators.hierarchy import contract, resolve_hierarchy
from corpusq.operators.latest import latest_valid
from corpusq.sources.delimited import TOKEN_LINES, Format, accepted, assemble_records, parse, read_delimited, rejected, split_lines


def brute(parent):
    """node -> path to the root, None on or below a cycle."""
    out = {}
    for v in parent:
        path, seen, x = [], set(), v
        while x is not None and x not in seen:
            seen.add(x)
            path.append(x)
            x = parent[x] if parent[x] in parent else None
        out[v] = path if x is None else None
    return out


def forest(rng, n):
    kind = rng.choice(["random", "chain", "star", "tree"])
    if kind == "chain":
        return {i: (i - 1 if i else None) for i in range(n)}
    if kind == "star":
        return {i: (0 if i else None) for i in range(n)}
    if kind == "tree":
        return {i: (rng.randrange(i) if i else None) for i in range(n)}
    return {i: rng.choice([None, *range(n + 2)]) for i in range(n)}


def test_contract_equals_walking():
    rng = random.Random(5)
    for _ in range(300):
        p = forest(rng, rng.randrange(1, 60))
        want = brute(p)
        r = contract(np.array([-1 if p[i] is None or p[i] not in p else p[i] for i in range(len(p))]), paths=True)
        for v, path in want.items():
            assert r["path"][v] == path
            assert r["root"][v] == (-1 if path is None else path[-1])
            if path is not None:
                assert r["depth"][v] == len(path) - 1
                assert r["below"][v] == sum(q is not None and v in q[1:] for q in want.values())


def test_deep_chain_needs_few_rounds():
    n = 200_000
    r = contract(np.arange(-1, n - 1))
    assert r["depth"][-1] == n - 1 and r["below"][0] == n - 1


@pytest.mark.parametrize("max_local", [10**6, 5])
def test_local_and_distributed(spark, max_local):
    rng = random.Random(8)
    groups = {g: forest(rng, rng.randrange(1, 14)) for g in range(6)}
    rows = [(g, v, p, f"r{v}", "x") for g, f in groups.items() for v, p in f.items()]
    rows += [(None, 1, 2, "a", "x"), (1, None, 2, "a", "x"), rows[0]]
    df = spark.createDataFrame(rows, "g int, v int, p int, l string, word string")
    got = {(r.g, r.v): r for r in resolve_hierarchy(df, "g", "v", "p", "l", max_local=max_local).collect()}
    assert len(got) == sum(map(len, groups.values()))
    for g, f in groups.items():
        want = brute(f)
        for v, path in want.items():
            r = got[g, v]
            assert r.path == path and r.cyclic == (path is None) and r.word == "x"
            assert r.labels == (None if path is None else [f"r{x}" for x in path])
            assert r.root == (path and path[-1])
            assert r.depth == (None if path is None else len(path) - 1)
            assert r.n_below == (None if path is None else sum(q is not None and v in q[1:] for q in want.values()))


def test_hierarchy_of_strings_across_batches(spark, monkeypatch):
    rows = [(f"g{i % 40}", f"n{i // 40:03d}", f"n{i // 40 - 1:03d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v string, p string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = resolve_hierarchy(df, "g", "v", "p", paths=False).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.depth == int(r.v[1:]) and r.root == "n000" for r in got) and len(got) == 4000


def test_hierarchy_empty_and_clash(spark):
    df = spark.createDataFrame([], "g int, v int, p int")
    assert resolve_hierarchy(df, "g", "v", "p").count() == 0
    with pytest.raises(ValueError):
        resolve_hierarchy(df.withColumn("root", F.lit(1)), "g", "v", "p")
    assert hierarchy.MAX_LOCAL > 1


def test_eager_equals_join(spark):
    rng = random.Random(2)
    key = lambda: rng.choice(["hot", "hot", "hot", None, "b", "c"])
    a = [(key(), rng.choice("xy"), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    b = [(key(), rng.choice("uv"), rng.choice([None, 5, 7])) for _ in range(50)]
    left = spark.createDataFrame(a, "k string, g string, s long")
    right = spark.createDataFrame(b, "k string, h string, t long")
    for how in ("inner", "left", "full"):
        plain = left.join(right, "k", how).groupBy("g", "h").agg(F.count("*").alias("n_rows"), F.sum("s").alias("sum_s"), F.sum("t").alias("sum_t"))
        got = eager_join_aggregate(left, right, ["k"], ["g"], ["h"], ["s"], ["t"], how)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))
        if how != "full":
            salted = eager_join_aggregate(left, right, ["k"], ["g"], ["h"], ["s"], ["t"], how, salts=3)
            assert Counter(map(tuple, salted.collect())) == Counter(map(tuple, plain.collect()))
    keyed = {r.k: (r.n_rows, r.n_left, r.n_right) for r in eager_join_aggregate(left, right, ["k"], how="full", by_key=True).collect()}
    n, m = Counter(x[0] for x in a), Counter(x[0] for x in b)
    assert keyed == {k: (n[k] * m[k] if k is not None and n[k] and m[k] else n[k] + m[k], n[k] or None, m[k] or None) for k in n.keys() | m.keys()}
    with pytest.raises(ValueError):
        eager_join_aggregate(left, right, ["k"], how="full", salts=2)
    assert eager_join_aggregate(left.limit(0), right, ["k"], ["g"]).count() == 0


def test_many_long_paths_at_once(spark, monkeypatch):
    """Chains whose squares pass the bound are solved a few at a time; longer ones by joins."""
    monkeypatch.setattr(hierarchy, "MAX_SQUARES", 1000)
    rows = [(g, i, i - 1) for g in range(9) for i in range(25)]
    got = resolve_hierarchy(spark.createDataFrame(rows, "g int, v int, p int"), "g", "v", "p", max_local=25).collect()
    assert len(got) == 225 and all(r.path == list(range(r.v, -1, -1)) for r in got)


def test_latest(spark):
    rows = [(1, "a", "2024-01-01"), (1, "b", "2024-01-02"), (2, "c", None), (2, "d", "2024-01-01"), (3, None, "2024-01-01"), (3, None, "2024-01-01"), (None, "z", "2024-01-01")]
    df = spark.createDataFrame(rows, "k int, v string, t string").withColumn("ingested_at", F.to_timestamp("t")).drop("t")
    assert {(r.k, r.v) for r in latest_valid(df, "k").collect()} == {(1, "b"), (2, "d"), (3, None)}


GOOD = 's-1,1,the,the,DET,DT,_,3,det,_,_'
LINES = [
    (GOOD, None), ('"s,1",2,"a ""b""",_,PUNCT,"," ,_,3,det,_,_', "quoting"), ('"s,1",2,"a ""b""",_,PUNCT,",",_,3,det,_,_', None),
    ('s-1,1,po"rt,the,DET,DT,_,3,det,_,_', "quoting"), ('s-1,1,"open,the,DET,DT,_,3,det,_,_', "quoting"), ('s-1,1,"x"y,the,DET,DT,_,3,det,_,_', "quoting"),
    ('s-1,1, "x",the,DET,DT,_,3,det,_,_', "quoting"), ("", "column_count"), (None, "column_count"), ("a,b", "column_count"), (GOOD + ",", "column_count"),
    ("_,1,the,the,DET,DT,_,3,det,_,_", "bad_value"), (" ,1,the,the,DET,DT,_,3,det,_,_", "bad_value"), ("s,01,the,the,DET,DT,_,3,det,_,_", "bad_value"),
    ("s,1-2,_,_,_,_,_,_,_,_,_", None), ("s,0.1,_,_,_,_,_,_,_,_,_", None), ("s,1.0,_,_,_,_,_,_,_,_,_", "bad_value"), ("s,1,,a,DET,_,_,1,_,_,_", "bad_value"),
    ("s,1,a,a,Det,_,_,1,_,_,_", "bad_value"), ("s,1,a,a,DET,_,_,²,_,_,_", "bad_value"), ("s,1,a\x85,a,DET,_,_,1,_,_,_", "bad_value"), ("s,1,a�,a,DET,_,_,1,_,_,_", "bad_value"),
    ("s,1,a\nb,a,DET,_,_,1,_,_,_", "bad_value"), ('s,1,"a\nb",a,DET,_,_,1,_,_,_', "bad_value"), ("s,1\n2", "column_count"), ("s,1,a,a,DET,_,_,1,_,_," + "x" * 200_000, None),
]


def test_reasons(spark):
    for line, want in LINES:
        assert parse(line, TOKEN_LINES)[1] == want or len(line) > 131_072, line
    df = spark.createDataFrame([(i, x, "kept") for i, (x, _) in enumerate(LINES)], "raw_id long, line string, note string")
    out = split_lines(df, "line", TOKEN_LINES)
    assert {r.raw_id: r.reason for r in out.collect()} == {i: w for i, (_, w) in enumerate(LINES)}
    assert rejected(out, TOKEN_LINES).columns == ["raw_id", "line", "note", "reason"]
    ok = {r.raw_id: r for r in accepted(out).collect()}
    assert ok[2].form == 'a "b"' and ok[2].lemma is None and ok[2].head == 3 and ok[14].form == "_" and ok[2].note == "kept"
    with pytest.raises(ValueError):
        split_lines(df.withColumn("head", F.lit(1)), "line", TOKEN_LINES)
    assert split_lines(df.limit(0), "line", TOKEN_LINES).count() == 0


def test_heads_beyond_bigint():
    line = "s,1,a,a,DET,_,_,{},_,_,_"
    head = lambda x: parse(line.format(x), TOKEN_LINES)[0][7]
    assert head("9223372036854775807") == 2**63 - 1 and head("0009") == 9 and head("9223372036854775808") is None and head("1" * 5000) is None


def brute_records(lines, most):
    out, at = [], 0
    while at < len(lines):
        end, quotes = at, 0
        while end < len(lines):
            quotes += (lines[end][1] or "").count('"')
            end += 1
            if quotes % 2 == 0:
                break
        part = lines[at:end]
        out += [(o, x or "") for o, x in part] if len(part) > most else [(part[0][0], "\n".join(x or "" for _, x in part))]
        at = end
    return out


def test_records_over_several_lines(spark, tmp_path):
    rng = random.Random(7)
    files = {f"f{i}": [(k, rng.choice(["a,b", 'a,"b', 'c",d', '"x""y"', "", None, 'z,"'])) for k in range(rng.randrange(1, 30))] for i in range(6)}
    files["open"] = [(0, "a"), (1, 'b,"'), *[(k, "c") for k in range(2, 40)]]
    rows = [(f, k, x) for f, lines in files.items() for k, x in lines]
    rng.shuffle(rows)
    got = assemble_records(spark.createDataFrame(rows, "f string, k int, x string"), "f", "k", "x", max_lines=9).collect()
    assert sorted((r.f, r.k, r.x) for r in got) == sorted((f, k, x) for f, lines in files.items() for k, x in brute_records(lines, 9))
    assert assemble_records(spark.createDataFrame([], "f string, k int, x string"), "f", "k", "x").count() == 0
    (tmp_path / "a.csv").write_text('s-1,1,"two\nlines",x\n"a ""b""",2,c,d\n1,2\n', encoding="utf-8")
    fmt = Format(columns=("s", "n", "form", "more"))
    read = read_delimited(spark, str(tmp_path), fmt).orderBy("record_no").collect()
    assert [(r.s, r.form, r.reason) for r in read] == [("s-1", "two\nlines", None), ('a "b"', "c", None), (None, None, "column_count")]
