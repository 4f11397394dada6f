"""The pipeline's stages against plain Python on a small table."""

import collections
import pathlib

import corpus_pipeline
from gridweave.llm import mixing, quality_rules
from gridweave.llm.common import Workspace, documents
from tests.llm.test_operators import ODD, classes, docs_of

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    work, docs = Workspace(spark, "test"), documents(spark, SMALL)
    inputs = [docs]
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = work.write(stage(spark, docs, SMALL), f"s{at}")
        inputs.append(docs)
    for d in inputs[:-1]:
        assert d.columns == inputs[0].columns
    rows = [[(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] for d in inputs[:-1]]
    all_docs, good, unique, distinct, mixed = rows

    ensemble = quality_rules.train(inputs[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    values = quality_rules.statistics(inputs[0]).select("doc_id", "_s.*").toPandas()
    scores = ensemble.scores(values[quality_rules.STATISTICS].to_numpy(float))
    assert sorted(d for d, _ in good) == sorted(values["doc_id"][scores >= 0.7])

    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\v\f\r")
    groups = collections.defaultdict(list)
    for d, t in good:
        groups[norm(t)].append((-len(t or ""), d))
    assert sorted(d for d, _ in unique) == sorted(min(g)[1] for g in groups.values())

    assert sorted(d for d, _ in distinct) == sorted({c for _, c in classes(unique, 5, 80)})

    taken = {r["doc_id"]: int(r["taken"] / max(r["size"], 1) + 0.5) for r in mixing.apportion_documents(inputs[3]).collect()}
    assert collections.Counter(d for d, _ in mixed) == collections.Counter({d: n for d, n in taken.items() if n})

    pieces = inputs[-1].collect()
    assert sum(r["length"] for r in pieces if r["start"] >= 0) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
    assert collections.Counter(r["doc_id"] for r in pieces if r["start"] == 0) == collections.Counter(d for d, _ in mixed)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def keys(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_on_odd_rows(spark, tmp_path):
    docs = docs_of(spark, ODD + [(20, "a b c d e"), (20, "a  b c d e"), (21, " ".join(f"n{i}" for i in range(40))), (22, " ".join(f"n{i}" for i in range(1, 40)))])
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\v\f\r")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SMALL)
        if name == "pack":
            assert got.where("start = 0").count() == docs.count() and got.agg({"length": "sum"}).first()[0] == got.where("start = 0").agg({"doc_tokens": "sum"}).first()[0]
            break
        assert got.columns == docs.columns
        assert set(keys(got)) <= set(keys(docs))
        assert name == "mix" or keys(got) <= keys(docs)
        if name == "exact dedup":
            assert collections.Counter(norm(t) for _, t in keys(got).elements()) == collections.Counter({norm(t) for _, t in keys(docs)})
        if name == "near dedup":
            rows = list(keys(docs).elements())
            empty = sum(not norm(t) for _, t in rows)
            assert got.count() == empty + len({c for (_, t), (_, c) in zip(rows, classes(rows, 5, 80), strict=True) if norm(t)})
        if name == "mix":
            assert max(keys(got)[k] / n for k, n in keys(docs).items()) <= 2


def test_stages_on_an_empty_table(spark):
    docs = docs_of(spark, ODD).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_stages_leave_no_tables(spark):
    root = pathlib.Path(Workspace(spark, "x").root.removeprefix("file://")).parent
    before = set(root.glob("*")) if root.exists() else set()
    corpus_pipeline.run(spark, SMALL).count()
    assert [(p.name.split("-")[0], sorted(s.name for s in p.iterdir())) for p in set(root.iterdir()) - before] == [("pipeline", ["stage-4"])]
