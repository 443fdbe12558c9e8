import corpus_pipeline
from chronolake.llm import quality
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("crc32(CAST(doc_id AS string)) % 5 <> 0")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.3}
    rows = [(r.doc_id, r.text) for r in good.collect()]
    once = stages[1](spark, good, SF).cache()
    want = {i for i, keep, *_ in brute.exact(rows) if i == keep}
    assert once.columns == columns and {r.doc_id for r in once.collect()} == want
    rows = [(r.doc_id, r.text) for r in once.collect()]
    single = stages[2](spark, once, SF).cache()
    want = {i for i, _, component, _ in brute.near(rows) if i == component}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == want
    rows = [(r.doc_id, r.text) for r in single.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages[3](spark, single, SF).cache()
    want = {r[0] for r in brute.decontaminated(rows, bench) if not r[-1]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want
    pieces = stages[4](spark, clean, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == want
    assert pieces.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_null_ids_go_through_the_stages_after_the_classifier(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 12").first().text
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (None, " ".join(f"b{i}" for i in range(40))), (None, " ".join(f"c{i}" for i in range(40)) + " " + bench)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF).cache()
        assert {tuple(r) for r in docs.collect()} == set(rows if name != "decontamination" else rows[:2])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.pack(spark, docs, SF).collect()) == ["1", "None"]


def test_run_over_nulls_and_over_an_empty_table(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    for name, docs in (("odd", source.limit(60).unionByName(source.limit(3).selectExpr(*[f"CAST(NULL AS {t}) AS {c}" for c, t in source.dtypes]))), ("empty", source.limit(0))):
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{other}.parquet").write.parquet(f"{tmp_path}/{name}/{other}.parquet")
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len({r.doc_id for r in pieces}) > 20 if name == "odd" else not pieces
