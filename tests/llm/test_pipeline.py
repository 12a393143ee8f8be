"""The pipeline's stages against what each is to do with its own input."""

import os

import corpus_pipeline
from pyspark.sql import functions as F

from marlstone.llm import fertility, fm_index, group_join
from marlstone.llm.store import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "test-pipeline")
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, sf_dir), name)
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name == "quality_rules":
            kept = {r["doc_id"] for r in fertility.measure(docs).where("kept").collect()}
            assert set(after) == kept and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            assert set(after) == set(before)
            assert all(set((after[i] or "").split("\n")) <= {*before[i].split("\n"), ""} for i in after)
            assert out.where(F.char_length("text") != F.col("n_chars")).count() == docs.where(F.char_length("text") != F.col("n_chars")).count()
        elif name == "near_duplicates":
            groups = group_join.similar_groups(docs).collect()
            assert set(after) == {r["component_id"] for r in groups}
        elif name == "decontamination":
            bad = {r["doc_id"] for r in fm_index.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(fm_index.contaminated()).collect()}
            assert set(after) == set(before) - bad
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    assert {"rate", "copies"} <= set(docs.columns)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    last = {f.rsplit("/", 2)[1] for f in whole.inputFiles() if "/pipeline-" in f}
    folder = next(f for f in whole.inputFiles() if "/pipeline-" in f).rsplit("/", 2)[0].removeprefix("file:")
    assert last == set(os.listdir("/" + folder.lstrip("/")))  # tables that nothing reads any more are gone


def test_entry_without_the_subpackage(tmp_path):
    """__spark_entry__ imports, and has its other queries, where the folders are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sem_npl_ratio' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and no rows at all."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = source.schema
    clean = source.where("lang = 'en'").join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").select("doc_id", "text", "lang")
    plain = fertility.measure(clean).where("kept").orderBy("doc_id").first()["text"]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, plain, "en", "s", len(plain)), (3, plain, "en", "s", len(plain)), (None, plain, None, "s", None), (4, "x" * 200_000, "xx", None, 7), (5, " \n\t\n", "", "", 4)]
    named = {"doc_id": 0, "text": 1, "lang": 2, "source": 3, "n_chars": 4}
    docs = spark.createDataFrame([tuple(r[named[f.name]] for f in schema.fields) for r in rows], schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        found = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        ids = sorted((r["doc_id"] for r in found), key=str)
        expected = {"quality_rules": [3, 3, None], "line_dedup": sorted((r[0] for r in rows), key=str), "near_duplicates": sorted((r[0] for r in rows), key=str)}.get(name)
        assert expected is None or ids == sorted(expected, key=str), name


def test_stages_leave_the_callers_columns(spark, sf_dir):
    """Columns by the names of operators' own come out as they went in; the last stage's three give way to its own."""
    own = ("n_words", "script", "kept", "n_dropped", "N_LINES", "spans", "items", "n_hit", "component_id", "node", "posterior", "n_shingles", "Rate", "__own0")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in own})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        last = k == len(corpus_pipeline.STAGES) - 1
        kept = [c for c in own if not (last and c == "Rate")]
        assert out.columns == ([c for c in docs.columns if c != "Rate"] + ["n_tokens", "rate", "copies"] if last else docs.columns), name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in kept), name
