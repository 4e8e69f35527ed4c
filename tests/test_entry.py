"""Driver contract: entry() runs on sf0.001; every oracle names a registered query."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "text_chunk" in df.columns


def test_registry_consistency():
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs)
    assert len(qs) >= 70


def test_package_is_shipped_to_python_workers(spark):
    import os
    import zipfile

    from docweave.session import ship_package
    ship_package(spark)
    assert getattr(spark.sparkContext, "_docweave_shipped", False)
    files = spark.sparkContext._jsc.sc().listFiles()
    zips = [f for f in spark.sparkContext._jvm.scala.collection.JavaConverters.seqAsJavaList(files)
            if str(f).endswith("docweave.zip")]
    assert zips
    path = str(zips[0]).replace("file:", "")
    names = zipfile.ZipFile(path).namelist() if os.path.exists(path) else []
    assert not names or "docweave/operators/retrieval.py" in names


def test_core_queries_remain_when_the_optional_part_cannot_be_imported():
    import subprocess
    import sys
    code = ("import sys; sys.modules['{}'] = None; import __spark_entry__ as E; "
            "q = E.queries(); assert 'knn_exact' in q and 'pipeline' not in q, len(q); "
            "assert set(E.oracle_sql()) <= set(q)")
    for gone in ("public_tokenizers", "corpus_pipeline", "docweave.llm"):
        subprocess.run([sys.executable, "-c", code.format(gone)], check=True, cwd=E.__file__.rsplit("/", 1)[0])


def test_queries_run_with_bounded_arrow_batches(spark):
    import __spark_entry__ as E
    from pyspark.sql import functions as F
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set(names[0], "10000")       # Spark's own default, in a session that is given
    E._prepare(spark)
    assert int(spark.conf.get(names[0])) <= 1024 and int(spark.conf.get(names[1])) <= 4 << 20

    @F.pandas_udf("long")
    def size(s):
        return s.map(lambda _: len(s))

    assert spark.range(5000, numPartitions=1).select(size("id").alias("n")).agg(F.max("n")).first()[0] <= 1024
