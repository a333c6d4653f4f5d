"""Text files by the thousand: found and read in tasks, as Spark's reader would give them."""

from capsieve.sources import files
from pyspark.sql import functions as F


def test_texts_are_those_of_sparks_reader(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n, name in enumerate(["a.json", "b é%20 +#?.json", "_hidden.json", ".dot.json", "empty.json", "sub/c.json", "d.txt", "[e].json"]):
        (tmp_path / name).write_bytes(b"" if name == "empty.json" else f'{{"n": {n}, "x": "é\u0085"}}\r\n'.encode() + b"\xff")
    for path in (str(tmp_path), f"{tmp_path}/*.json", f"{tmp_path}/*/*.json", f"{tmp_path}/[ab]*.json", f"{tmp_path}/{{a,d}}.*", [f"{tmp_path}/a.json", f"file://{tmp_path}/d.txt"]):
        spark_own = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
        key = lambda rows: sorted((r.source_file, r.h) for r in rows.selectExpr("source_file", "hex(value) AS h").collect())
        assert key(files.read_texts(spark, path)) == key(spark_own), path


def test_tasks_do_not_grow_with_the_files(spark, tmp_path):
    for n in range(700):
        (tmp_path / f"{n}.json").write_text(f'["/v/{n}.mp4"]')
    assert files.read_texts(spark, str(tmp_path)).rdd.getNumPartitions() <= 4
    assert files.read_exclusions(spark, str(tmp_path)).count() == 700
    assert len(files.read_texts(spark, str(tmp_path)).inputFiles()) == 0  # the driver holds no names
