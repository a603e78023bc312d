"""Tables of a program are gone when it ends, also after spark.stop(); samples of many languages."""

import os
import subprocess
import sys

from timberline.llm import language

PROGRAM = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from timberline.llm import common, topk
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
assert common.components(edges).count() == 3
kept = common.written(edges)
import os
assert any("parquet" in f for _, _, fs in os.walk(sys.argv[1]) for f in fs)
if sys.argv[2] == "stop":
    spark.stop()
"""


def test_no_table_is_left(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for how in ("stop", "end"):
        folder = tmp_path / how
        folder.mkdir()
        subprocess.run([sys.executable, "-c", PROGRAM, str(folder), how], check=True, timeout=300, env=os.environ | {"PYTHONPATH": root}, capture_output=True)
        assert [f for _, _, fs in os.walk(folder) for f in fs] == []


def test_more_languages_than_the_sample_has_room_for(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_MOST", 60)
    monkeypatch.setattr(language, "BROADCAST_ROWS", 10)
    rows = [(i, f"{chr(0x4E00 + i % 40) * 20} text", f"l{i % 40:02d}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.sampled(docs.select("doc_id", "text", "lang"), 600)
    assert len(sample) == len({r[0] for r in sample}) == 40
    assert len(language.fit(docs).languages) == 40
    assert language.sampled(docs.limit(0), 600) == []
