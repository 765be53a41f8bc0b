from pyspark.sql import functions as F

from textloom.config import ScanConfig
from textloom.streaming import watch as W


def test_files_are_scanned_as_they_arrive(spark, tmp_path):
    src, out, mark = tmp_path / "src", tmp_path / "out", tmp_path / "mark"
    src.mkdir()
    (src / "a.py").write_text("x = eval(y)\n\nprint(z)\n")
    (src / "b.txt").write_text("eval(x)\n")
    config = ScanConfig(only=("python",))
    run = lambda: W.watch(W.arriving_files(spark, str(src)), str(out), str(mark), config).awaitTermination()
    run()
    assert {(r.path.rsplit("/")[-1], r.rule_id) for r in W.latest(spark, str(out)).collect()} == {("a.py", "python.eval"), ("a.py", "python.debug_output")}
    (src / "c.py").write_text("eval(q)  # noqa\nexcept:\n\nexcept:\n")
    run()
    found = W.latest(spark, str(out)).where("NOT suppressed").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.rule_id: r.n for r in found} == {"python.eval": 1, "python.debug_output": 1, "python.bare_except": 1}


def test_windowed_counts(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("eval(y)\neval(z)  # nolint\neval(w)\n")
    counted = W.stream_counts(W.arriving_files(spark, str(src)), ScanConfig(only=("python",)))
    query = counted.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.rule_id, r.n) for r in spark.table("windowed").select("rule_id", "n").collect()] == [("python.eval", 2)]
