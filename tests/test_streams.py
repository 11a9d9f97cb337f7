"""Folders kept in step with a store, admission and rate limits, on small inputs with a plain version beside them."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from gleanery.operators import usage as batch
from gleanery.sources import files
from gleanery.streaming import folders, usage


def put(folder: Path, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        if text is None:
            path.unlink()
        else:
            path.write_text(text)


def state(spark, root):
    return {r.relative: (r.status, r.stored, r.same_as, r.kind, r.batch) for r in folders.ledger(spark, root).collect()}


def chunks(spark, root):
    return sorted((r.document_id, r.text) for r in folders.current_chunks(spark, root).collect())


def test_folder_passes(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "root")
    put(folder, a_md="first", b__c_txt="twin", b__d_txt="twin", e_txt=" \n", f_pdf="x", g_exe="x", h_txt="to go")
    assert chunks(spark, root) == [] and state(spark, root) == {}
    assert folders.sync(spark, str(folder), root, 0)
    assert state(spark, root) == {
        "a.md": ("new", True, None, None, 0), "b/c.txt": ("new", True, None, None, 0), "b/d.txt": ("copy", False, "b/c.txt", None, None),
        "e.txt": ("failed", False, None, "no_text", None), "f.pdf": ("failed", False, None, "unreadable", None), "h.txt": ("new", True, None, None, 0),
    }
    assert chunks(spark, root) == [("a.md", "first"), ("b/c.txt", "twin"), ("h.txt", "to go")]
    put(folder, a_md="first, but longer", h_txt=None, b__c_txt=None, e_txt="filled now")
    # what a pass that broke off had written doesn't count, and is written over
    spark.createDataFrame([("a.md", 0, "half", 0, 4, 1, "text")], folders.CHUNKS).write.parquet(f"{root}/chunks/batch=1")
    assert chunks(spark, root)[0] == ("a.md", "first")
    assert folders.sync(spark, str(folder), root, 1) and not folders.sync(spark, str(folder), root, 1)
    now = state(spark, root)
    assert now["a.md"] == ("changed", True, None, None, 1) and now["e.txt"] == ("changed", True, None, None, 1) and now["h.txt"][0] == now["b/c.txt"][0] == "gone"
    assert now["b/d.txt"][:3] in {("new", True, None), ("changed", True, None)} and now["f.pdf"] == ("failed", False, None, "unreadable", None)
    assert chunks(spark, root) == [("a.md", "first, but longer"), ("b/d.txt", "twin"), ("e.txt", "filled now")]
    assert folders.sync(spark, str(folder), root, 2, stored=spark.createDataFrame([("a.md",), ("e.txt",)], "document_id string"))
    now = state(spark, root)
    assert now["a.md"] == ("unchanged", True, None, None, 1) and now["b/d.txt"] == ("changed", True, None, None, 2) and "h.txt" not in now  # forgotten in the store, so stored again
    assert folders.vacuum(spark, root) == [0] and len(chunks(spark, root)) == 3


def test_folder_that_is_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert folders.sync(spark, str(tmp_path / "in"), str(tmp_path / "root"), 0)
    row = folders.sync_status(folders.ledger(spark, str(tmp_path / "root"))).first()
    assert (row.state, row.files_found, row.not_indexed, row.not_indexed_files, row.copies) == ("ready", 0, 0, [], [])


def test_watch_restarts(spark, tmp_path):
    folder, root, ticks = tmp_path / "in", str(tmp_path / "root"), tmp_path / "ticks"
    ticks.mkdir()
    for n in range(2):
        put(folder, **{f"f{n}_txt": f"text {n}"})
        (ticks / f"{n}.txt").write_text("tick")
        seen = []
        folders.watch(spark.readStream.text(str(ticks)), str(folder), root, str(tmp_path / "state"), after=seen.append).awaitTermination()
        assert seen == [n] and len(chunks(spark, root)) == n + 1


def test_write_files_again_and_away(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.txt", b"1"), ("b.txt", b"2")], "relative string, content binary")
    files.write_files(rows, str(tmp_path))
    files.write_files(rows.withColumn("content", F.when(F.col("relative") == "b.txt", F.lit(b"3"))), str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.rglob("*.txt")} == {"b.txt": b"3"}


def test_tasks_list_and_read_folders(spark, tmp_path):
    """The driver's index names no file; a folder's name may come again in its path, and tasks share what a join has found."""
    top = tmp_path / "in" / "x" / "in"
    texts = {"a.txt": b"1", "b.MD": b"", "in/\u00e9 %20#.txt": b"22", "_k=1/in/c.log": b"3", **{f"many/{i}.txt": b"%d" % i for i in range(40)}, **{f"large/{i}.txt": b"%d" % i * 5_000_000 for i in range(3)}}
    for name, content in {**texts, ".h.txt": b"4", ".h/a.txt": b"4", "_t/a.txt": b"4", "a.exe": b"4"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    (top / "none.txt").symlink_to(top / "nothing")
    (top / "self.txt").symlink_to(top / "self.txt")
    listing = files.list_folder(spark, str(top))
    found = files.scan_folder(spark, str(top))
    assert not [f for f in [*listing.inputFiles(), *found.inputFiles()] if str(top) in f]
    assert {r.relative: (r.path, r.size, bytes(r.content)) for r in found.collect()} == {n: (f"file:{top}/{n}", len(c), c) for n, c in texts.items()}
    at = {r.relative: r.modified for r in listing.withColumn("modified", F.unix_micros("modified")).collect()}
    assert at == {n: (top / n).stat().st_mtime_ns // 1_000_000 * 1000 for n in texts}
    wanted = listing.join(listing.select("relative").withColumn("x", F.lit(1)).hint("merge"), "relative")
    (top / "a.txt").unlink()
    read = files.read_files(spark, str(top), wanted).select("relative", F.spark_partition_id().alias("p")).collect()
    assert {r.relative for r in read} == texts.keys() - {"a.txt"} and len({r.p for r in read}) > 1


def test_folders_that_only_spark_reads(spark, tmp_path):
    put(tmp_path / "at", a_txt="1", b__c_md="two")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.gleanery.link./in", f"file://{tmp_path}")
    folder = "viewfs://gleanery/in/at"
    assert sorted((r.path, r.relative, r.size, bytes(r.content)) for r in files.scan_folder(spark, folder).collect()) == [(f"{folder}/a.txt", "a.txt", 1, b"1"), (f"{folder}/b/c.md", "b/c.md", 3, b"two")]
    assert files.read_files(spark, folder, files.list_folder(spark, folder).limit(0)).count() == 0


def test_empty_file_is_reported(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "root")
    put(folder, a_md="", b__c_txt="text")
    assert folders.sync(spark, str(folder), root, 0)
    assert state(spark, root) == {"a.md": ("failed", False, None, "no_text", None), "b/c.txt": ("new", True, None, None, 0)}
    put(folder, a_md="filled")
    assert folders.sync(spark, str(folder), root, 1) and state(spark, root)["a.md"] == ("changed", True, None, None, 1)


def test_admission_over_ranges(spark):
    """One day has nearly all rows, with ties in time, refunds and missing costs."""
    rnd = random.Random(4)
    rows = [(i, datetime(2024, 1, 5) + timedelta(minutes=rnd.randrange(900)), rnd.choice([0.25, 1.5, -3.0, None])) for i in range(3000)] + [(9000 + i, datetime(2024, 1, 6), 1.0) for i in range(9)]
    log = spark.createDataFrame(rows, "id long, ts timestamp, cost double").repartition(5)
    want, spent = {}, {}
    for i, ts, cost in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = spent.get(ts.date(), 0) < 400
        spent[ts.date()] = spent.get(ts.date(), 0) + max(cost or 0, 0)
    got = batch.budget_admission(log, 400.0)
    assert got.columns == [*log.columns, "admitted"]
    assert {r.id: r.admitted for r in got.collect()} == want and 0 < sum(want.values()) < len(want)
    assert batch.budget_admission(log.limit(0), 1.0).count() == 0


class Held:
    """What a stateful processor asks of its handle."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentWatermarkInMs(self):
        return self.timers[0] if self.timers else 10**15


def test_rate_limit_state_expires():
    held, one = Held(), usage.Limiter(2, 60.0)
    one.init(held)
    out = pd.concat(one.handleInputRows(("c",), iter([pd.DataFrame({"id": [1, 2], "at": [0.0, 1.0]}), pd.DataFrame({"id": [3, 4], "at": [2.0, 60.5]})]), held))
    assert out.admitted.tolist() == [True, True, False, True]
    assert [t for (t,) in held.rows] == [1.0, 60.5] and held.timers == [120_501]
    list(one.handleExpiredTimer(("c",), held, None))
    assert held.rows == [] and held.timers == []


def test_rate_limit_stream_is_the_batch_one(spark, tmp_path):
    rnd = random.Random(6)
    rows = sorted((datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(2000)), i, rnd.choice("abc")) for i in range(600))
    log = spark.createDataFrame([(i, ts, c, 1.0) for ts, i, c in rows], usage.LOG)
    cut = rows[300][0]
    for part in (log.filter(F.col("ts") < F.lit(cut)), log.filter(F.col("ts") >= F.lit(cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    arriving = spark.readStream.schema(usage.LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    with usage.rocks(spark):
        got = usage.replayed(usage.rate_limit(arriving, 5, 60.0), "rate", str(tmp_path / "state"))
    want = batch.rate_limit(log.withColumnRenamed("owner", "client"), 5, 60.0)
    assert sorted(map(tuple, got.collect())) == sorted((r.id, r.admitted) for r in want.collect())
