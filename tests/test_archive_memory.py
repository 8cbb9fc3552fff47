"""Memory of the processes that pack archives: it must not grow with the rows of a task."""

import threading
import time

import psutil
from pyspark.sql import functions as F

from vellum.sources import archive


def workers():
    found = {}
    for p in psutil.Process().children(recursive=True):
        try:
            if "java" not in p.name():
                found[p.pid] = p.memory_info().rss - p.memory_info().shared
        except psutil.Error:
            pass
    return found


def test_packing_holds_few_rows(spark):
    maps = spark.range(6000, numPartitions=1).select(F.create_map(F.lit("a"), F.repeat(F.col("id").cast("string"), 6000)).alias("m"))  # some 140 MB of texts
    maps.limit(1).select(archive.packed("m").alias("z")).collect()
    peak, done = {}, threading.Event()

    def watch():
        while not done.is_set():
            for pid, size in workers().items():
                peak[pid] = max(peak.get(pid, 0), size)
            time.sleep(0.05)

    before, watcher = workers(), threading.Thread(target=watch)
    watcher.start()
    n, size = maps.select(F.length(archive.packed("m")).alias("n")).agg(F.count("n"), F.min("n")).first()
    done.set()
    watcher.join()
    assert n == 6000 and size > 0
    assert max(p - before.get(pid, 0) for pid, p in peak.items()) < 100e6
