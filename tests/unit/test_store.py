"""A store of pages as a format of Spark."""

import json

from siltstone.operators import retrieval
from siltstone.sources import store

#: A client for executors: it writes down what is asked of the store.
WATCHED = """
import json
from siltstone.sources.store import Pages

class Watched(Pages):
    def __init__(self, options):
        super().__init__(options)
        self.log = options["log"]

    def scroll(self, part, cursor, limit, columns, equal):
        with open(f"{self.log}/asked", "a") as f:
            f.write(json.dumps([columns, equal, limit]) + chr(10))
        return super().scroll(part, cursor, limit, columns, equal)
"""


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_scan_by_parts_and_pages(spark, tmp_path):
    folder = tmp_path / "store"
    assert store.scanned(spark, str(folder)).count() == 0
    for p in range(3):
        put(folder, f"page-{p}.jsonl", [{"doc_id": p * 100 + i, "text": f"t{i % 2}", "lang": "en" if i % 5 else "vi", "vector": [0.5, i]} for i in range(25)] + ["", "no json", "[1]"])
    rows = store.scanned(spark, str(folder), limit="10")
    assert rows.count() == 75 and rows.rdd.getNumPartitions() == 3 and rows.columns == ["doc_id", "text"]
    (tmp_path / "watched_store.py").write_text(WATCHED)
    spark.sparkContext.addPyFile(str(tmp_path / "watched_store.py"))
    wide = store.scanned(spark, str(folder), "doc_id long, lang string, vector array<double>, none string", limit="7", client="watched_store:Watched", log=str(tmp_path))
    got = wide.where("lang = 'vi' and doc_id > 100").collect()
    assert {r.doc_id for r in got} == {105, 110, 115, 120, 100 + 100, 205, 210, 215, 220} - {100} and got[0].none is None and got[0].vector[0] == 0.5
    asked = [json.loads(x) for x in (tmp_path / "asked").read_text().splitlines()]
    assert all(x == [["doc_id", "lang", "vector", "none"], {"lang": "vi"}, 7] for x in asked)
    assert retrieval.bm25(spark.createDataFrame([(1, "t1")], "item_id int, text string"), retrieval.corpus(rows), 3).count() == 3


def test_new_parts_are_a_stream(spark, tmp_path):
    folder, out, cp = tmp_path / "store", str(tmp_path / "out"), str(tmp_path / "cp")
    store.register(spark)
    for p in range(2):
        put(folder, f"page-{p}.jsonl", [{"doc_id": p * 10 + i, "text": "x"} for i in range(5)])
        stream = spark.readStream.format("store").load(str(folder))
        query = stream.writeStream.option("checkpointLocation", cp).format("parquet").start(out)
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(out).count() == 5 * (p + 1)
