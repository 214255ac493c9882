"""The index of a stream of pages is the same however the stream is cut into batches."""

import json
import random

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import retrieval
from ledgerloom.streaming import page_state


def _versions(r, n):
    out, names = [], [f"S{i}" for i in range(4)]
    for p in range(n):
        before = None
        for v in range(r.randint(1, 5)):
            body = "".join(f"## {s}\n\n{r.choice(['one', 'two', 'three'])} {p}\n" for s in r.sample(names, r.randint(0, 3)))
            markdown = r.choice([body, body, before, None])  # changed, the same again, gone
            out.append({"page_id": f"p{p}", "markdown": markdown, "version": v})
            before = markdown
    return out


def test_any_cut_of_the_stream_gives_the_batch_answer(spark, tmp_path):
    r = random.Random(8)
    rows = _versions(r, 30)
    newest = {}
    for x in rows:
        if x["page_id"] not in newest or x["version"] > newest[x["page_id"]]["version"]:
            newest[x["page_id"]] = x
    pages = spark.createDataFrame([(x["page_id"], x["markdown"]) for x in newest.values() if x["markdown"] is not None], "page_id string, markdown string")
    cut = retrieval.sections(pages, "page_id", "markdown")
    want = sorted(map(tuple, cut.select(text.point_id(F.col("page_id"), F.col("section")), "page_id", "section", "text").collect()))
    assert len(want) > 15
    for name, files, shuffled in (("whole", 1, False), ("parts", 6, False), ("mixed", 5, True)):
        own = list(rows)
        if shuffled:
            r.shuffle(own)  # versions that come late, and ones that come again
            own += own[:10]
        else:
            own.sort(key=lambda x: x["version"])
        folder = tmp_path / name / "in"
        folder.mkdir(parents=True)
        size = -(-len(own) // files)
        for i in range(files):
            (folder / f"{i:03d}.json").write_text("".join(json.dumps(x) + "\n" for x in own[i * size : (i + 1) * size]))
        table = f"{tmp_path}/{name}/table"
        page_state.follow(spark, str(folder), table, f"{tmp_path}/{name}/check", 1).awaitTermination()
        acted = spark.read.schema(page_state.ACTIONS).parquet(table)
        assert sorted(map(tuple, page_state.current(acted).select("id", "page_id", "section", "text").collect())) == want, name
        if name == "parts":
            assert acted.where("action = 'delete'").count() > 0
            n = acted.count()
            page_state.follow(spark, str(folder), table, f"{tmp_path}/{name}/check", 1).awaitTermination()  # nothing new
            assert spark.read.schema(page_state.ACTIONS).parquet(table).count() == n


def test_the_stream_of_documents_is_read_in_as_many_files_as_they_have(spark, tmp_path, monkeypatch):
    """Three files for any number of documents made each task of a batch read a third of them."""
    from ledgerloom.plans import query_index

    docs = spark.range(7000).selectExpr("id AS doc_id", "repeat('x', 3000) || id AS text", "'en' AS lang", "'src' || id % 4 AS source")
    docs.repartition(7).write.option("parquet.block.size", 1 << 20).parquet(str(tmp_path / "documents.parquet"))
    seen = []

    class Seen(Exception):
        pass

    def follow(spark, source, table, checkpoint, files_per_batch):
        seen.extend([spark.read.json(source).count(), len(spark.read.text(source).inputFiles()), files_per_batch])
        raise Seen

    monkeypatch.setattr(page_state, "follow", follow)
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # so that a task takes a file or two
    try:
        query_index.stream_points(spark, str(tmp_path))
    except Seen:
        pass
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows, files, batch = seen
    assert rows == 8750 and files > 3 and 3 * batch >= files > 2 * batch - 1
