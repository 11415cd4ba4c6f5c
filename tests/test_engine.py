import json
import os
import threading
import urllib.request

import pytest

from spanforge.__main__ import parser, run
from spanforge.engine import Engine
from spanforge.operators.cache import QueryCache
from spanforge.runtime import shared_dir
from spanforge.service import respond, server
from spanforge.sources.corpus import CorpusSource, list_corpus, read_corpus
from spanforge.sources.datasets import read_questions
from spanforge.streaming.ingest import stream_postings, windowed_counts

FILES = {
    "pkg/__init__.py": "VERSION = 1\n",
    "pkg/pump.py": 'def start_pump(rate):\n    """Start the water pump."""\n    return rate\n',
    "docs/guide.md": "# Pump guide\n\nThe pump moves water through the valve into the tank below.\n",
    "CMakeLists.txt": "add_library(pump pump.c) # builds the pump library for all targets\n",
    "_hidden/.note.txt": "A valve note that is long enough to be kept as one chunk.\n",
    "skip.json": "{}",
}


@pytest.fixture
def corpus(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "corpus")


def test_corpus_source(spark, corpus):
    with open(f"{corpus}/bad.md", "wb") as f:
        f.write(b"a\xffb\r\nc\r")
    rows = {os.path.relpath(r.file_path, corpus): r for r in read_corpus(spark, corpus, partition_bytes=10).collect()}
    spark.dataSource.register(CorpusSource)
    other = spark.read.format("corpus").option("partitionBytes", "10").load(corpus).collect()
    assert sorted(map(str, other)) == sorted(map(str, rows.values()))
    walked = list_corpus(spark, corpus, walkers=2).collect()
    assert sorted(r.file_path for r in walked) == sorted(r.file_path for r in other) and len({r.file_path for r in walked}) == len(walked)
    assert set(rows) == set(FILES) - {"skip.json"} | {"bad.md"}
    assert rows["bad.md"].text == "a�b\nc\n" and len(rows["bad.md"].hash) == 64
    with pytest.raises(Exception, match="nowhere"):
        read_corpus(spark, f"{corpus}/nowhere").collect()


def test_index_search_update(spark, corpus, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index")
    with pytest.raises(FileNotFoundError):
        engine.search("pump")
    assert engine.index(corpus, with_vectors=True) == {"added": 5, "modified": 0, "deleted": 0}
    found = engine.search("start_pump rate", k=3)
    assert found[0]["file_path"].endswith("pump.py") and engine.search("start_pump rate", k=3) == found
    assert engine.cache.hits == 1 and engine.search("pump", k=0) == [] == engine.search("  ")
    assert engine.search("pump guide", 1, doc_type="docs")[0]["file_path"].endswith("guide.md")
    assert engine.search("water valve tank", 2, hybrid=True)
    before = engine.store.version()
    assert sum(engine.index(corpus, incremental=True).values()) == 0 and engine.store.version() == before

    with open(f"{corpus}/docs/guide.md", "a") as f:
        f.write("\n# Turbine\n\nThe turbine drives the pump whenever the river is high enough.\n")
    os.utime(f"{corpus}/docs/guide.md", (1, 1))
    os.remove(f"{corpus}/CMakeLists.txt")
    assert engine.index(corpus, incremental=True) == {"added": 0, "modified": 1, "deleted": 1}
    fresh = Engine(spark, f"file://{tmp_path}/fresh")
    fresh.index(corpus, with_vectors=True)
    for table in ("chunks", "postings", "term_stats", "corpus_stats", "counts", "registry", "vectors"):
        a, b = (sorted(map(str, e.store.table(table).select(*sorted(e.store.table(table).columns)).collect())) for e in (engine, fresh))
        assert a == b, table
    assert engine.search("turbine", 1)[0]["file_path"].endswith("guide.md")

    source = {"file_path": f"{corpus}/docs/guide.md", "first_character_index": 0, "last_character_index": 70}
    data = {"rag_questions": [{"question_id": "a", "question": "What moves water through the valve?", "sources": [source], "answer": "x"}, {"question_id": "b", "question": "zzz"}]}
    path = f"{tmp_path}/dataset_docs.json"
    with open(path, "w") as f:
        json.dump(data, f)
    args = parser().parse_args(["search-dataset", path, f"{tmp_path}/results.json", "--k", "3"])
    run(engine, args)
    out = json.load(open(f"{tmp_path}/results.json"))
    assert out["k"] == 3 and [r["question_id"] for r in out["search_results"]] == ["a", "b"] and out["search_results"][1]["retrieved_sources"] == []
    assert engine.evaluate(f"{tmp_path}/results.json", path)["Recall@3"] == 1.0
    engine.answer_dataset(f"{tmp_path}/results.json", f"{tmp_path}/answers.json")
    answers = json.load(open(f"{tmp_path}/answers.json"))["search_results"]
    assert "pump" in answers[0]["answer"]
    assert "pump" in engine.answer("What moves water?") and engine.health()["semantic_index"]

    http = server(engine, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    body = json.dumps({"query": "turbine", "k": 1}).encode()
    reply = json.load(urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/search", body))
    assert reply["retrieved_sources"][0]["file_path"].endswith("guide.md")
    http.shutdown()
    assert respond(engine, "POST", "/search", {"query": 1})[0] == 422 and respond(engine, "GET", "/x", {})[0] == 404
    assert respond(Engine(spark, f"file://{tmp_path}/none"), "GET", "/health", {})[0] == 500

    kept = Engine(spark, engine.root, cache_path=f"{tmp_path}/cache.json")
    assert kept.search("turbine", 1) == engine.search("turbine", 1)
    again = Engine(spark, engine.root, cache_path=f"{tmp_path}/cache.json")
    assert again.search("turbine", 1) == engine.search("turbine", 1) and again.cache.hits == 1
    folder = shared_dir(spark).removeprefix("file://") + "/spanforge"
    left = set(os.listdir(folder))
    again.search("water", 2), again.answer("What moves water?")
    assert set(os.listdir(folder)) == left  # nothing of a search stays behind


def test_questions_file(spark, tmp_path):
    path = f"{tmp_path}/q.json"
    with open(path, "w") as f:
        json.dump({"rag_questions": [{"question": "x"}, {"question_id": "k", "question": "y", "sources": [], "answer": "z"}]}, f)
    rows = {r.question: r for r in read_questions(spark, path).collect()}
    assert rows["x"].question_id and rows["x"].sources is None and rows["y"].answer == "z"


def test_cache(tmp_path):
    path = f"{tmp_path}/c.json"
    c = QueryCache(2, path)
    for k in "abc":
        c.set(k, [k])
    assert c.get("a") is None and c.get("b") == ["b"] and len(c) == 2
    c.set("d", [])
    assert c.get("c") is None and QueryCache(2, path).get("d") == []
    key = QueryCache.key
    assert key("v", " q ", k=1) == key("v", "q", k=1) != key("v", "Q", k=1) and key("w", "q", k=1) != key("v", "q", k=1)


def test_streams(spark, tmp_path):
    rows = [(1, "a.py", "alpha beta", "s", "2025-01-01 00:10:00"), (2, "b.py", "alpha", "s", "2025-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "chunk_id long, file_path string, text string, source string, t string").selectExpr("*", "cast(t as timestamp) ingested_at").drop("t")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    stream_postings(stream.select("chunk_id", "file_path", "text"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/*").where("term = 'alpha'").count() == 2
    counts = windowed_counts(stream)
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.documents, r.chars) for r in spark.table("w").collect()] == [(2, 15)]
