"""Command line: index, search, search-dataset, answer, answer-dataset, evaluate, serve."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from spanforge.engine import Engine, dumps
from spanforge.runtime import use_checkpoint_dir


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanforge")
    p.add_argument("--index-path", default="spanforge-index")
    p.add_argument("--checkpoint-dir", help="folder shared by all executors; by default one below the index")
    p.add_argument("--cache-path", help="file that keeps the results of single queries")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, k: int | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        if k is not None:
            c.add_argument("--k", type=int, default=k)
            c.add_argument("--hybrid", action="store_true")
        return c

    c = command("index", "corpus")
    c.add_argument("--max-chunk-size", type=int, default=2000)
    c.add_argument("--incremental", action="store_true")
    c.add_argument("--with-vectors", action="store_true")
    c.add_argument("--max-docs", type=int, help="embed only the first so many chunks")
    command("search", "query", k=10).add_argument("--doc-type", choices=["docs", "code"])
    command("search-dataset", "dataset", "output", k=10).add_argument("--doc-type", choices=["docs", "code"])
    command("answer", "query", k=5)
    command("answer-dataset", "results", "output")
    command("evaluate", "results", "dataset").add_argument("--max-context-length", type=int, default=2000)
    c = command("serve")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8000)
    return p


def run(engine: Engine, a: argparse.Namespace):
    if a.command == "index":
        return engine.index(a.corpus, a.max_chunk_size, a.incremental, a.with_vectors, a.max_docs)
    if a.command == "search":
        return engine.search(a.query, a.k, a.hybrid, a.doc_type)
    if a.command == "search-dataset":
        return engine.search_dataset(a.dataset, a.output, a.k, a.hybrid, a.doc_type)
    if a.command == "answer":
        return engine.answer(a.query, a.k, a.hybrid)
    if a.command == "answer-dataset":
        return engine.answer_dataset(a.results, a.output)
    if a.command == "evaluate":
        return engine.evaluate(a.results, a.dataset, a.max_context_length)
    from spanforge.service import serve

    return serve(engine, a.host, a.port)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spanforge").getOrCreate()
    use_checkpoint_dir(spark, a.checkpoint_dir or f"{a.index_path.rstrip('/')}/_work")
    out = run(Engine(spark, a.index_path, cache_path=a.cache_path), a)
    if out is not None:
        print(dumps(out))


if __name__ == "__main__":
    main()
