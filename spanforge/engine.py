"""The engine as one object: index a corpus, search, answer, evaluate."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.spans import doc_type_of
from spanforge.operators import answer as A
from spanforge.operators import evaluate as E
from spanforge.operators import incremental as I
from spanforge.operators import retrieval as R
from spanforge.operators.cache import QueryCache
from spanforge.operators.index import LexicalIndex, build_index, chunk_corpus, term_counts
from spanforge.runtime import cut, freed
from spanforge.sources.corpus import read_corpus
from spanforge.sources.datasets import read_questions, read_results, write_results
from spanforge.sources.store import IndexStore


def _freeing(method):
    """Tables written on the way to a result that the method saves or collects go with it."""

    @functools.wraps(method)
    def run(*args, **kwargs):
        with freed():
            return method(*args, **kwargs)

    return run


@dataclass
class Engine:
    """``root`` is the folder of the versioned index. ``encoder`` and ``generator`` make the
    models of a worker task (see models); the defaults are stand-ins that need no model files.
    With ``cache_path`` results of single queries are kept in that file over sessions."""

    spark: SparkSession
    root: str
    encoder: Callable[[], R.Encoder] = lambda: R.hashed_encoder
    generator: Callable[[], A.Generator] = lambda: A.extractive_generator
    cache: QueryCache = field(default_factory=QueryCache)
    cache_path: str | None = None

    def __post_init__(self) -> None:
        if self.cache_path:
            self.cache = QueryCache(path=self.cache_path)
        self.store = IndexStore(self.spark, self.root)
        self._open: tuple[str, dict] | None = None

    # ------------------------------------------------------------ building

    @_freeing
    def index(self, corpus: str, max_chunk: int = 2000, incremental: bool = False, with_vectors: bool = False, max_docs: int | None = None) -> dict[str, int]:
        """Index a directory and publish a new version; counts of files added, modified and
        deleted. Incremental runs chunk and tokenise changed files only, embed them only, and
        publish nothing if nothing changed."""
        files = cut(read_corpus(self.spark, corpus), "files")
        old = incremental and self.store.version() is not None
        registry = self.store.registry() if old else self.store.registry().limit(0)
        changes = I.scan_changes_below(files, registry, self.store.table("tree")) if old and self.store.has("tree") else I.scan_changes(files, registry)
        counts = {r["change"]: r["files"] for r in I.change_counts(changes).collect()}
        if old and not any(counts.values()):
            return counts
        if old:
            index, terms, registry = I.update_index(files, registry, self.store.table("chunks"), self.store.table("counts"), max_chunk, changes)
        else:
            chunks = cut(chunk_corpus(files.withColumn("doc_id", F.xxhash64("file_path")), max_chunk), "chunks")
            terms = cut(term_counts(chunks), "counts")
            index, registry = build_index(chunks, terms), I.next_registry(files, registry, chunks, changes)
        registry = cut(registry, "registry")
        more = {"counts": terms, "registry": registry, "tree": I.registry_tree(registry), "files": files.select("file_path", "text")}
        if with_vectors or (old and self.store.has("vectors")):
            text = self._with_text(index.chunks, files)
            if old and self.store.has("vectors"):
                kept = self.store.table("vectors").join(index.chunks.select("chunk_id"), "chunk_id", "left_semi")
                new = text.join(kept.select("chunk_id"), "chunk_id", "left_anti")
                more["vectors"] = kept.unionByName(R.embed_chunks(new, self.encoder, max_docs))
            else:
                more["vectors"] = R.embed_chunks(text, self.encoder, max_docs)
        self.store.write_index(index, **more)
        return counts

    @staticmethod
    def _with_text(chunks: DataFrame, files: DataFrame) -> DataFrame:
        part = F.substring("text", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int"))
        return chunks.join(files.select("file_path", "text"), "file_path").withColumn("text", part)

    def _tables(self) -> tuple[str, dict]:
        version = self.store.version()
        if version is None:
            raise FileNotFoundError(f"no index at {self.root}")
        if self._open is None or self._open[0] != version:
            names = ("index", "files", "vectors")
            tables = {"index": self._held(self.store.index(version)), "files": self.store.table("files", version)}
            tables["vectors"] = self.store.table("vectors", version) if self.store.has("vectors") else None
            self._open = version, {n: tables[n] for n in names}
        return self._open

    def _held(self, index: LexicalIndex) -> LexicalIndex:
        """The index with its one row of totals at hand instead of in a file."""
        totals = index.corpus_stats
        return replace(index, corpus_stats=self.spark.createDataFrame(totals.collect(), totals.schema))

    # ------------------------------------------------------------ retrieval

    def search_all(self, questions: DataFrame, k: int = 10, hybrid: bool = False, doc_type: str | None = None, few: bool | None = None) -> DataFrame:
        """question_id, chunk_id, score, rank, file_path, first, last for a whole set at once.
        Hybrid search uses no document type."""
        _, t = self._tables()
        asked = questions.where(F.trim("question") != "")
        if hybrid:
            encoded = R.embed(asked, "question_id", F.col("question"), self.encoder)
            ranked = R.hybrid_search(t["index"], t["vectors"], asked, encoded, k, few)
        else:
            ranked = R.bm25_search(t["index"], asked, k, doc_type=F.lit(doc_type) if doc_type else None, few=few)
        return R.resolve(ranked, t["index"].chunks)

    @staticmethod
    def _few(query: str) -> bool | None:
        return True if len(query) <= R.PUSHED_CHARS else None

    @_freeing
    def search(self, query: str, k: int = 10, hybrid: bool = False, doc_type: str | None = None) -> list[dict]:
        """Ranked sources of one query, cached per index version."""
        if k <= 0 or not query.strip():
            return []
        version, _ = self._tables()
        key = QueryCache.key(version, query, k=k, hybrid=hybrid, doc_type=doc_type)
        rows = self.cache.get(key)
        if rows is None:
            q = self.spark.createDataFrame([("q", query)], "question_id string, question string")
            found = self.search_all(q, k, hybrid, doc_type, self._few(query)).orderBy("rank").collect()
            rows = [{"file_path": r["file_path"], "first_character_index": r["first"], "last_character_index": r["last"]} for r in found]
            self.cache.set(key, rows)
        return rows

    @_freeing
    def search_dataset(self, dataset: str, output: str, k: int = 10, hybrid: bool = False, doc_type: str | None = None) -> None:
        """Search all questions of a data set file and write one results file. Without a
        ``doc_type`` the data set's name may tell it."""
        questions = read_questions(self.spark, dataset)
        name = dataset.rstrip("/").rpartition("/")[2]
        inferred = doc_type or self.spark.range(1).select(doc_type_of(F.lit(name))).head()[0]
        write_results(R.nested_results(self.search_all(questions, k, hybrid, inferred), questions), output, k)

    # ------------------------------------------------------------ answers

    def _answers(self, questions: DataFrame, ranked: DataFrame) -> DataFrame:
        _, t = self._tables()
        few = ranked.where(F.col("rank") <= 3).select("chunk_id").distinct()
        text = self._with_text(t["index"].chunks.join(few, "chunk_id", "left_semi"), t["files"])
        return A.generate_answers(A.prompts(questions, A.contexts(ranked, text)), self.generator)

    @_freeing
    def answer(self, query: str, k: int = 5, hybrid: bool = False) -> str:
        if k <= 0 or not query.strip():
            return A.NO_CONTEXT
        q = self.spark.createDataFrame([("q", query)], "question_id string, question string")
        return self._answers(q, self.search_all(q, k, hybrid, few=self._few(query))).head()["answer"]

    @_freeing
    def answer_dataset(self, results: str, output: str) -> None:
        """Answer the questions of a results file from its sources; the same file with answers."""
        _, t = self._tables()
        flat = read_results(self.spark, results)
        ids = t["index"].chunks.groupBy("file_path", "first", "last").agg(F.min("chunk_id").alias("chunk_id"))
        ranked = flat.join(ids, ["file_path", "first", "last"])
        questions = flat.select("question_id", "question").distinct()
        nested = R.nested_results(flat, questions)
        k = flat.agg(F.coalesce(F.max("rank"), F.lit(0))).head()[0]
        write_results(nested.join(self._answers(questions, ranked).select("question_id", "answer"), "question_id"), output, k)

    @_freeing
    def evaluate(self, results: str, dataset: str, max_length: int = 2000) -> dict[str, float]:
        hits = E.hit_ranks(read_results(self.spark, results), E.truth(read_questions(self.spark, dataset)), max_length)
        return {f"Recall@{r['cut']}": r["recall"] for r in E.recall(hits).orderBy("cut").collect()}

    def health(self) -> dict:
        _, t = self._tables()
        n = t["index"].corpus_stats.head()["n"]
        return {"status": "ok", "indexed_documents": n, "lexical_index": True, "semantic_index": t["vectors"] is not None}


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
