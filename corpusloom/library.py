"""A document library in one folder: index files, ask questions, extract people, merge them, report.

Every table is Parquet under the library's folder, so that a run goes on where
the last one stopped.  Models are providers (``corpusloom.providers``); by
default nothing leaves the machine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import importable, providers
from corpusloom.functions import text as T
from corpusloom.operators import chunking, compression, entities, extraction, feedback, late, retrieval, state
from corpusloom.sources import files as SF
from corpusloom.sources import scratch
from corpusloom.sources.scratch import stored

STATE = "path string, hash string, status string, chunks_indexed long, error string, updated_at timestamp, context_version int"
GRAPH = "path string, status string, objects_extracted int, relationships_extracted int, error string, retry_count int, run int"
BIBLIOGRAPHY = "stem string, citekey string, title string, author string, date string, language string, type string"
CHUNKS = chunking.CHUNKS + ", context string, vector array<float>"


class Library:
    def __init__(self, spark: SparkSession, folder: str, embed: str = "offline") -> None:
        importable(spark)
        self.spark, self.folder, self.embed = spark, folder.rstrip("/"), providers.get("embed", embed)

    # --- tables ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, name: str, schema: str) -> DataFrame:
        if not self._files().exists(self._path(name)):
            # a swap that ended half-way: the old table stands aside
            name = f"{name}.old" if self._files().exists(self._path(f"{name}.old")) else name
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _save(self, df: DataFrame, name: str) -> None:
        """Replace a state table: write beside it, set the old one aside, move the new one in, drop the old one.

        Whenever this ends half-way, ``table`` finds the old or the new rows whole.
        """
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}.new")
        files, now, new, old = self._files(), *map(self._path, (name, f"{name}.new", f"{name}.old"))
        if files.exists(now):
            files.delete(old, True)
            self._moved(now, old)
        self._moved(new, now)
        files.delete(old, True)

    def _moved(self, a, b) -> None:
        if not self._files().rename(a, b):
            raise OSError(f"{a} could not be moved to {b}")

    # --- indexing ---

    def index(self, root: str, extensions: tuple[str, ...] = SF.STORE, pages: Callable[[DataFrame], DataFrame] | None = None, limit: int | None = None) -> int:
        """Index the files that are new or changed; their old chunks are replaced.  ``pages`` reads a format into ``path, page, text``.

        Every file read writes its partition, one without chunks a row without an id, so that none keeps chunks of an older text.
        """
        before = self.table("state", STATE)
        own = scratch.folder(self.spark, "library-index")
        # read and hashed once: what is indexed is what was hashed, whatever happens to a file meanwhile
        files = stored(SF.to_index(SF.collect(self.spark, root, extensions), before, limit), "files", within=own)
        if pages is None:
            pages = lambda f: f.select("path", F.lit(1).alias("page"), T.page_text(F.col("content").cast("string")).alias("text"))
        read = pages(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))
        whole = F.array_join(F.transform("pages", lambda p: p["text"]), "\n")
        docs = read.withColumn("lang", providers.get("language")(whole)).withColumnRenamed("path", "source_file_id")
        chunks = chunking.indexed_chunks(chunking.chunk(docs))
        name = F.element_at(F.split("source_file_id", "/"), -1)
        context = providers.get("context", "metadata")(title=F.lit(""), author=F.lit(None).cast("string"), year=F.lit(None).cast("int"), page=F.col("page_number"), pages=F.lit(None).cast("int"), file_name=name)
        chunks = chunks.withColumn("context", context)
        chunks = chunks.withColumn("vector", self.embed(T.embedded_text(F.col("context"), F.col("text"))))
        done = files.select("path", "hash")
        chunks = done.select("path").join(chunks, F.col("path") == F.col("source_file_id"), "left").withColumn("file", F.sha2("path", 256)).drop("path")
        (chunks.repartition("file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(f"{self.folder}/chunks"))
        counts = self.chunks().groupBy(F.col("source_file_id").alias("path")).agg(F.count("*").alias("chunks_indexed"))
        entry = done.join(counts, "path", "left").select("path", "hash", F.when(F.col("chunks_indexed").isNull(), "failed").otherwise("indexed").alias("status"), F.coalesce("chunks_indexed", F.lit(0)).alias("chunks_indexed"), F.when(F.col("chunks_indexed").isNull(), "no text").alias("error"), F.current_timestamp().alias("updated_at"), F.lit(1).alias("context_version"))
        n = entry.count()
        if n:
            self._save(state.upsert(before, entry), "state")
        scratch.drop(self.spark, own)
        return n

    def chunks(self) -> DataFrame:
        return self.table("chunks", CHUNKS).where("id is not null")

    def cite(self, items: DataFrame) -> None:
        """Keep a bibliography (as ``files.bibliography_index`` takes it): sources are then named by their title, author and year."""
        self._save(SF.bibliography_index(items), "bibliography")

    def _sources(self) -> DataFrame:
        """The chunks with the data of their files."""
        files = self.chunks().select("id", F.col("source_file_id").alias("path"), F.col("page_number").alias("page"), "context", "text")
        name = F.element_at(F.split("path", "/"), -1)
        cited = SF.with_bibliography(files, self.table("bibliography", BIBLIOGRAPHY))
        return cited.select("id", "page", "context", "text", name.alias("file_name"), F.when(F.col("zotero_key") == "", name).otherwise(F.col("title")).alias("title"), "author", "year")

    # --- questions ---

    def ask(self, questions: DataFrame, k: int = retrieval.K_CONTEXT, refine: bool = False) -> DataFrame:
        """``query_id``, ``question`` → the sources of each: ``place, title, author, year, page, rrf_score, text, passage``.

        ``refine`` also asks each question with the terms that its first passages add, pools both
        hypotheses, puts the best in order by late interaction, and cuts the passages to what they tell.
        """
        hyde = providers.get("expand")
        q = questions.select("query_id", F.explode(hyde(F.col("question"))).alias("question"))
        dense = retrieval.dense_leg(q.withColumn("vector", self.embed(F.col("question"))), self.chunks().select("id", "vector"))
        asked, index = retrieval.term_weights(q, "query_id", "question", "query_id"), retrieval.term_weights(self.chunks(), "id", "text")
        sparse = retrieval.sparse_leg(asked, index)
        if refine:
            top = self._refined(questions, dense, asked, sparse, index, k)
        else:
            top = retrieval.reranked(retrieval.fused(dense, sparse), providers.get("rerank")(F.lit(""), F.lit("")), k)
        out = top.join(self._sources(), "id")
        passage = retrieval.passage(F.col("place") + 1, F.col("title"), F.col("file_name"), F.col("author"), F.col("year"), F.col("page"), F.col("context"), F.col("text"))
        if refine:
            told = compression.compressed(out.select("query_id", "id", passage.alias("p")), ["query_id", "id"], "p", stored(compression.counts(self.chunks(), "text"), "pairs"))
            out, passage = out.join(told, ["query_id", "id"]), F.col("compressed")
        return out.select("query_id", "place", "title", "author", "year", "page", F.round("rrf_score", 4).alias("rrf_score"), "text", passage.alias("passage"))

    def _refined(self, questions: DataFrame, dense: DataFrame, asked: DataFrame, sparse: DataFrame, index: DataFrame, k: int) -> DataFrame:
        dense, sparse = stored(dense, "dense"), stored(sparse, "sparse")
        expanded = retrieval.sparse_leg(feedback.rm3(asked, sparse, index), index)
        both = [retrieval.fused(dense, s).withColumns({"question_id": F.col("query_id"), "query_id": F.col("query_id") * 2 + n}) for n, s in enumerate((sparse, expanded))]
        pooled = retrieval.pooled(both[0].unionByName(both[1])).withColumnRenamed("question_id", "query_id")
        return late.reranked(pooled, questions, self.chunks().select("id", "text"), k, retrieval.K_RERANK)

    def query_library(self, question: str) -> dict:
        """One question's answer and its sources."""
        q = self.spark.createDataFrame([(0, question)], "query_id long, question string")
        rows = self.ask(q).orderBy("place").collect()  # K_CONTEXT rows
        top = self.spark.createDataFrame([(0, r.place, r.text) for r in rows], "query_id long, place int, text string")
        answer = providers.get("answer")(top).first() if rows else None
        return {"answer": answer.answer if answer else "No sources found.", "sources": [{"title": r.title, "author": r.author, "year": r.year, "page": r.page, "rrf_score": r.rrf_score} for r in rows]}

    def find_sources(self, topic: str, top_k: int = 5) -> list[str]:
        q = self.spark.createDataFrame([(0, topic)], "query_id long, question string")
        rows = self.ask(q, top_k).orderBy("place").collect()
        return [f"{r.place + 1}. {r.title}" + (f" — {r.author}" if r.author else "") + (f" ({r.year})" if r.year else "") + f" [score: {r.rrf_score}]" for r in rows]

    # --- people ---

    def extract(self, answer: Callable[[DataFrame], DataFrame]) -> int:
        """Run extraction on indexed files that have none.  ``answer`` adds ``raw`` to ``path, text``."""
        before = self.table("graph", GRAPH)
        todo = state.pending(self.table("state", STATE).select("path", "status"), before)
        text = self.chunks().groupBy(F.col("source_file_id").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("passage_index", "text")))["text"], "\n").alias("text"))
        texts = todo.join(text, "path", "left").withColumn("text", F.substring("text", 1, SF.TEXT_LIMIT))
        done = extraction.retried(before, extraction.entries(answer(texts).withColumn("found", F.lit(True))))
        # a run has a number, which its end makes known: one that was cut off is run again under the same and replaces what it wrote
        number = before.agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0]
        path = f"{self.folder}/extracted/run={number}"
        done.write.mode("overwrite").parquet(path)
        done = self.spark.read.parquet(path).withColumn("run", F.lit(number))
        n = done.count()
        if n:
            self._save(state.upsert(before, done.select(*before.columns)), "graph")
        return n

    def enrich(self, people: DataFrame) -> DataFrame:
        """The ordered merge of all extracted people into a roster (``pid, name, ord``): matches, new people, edges."""
        known = self.table("graph", GRAPH).select(F.coalesce("run", F.lit(0)).alias("run")).distinct()
        x = self.spark.read.parquet(f"{self.folder}/extracted").where("persons is not null").join(known, "run", "left_semi").withColumn("file_name", F.element_at(F.split("path", "/"), -1))
        x = x.withColumn("file_ord", F.col("path"))
        persons = x.select("file_name", "file_ord", F.posexplode("persons").alias("ord", "p")).select("file_name", "file_ord", F.col("ord").cast("long").alias("ord"), F.col("p.name").alias("name"))
        relations = x.select("file_name", "file_ord", F.posexplode("relationships").alias("ord", "r")).select("file_name", "file_ord", F.col("ord").cast("long").alias("ord"), "r.*")
        return entities.resolve_all(people, persons, relations)

    # --- reports ---

    def status(self, queue: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Files with their states, and the totals."""
        queue = queue if queue is not None else self.spark.createDataFrame([], "queue string, path string")
        files = state.status_table(self.table("state", STATE), self.table("graph", GRAPH), queue)
        return files, state.summary(files, queue)

    def index_status(self) -> dict:
        n = self.chunks().count()
        return {"status": "ready" if n else "no_index", "chunk_count": n}
