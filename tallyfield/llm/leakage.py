"""Held-out passages inside a corpus, by a positional inverted index."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, ensure_checkpoint_dir
from .words import word_forms, words

#: Words up to which the items' vocabulary is sent to every executor; beyond it every word is indexed.
VOCABULARY_LIMIT = 500_000
#: Rows up to which a list of looked-up words or of candidates is sent to every executor; longer ones are joined.
BROADCAST_ROWS = 500_000


def positional_index(docs: DataFrame, doc_id: str, text: str, vocabulary: list[str] | None = None, name: str | None = None) -> str:
    """The folder of a new index of the corpus: postings (term, doc, form, positions).

    vocabulary: the words to index, all if null. form is the reading of the text (see
    words.word_forms), positions the places of the word in that reading. The index is
    divided by documents, each part sorted by term so that scans for few terms skip most of
    it, and written once to the shared checkpoint folder under its name. Nothing is shuffled, so
    a word that is in every document does no harm. Null, empty and wordless texts have no
    postings. It stays until drop_index.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(None if vocabulary is None else frozenset(vocabulary))
    schema = pa.schema([("term", pa.string()), ("doc", pa.int64()), ("form", pa.int32()), ("positions", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            term, doc, form, offsets, flat = [], [], [], [0], []

            def flush() -> pa.RecordBatch:
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                return pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(doc, pa.int64()), pa.array(form, pa.int32()), lists], schema=schema)

            for ident, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, reading in enumerate(word_forms(t)):
                    places: dict[str, list[int]] = {}
                    for pos, w in enumerate(reading):
                        if known is None or w in known:
                            places.setdefault(w, []).append(pos)
                    for w, at in places.items():
                        term.append(w)
                        doc.append(ident)
                        form.append(k)
                        flat.extend(at)
                        offsets.append(len(flat))
                if len(flat) > 200_000:
                    yield flush()
                    term, doc, form, offsets, flat = [], [], [], [0], []
            if term:
                yield flush()

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    postings = rows.mapInArrow(run, "term string, doc bigint, form int, positions array<int>")
    path = os.path.join(ensure_checkpoint_dir(spark), name or f"postings-{uuid.uuid4().hex}")
    postings.sortWithinPartitions("term", "doc").write.parquet(path)
    shipped.unpersist()
    return path


def drop_index(spark: SparkSession, path: str) -> None:
    """Remove an index from the shared folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def passage_words(items: DataFrame, item_id: str, passage: str, least: int) -> DataFrame:
    """(item, owner, offset, term): the words of the passages that have at least `least`.

    owner is the item's identifier; item stands for it and its passage, so that an identifier
    may have several.
    """
    schema = pa.schema([("item", pa.int64()), ("owner", pa.int64()), ("offset", pa.int32()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for item, owner, text in zip(*(c.to_pylist() for c in batch.columns)):
                ws = words(text)
                if len(ws) >= least:
                    cols[0] += [item] * len(ws)
                    cols[1] += [owner] * len(ws)
                    cols[2] += range(len(ws))
                    cols[3] += ws
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = items.select(F.col(item_id).cast("long").alias("owner"), F.col(passage).cast("string").alias("passage")).where("owner is not null and passage is not null").distinct()
    return rows.select(F.xxhash64("owner", "passage").alias("item"), "owner", "passage").mapInArrow(run, "item bigint, owner bigint, offset int, term string")


def _of_owners(found: DataFrame, asked: DataFrame, best: str, doc_id: str, item_id: str) -> DataFrame:
    """The answers by the items' own identifiers."""
    owners = asked.select("item", "owner").distinct()
    named = found.join(owners, "item").groupBy("doc", "owner").agg(F.max(best).alias(best))
    return cut(named.select(F.col("doc").alias(doc_id), F.col("owner").alias(item_id), best))


def _indexed(docs: DataFrame, doc_id: str, text: str, asked: DataFrame, index: str | None) -> tuple[str, DataFrame, DataFrame]:
    """The index's folder, its postings, and the asked words each with the number n of documents' readings that have it."""
    spark = docs.sparkSession
    terms = asked.select("term").distinct()
    if index is None:
        few = [r["term"] for r in terms.limit(VOCABULARY_LIMIT + 1).collect()]
        index = positional_index(docs, doc_id, text, few if len(few) <= VOCABULARY_LIMIT else None)
    postings = spark.read.parquet(index)
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    return index, postings, asked.join(frequency, "term", "left").na.fill(0, ["n"])


def _small(df: DataFrame) -> DataFrame:
    """The cut rows, to be broadcast if they were counted to be few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rarest_offsets(frequency: list[int], run: int, each: int) -> set[int]:
    """The offsets of the `each` rarest words of every run of words, ties to the earlier offset.

    A run holding a word that the corpus lacks can't occur and needs none.
    """
    chosen: set[int] = set()
    for start in range(len(frequency) - run + 1):
        window = range(start, start + run)
        if all(frequency[o] for o in window):
            chosen.update(sorted(window, key=lambda o: (frequency[o], o))[:each])
    return chosen


def _anchors(asked: DataFrame, run: int) -> DataFrame:
    """(item, offset, term) of the two rarest words of every run of the passages."""
    schema = pa.schema([("item", pa.int64()), ("offset", pa.int32()), ("term", pa.string())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], []]
            for item, line in zip(*(c.to_pylist() for c in batch.columns)):
                for o in sorted(rarest_offsets([x["n"] for x in line], run, 2)):
                    for c, v in zip(cols, (item, o, line[o]["term"])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    lines = asked.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("offset", "term", "n"))).alias("line"))
    return lines.mapInArrow(pick, "item bigint, offset int, term string")


def passages_in_documents(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, run: int = 12, index: str | None = None) -> DataFrame:
    """(doc_id, item_id, longest): documents that hold at least `run` consecutive words of a passage.

    index: the folder of an index of the corpus with all the words asked for; if null one is made for all
    items and removed at the end. For every run of words of a passage the postings of its two
    rarest words are looked up and intersected after shifting by their offsets, which leaves
    few (document, item, diagonal) candidates; for these alone the postings of all words of the
    passage are intersected the same way, and the longest row of neighbouring offsets is
    exact. The postings themselves are never shuffled while the candidates are few enough to
    be broadcast, which is counted.

    Documents without words, with null texts or ids and items with under `run` words are in no
    row. Repeated documents and items each count. A document that holds an item twice is one
    row with its longest run. Empty tables give no rows. Only the named columns are read.
    """
    spark, own = docs.sparkSession, index is None
    index, postings, asked = _indexed(docs, doc_id, text, cut(passage_words(items, item_id, passage, run)), index)
    asked = cut(asked)
    hits = (
        postings.join(_small(cut(_anchors(asked, run))), "term")
        .select("doc", "form", "item", "offset", F.explode("positions").alias("pos"))
        .select("doc", "form", "item", "offset", (F.col("pos") - F.col("offset")).alias("diagonal"))
    )
    candidates = hits.groupBy("doc", "form", "item", "diagonal").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi")).where("lo < hi")
    candidates = cut(candidates.select("doc", "form", "item", "diagonal"))
    full = (
        postings.join(_small(candidates), ["doc", "form"])
        .join(_small(asked.select("item", "offset", "term")), ["item", "term"])
        .where(F.expr("array_contains(positions, diagonal + offset)"))
        .groupBy("doc", "form", "item", "diagonal")
        .agg(F.array_sort(F.collect_set("offset")).alias("at"))
    )
    longest = F.expr("aggregate(at, struct(-9 as last, 0 as now, 0 as best), (a, o) -> struct(o as last, if(o = a.last + 1, a.now + 1, 1) as now, greatest(a.best, if(o = a.last + 1, a.now + 1, 1)) as best), a -> a.best)")
    found = full.select("doc", "item", longest.alias("longest")).where(F.col("longest") >= run)
    found = _of_owners(found, asked, "longest", doc_id, item_id)
    if own:
        drop_index(spark, index)
    return found


def passages_nearby(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, terms: int = 8, least: int = 6, span: int = 60, index: str | None = None) -> DataFrame:
    """(doc_id, item_id, n_terms): documents in which enough of a passage's rarest words stand close together.

    Of each passage the `terms` different words that are rarest in the corpus are looked up, words
    that it lacks first (ties to the word that comes first); a document matches if `least` of
    them lie within `span` words, in any order, so passages that were reordered or filled up
    are found. Passages with fewer words, null and empty texts and null identifiers give no row. index
    as in passages_in_documents.
    """
    spark, own = docs.sparkSession, index is None
    index, postings, asked = _indexed(docs, doc_id, text, cut(passage_words(items, item_id, passage, least)), index)
    asked = cut(asked)
    different = asked.groupBy("item", "term").agg(F.min("n").alias("n"), F.min("offset").alias("first"))
    rare = different.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy("n", "first"))).where(F.col("k") <= terms).select("item", "term")
    met = postings.join(_small(cut(rare)), "term")
    enough = met.groupBy("doc", "form", "item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("doc", "form", "item")
    hits = met.join(_small(cut(enough)), ["doc", "form", "item"]).select("doc", "form", "item", "term", F.explode("positions").alias("pos"))
    ahead = Window.partitionBy("doc", "form", "item").orderBy("pos").rangeBetween(0, span - 1)
    close = hits.withColumn("n_terms", F.size(F.collect_set("term").over(ahead)))
    found = _of_owners(close.where(F.col("n_terms") >= least), asked, "n_terms", doc_id, item_id)
    if own:
        drop_index(spark, index)
    return found
