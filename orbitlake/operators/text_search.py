"""BM25 retrieval over captions, for all queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.functions.lineage import stored
from orbitlake.operators.postings import DIGITS, SLACK, Asked, Postings, packed
from orbitlake.sources.fixtures import SQL_CAPTIONS, captions, table

K1, B = 1.5, 0.75
#: Ranges of image ids that are ranked apart.
RANGES = 256
#: Bands that a whole score is cut into where all of a gallery is ranked.
BANDS = 16
#: Queries and documents of a block of scores; blocks of queries are cut down to the smaller size while cores would idle.
QUERIES_A_BLOCK, FEWEST_QUERIES, DOCS_A_BLOCK = 8192, 256, 4000
#: Scores that a task holds where it ranks whole galleries, and rows that it keeps of a block of queries before it merges them.
SCORES_A_TASK, ROWS_KEPT = 1 << 24, 1 << 20
#: Neighbouring documents without a score that are ranked together.
DOCS_A_BAND = 2000
#: Rows of a batch of ranks.
RANKS_A_BATCH = 1 << 17


def tokenize(text: Column) -> Column:
    """Lower-case words of a-z and 0-9; a word with any other letter, digit or _ is none."""
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.filter(every, lambda w: w.rlike("^[a-z0-9]+$"))


def index(docs: DataFrame) -> DataFrame:
    """(doc, term, tf, dl, idf, avgdl) of (doc, text), texts of one doc taken together; collection figures are one row, joined to every term. Texts are read once, their words kept."""
    words = docs.select("doc", F.explode_outer(tokenize(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("term").alias("tf"))
    words = stored(words)  # a text without a word is a row without a term
    return index_of(words.where("term IS NOT NULL"), words.groupBy("doc").agg(F.sum("tf").alias("dl")))


def index_of(tf: DataFrame, dl: DataFrame) -> DataFrame:
    """The index from (doc, term, tf) and (doc, dl) of all documents, those without a term too."""
    whole = dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(whole))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return tf.join(df.select("term", idf.alias("idf"), "avgdl"), "term").join(dl, "doc")


def caption_terms(caps: DataFrame) -> DataFrame:
    """(image_id, caption_idx, term, n) of all captions, tokenized once and written; few large input splits are dealt to all cores first."""
    cores = caps.sparkSession.sparkContext.defaultParallelism
    rows = caps.select("image_id", "caption_idx", "text")
    rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
    terms = rows.select("image_id", "caption_idx", F.explode(tokenize(F.col("text"))).alias("term"))
    return stored(terms.groupBy("image_id", "caption_idx", "term").agg(F.count("*").alias("n")))


def weight(tf: Column, dl: Column) -> Column:
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (F.col("avgdl") + 1e-9)) + 1e-9)


def _parts(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _as_bytes(rows: pa.Table) -> pa.Array:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as stream:
        stream.write_table(rows.combine_chunks())
    return pa.array([out.getvalue().to_pybytes()], pa.binary())


def _from_bytes(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _packed_terms(asked: pa.Table) -> pa.Table:
    """Rows (query, term, qtf, others), the former two lists, as one row: a row a term, all but qtf as numbers of distinct terms and of queries."""
    asked = asked.combine_chunks()
    each = pc.list_parent_indices(asked["term"].combine_chunks()).cast(pa.int32())
    rows = {c: pa.DictionaryArray.from_arrays(each, asked[c].combine_chunks()) for c in asked.column_names if c not in ("_q", "term", "qtf")}
    rows |= {"term": asked["term"].combine_chunks().flatten().dictionary_encode(), "qtf": asked["qtf"].combine_chunks().flatten()}
    return pa.table({"_q": asked["_q"].slice(0, 1), "asked": _as_bytes(pa.table(rows))})


def _packed_lists(rows: pa.Table) -> pa.Table:
    return pa.table({"_d": rows["_d"].slice(0, 1), "lists": _as_bytes(packed(rows.drop_columns("_d")))})


def _labels(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that a shuffle by them to ``n`` tasks deals one to each, as far as Spark places numbers by their hash."""
    found, size = {}, 8 * n + 64
    while len(found) < n and size < 1 << 26:
        at = spark.range(size).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), F.col("id").cast("int").alias("id"))
        found = {r["p"]: r["id"] for r in at.groupBy("p").agg(F.min("id").alias("id")).collect()}  # a row a task
        size *= 4
    return [found.get(p, -1 - p) for p in range(n)]


def meet(terms: DataFrame, indexed: DataFrame, n_q: int, n_d: int, splits: int, task: Callable[[Iterator[tuple[int, pa.Table, pa.Table]], int], Iterator[pa.Table]], schema: str) -> DataFrame:
    """``task`` over each of ``n_q`` blocks of queries with each of ``n_d`` blocks of documents, these dealt to ``splits`` tasks for a block of queries.

    It gets (number of the block of queries, its terms, lists) one after the other, and how many blocks of documents there are; terms are (query, term, qtf and what else ``terms`` has) as ``Asked`` takes
    them, lists (term, docs, weights) as ``packed``. Each block is one row, those of documents are kept; a task makes its blocks of queries and reads the documents' in turn, so that neither is shuffled once for each block of the other kind.
    """
    owned = ["owner"] if "owner" in indexed.columns else []
    whole = F.xxhash64("owner" if owned else "doc")
    weighted = indexed.select("term", "doc", *owned, weight(F.col("tf"), F.col("dl")).alias("weight"), F.pmod(whole, F.lit(n_d)).cast("int").alias("_d"))
    left = stored(weighted.groupBy("_d").applyInArrow(_packed_lists, "_d int, lists binary"), 1)
    others = [c for c in terms.columns if c not in ("query", "term", "qtf")]
    label = F.get(F.lit(_labels(terms.sparkSession, n_q)).cast("array<int>"), F.pmod(F.xxhash64("query"), F.lit(n_q)).cast("int"))
    asked = terms.withColumn("_q", label).repartition(n_q, "_q").groupBy("_q", "query", *others).agg(F.collect_list(F.struct("term", "qtf")).alias("_t"))
    asked = asked.select("_q", "query", *others, F.col("_t.term").alias("term"), F.col("_t.qtf").alias("qtf"))
    right = asked.groupBy("_q").applyInArrow(_packed_terms, "_q int, asked binary")
    blocks = left.count()
    left = left.coalesce(1) if splits == 1 else left.repartitionByRange(splits, "_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {}

        def pairs() -> Iterator[tuple[int, pa.Table, pa.Table]]:
            for batch in batches:
                for q, of, lists in zip(batch["_q"].to_pylist(), batch["asked"], batch["lists"], strict=True):
                    if q not in asked:
                        asked[q] = _from_bytes(pa.scalar(of.as_py()))  # a copy: the batch goes
                    yield q, asked[q], _from_bytes(lists)

        for q, rows in task(pairs(), blocks):
            if "query" in rows.column_names:
                rows = rows.set_column(rows.column_names.index("query"), "query", asked[q]["query"].combine_chunks().dictionary.take(rows["query"].combine_chunks()))
            yield from rows.combine_chunks().to_batches(RANKS_A_BATCH)

    return left.join(right.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def in_blocks(terms: DataFrame, indexed: DataFrame, sizes: tuple[int, int], block: Callable[[pa.Table, pa.Table], pa.Table], schema: str, merge: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """``block`` over each block of queries with each block of documents, as ``meet`` gives them; a column query of its rows is the number of the query in the block.

    ``sizes`` are about the numbers of queries and documents; all documents of an owner, if the index has such a column, are in one block. ``merge`` makes fewer rows of those of several blocks of documents.
    """
    cores, n_d = terms.sparkSession.sparkContext.defaultParallelism, _parts(sizes[1], DOCS_A_BLOCK)
    n_q = max(_parts(sizes[0], QUERIES_A_BLOCK), min(_parts(sizes[0], FEWEST_QUERIES), 4 * cores))

    def task(pairs: Iterator[tuple[int, pa.Table, pa.Table]], blocks: int) -> Iterator[tuple[int, pa.Table]]:
        kept = {}
        for q, of, lists in pairs:
            if merge is None:
                yield q, block(of, lists)
                continue
            kept.setdefault(q, []).append(block(of, lists))
            if sum(map(len, kept[q])) > ROWS_KEPT:
                kept[q] = [merge(pa.concat_tables(kept[q]))]
        for q, rows in kept.items():
            yield q, merge(pa.concat_tables(rows))

    return meet(terms, indexed, n_q, n_d, min(n_d, _parts(4 * cores, n_q)), task, schema)


def rough_sizes(queries: DataFrame, query: Column, docs: DataFrame, doc: str) -> tuple[int, int]:
    return queries.agg(F.approx_count_distinct(query)).first()[0], docs.agg(F.approx_count_distinct(doc)).first()[0]


def bm25(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """(query, doc, score) of (query, text) against an index; pairs without a common term are left out (score 0)."""
    terms = queries.select("query", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    weighted = indexed.select("term", "doc", weight(F.col("tf"), F.col("dl")).alias("w"))
    return terms.join(weighted, "term").groupBy("query", "doc").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 9).alias("score"))


def image_docs(caps: DataFrame) -> DataFrame:
    return caps.select(F.col("image_id").alias("doc"), "text")


def query_id() -> Column:
    return F.concat(F.col("image_id"), F.lit("_cap"), F.col("caption_idx"))


def _beaten(queries: pa.Table, lists: pa.Table) -> pa.Table:
    """Per query the images other than its own that come before it; where that has no score, also those with a score and a smaller id."""
    block = Postings(lists)
    asked, ids = Asked(queries, block.terms), block.names.to_numpy()
    own, s = asked.queries["image_id"].to_numpy(), asked.queries["s"].to_numpy()
    above, before = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    smaller = np.searchsorted(ids, own)  # how many ids are smaller
    place = np.where((smaller < len(ids)) & (ids[np.minimum(smaller, len(ids) - 1)] == own), smaller, -1)
    for first, scores in block.every(asked):
        at = slice(first, first + len(scores))
        low, high, mine = np.maximum(s[at] - SLACK, np.finfo(float).tiny), s[at] + SLACK, place[at]
        least = np.count_nonzero(scores >= low[:, None], axis=1)
        more = np.count_nonzero(scores > high[:, None], axis=1)
        has = np.flatnonzero(mine >= 0)
        more[has] -= scores[has, mine[has]] > high[has]
        least[has] -= scores[has, mine[has]] >= low[has]
        for i in np.flatnonzero(least > more):  # some are about as good
            near = np.flatnonzero((scores[i] >= low[i]) & (scores[i] <= high[i]))
            near = near[near != mine[i]]
            score = np.round(scores[i, near], DIGITS)
            more[i] += np.count_nonzero((score > s[first + i]) | ((score == s[first + i]) & (near < smaller[first + i])))
        for i in np.flatnonzero(s[at] == 0):
            before[first + i] = np.count_nonzero(scores[i, : smaller[first + i]])
        above[at] = more
    return pa.table({"query": np.arange(len(own)), "above": above, "scored_before": before})


def _summed(rows: pa.Table) -> pa.Table:
    out = rows.group_by("query").aggregate([("above", "sum"), ("scored_before", "sum")])
    return pa.table({"query": out["query"], "above": out["above_sum"], "scored_before": out["scored_before_sum"]})


def query_terms(asked: DataFrame) -> DataFrame:
    return asked.select(query_id().alias("query"), "image_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query", "image_id", "term").agg(F.count("*").alias("qtf"))


def _places(caps: DataFrame, terms: DataFrame, idx: DataFrame, target: DataFrame) -> DataFrame:
    """(query, image_id, category, score, rank) of ``target`` (query, image_id, category, s) among all images of ``caps`` by ``idx``, those without a score included; ties go to the smaller image."""
    wanted = terms.where("image_id IS NOT NULL").join(target.select("query", "s"), "query")
    beaten = in_blocks(wanted, idx, rough_sizes(terms, F.col("query"), caps, "image_id"), _beaten, f"query {terms.schema['query'].dataType.simpleString()}, above long, scored_before long", _summed)
    beaten = beaten.groupBy("query").agg(F.sum("above").alias("above"), F.sum("scored_before").alias("scored_before"))
    order = earlier(caps.select("image_id").distinct(), "image_id")
    out = target.join(beaten, "query", "left").fillna(0, ["above", "scored_before"]).join(order, "image_id")
    zero = F.when(F.col("s") == 0, F.col("before") - F.col("scored_before")).otherwise(0)
    return out.select("query", "image_id", "category", F.col("s").alias("score"), (1 + F.col("above") + zero).cast("long").alias("rank"))


def target_ranks(caps: DataFrame, docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(query, image_id, category, score, rank) of the image of each caption in ``asked`` (all by default), searched in ``docs`` (doc, text), a text or more an image."""
    asked = caps if asked is None else asked
    idx, terms = index(docs), query_terms(asked)
    own = terms.join(idx.withColumnRenamed("doc", "image_id"), ["image_id", "term"]).groupBy("query").agg(F.round(F.sum(F.col("qtf") * weight(F.col("tf"), F.col("dl"))), 9).alias("s"))
    target = asked.select(query_id().alias("query"), "image_id", "category").join(own, "query", "left").fillna(0.0, ["s"])
    return _places(caps, terms, idx, target)


def loo_ranks(caps: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(query, image_id, category, score, rank): each caption in ``asked`` (all by default) searches for its image, which is scored without it.

    Captions equal to the query after trimming and lower-casing go from the target too, unless none would be
    left. idf and average length stay those of the whole corpus; ties go to the smaller image.
    """
    every = caption_terms(caps)
    tf = every.groupBy(F.col("image_id").alias("doc"), "term").agg(F.sum("n").alias("tf"))
    sizes = every.groupBy(F.col("image_id").alias("doc")).agg(F.sum("n").alias("dl"))
    idx = stored(index_of(tf, caps.select(F.col("image_id").alias("doc")).distinct().join(sizes, "doc", "left").fillna(0, ["dl"])))
    terms = every if asked is None else every.join(asked.select("image_id", "caption_idx").distinct(), ["image_id", "caption_idx"], "left_semi")
    terms = terms.select(query_id().alias("query"), "image_id", "term", F.col("n").alias("qtf"))
    queries = (caps if asked is None else asked).select(query_id().alias("query"), "image_id", "caption_idx", F.lower(F.trim("text")).alias("said"), "category")
    own = caps.select("image_id", F.col("caption_idx").alias("other"), F.lower(F.trim("text")).alias("other_said"))
    pairs = queries.join(own, "image_id").withColumn("equal", (F.col("said") == F.col("other_said")) | (F.col("caption_idx") == F.col("other")))
    left = F.min("equal").over(Window.partitionBy("query"))  # true if nothing would be left
    pairs = pairs.withColumn("gone", F.when(left, F.col("caption_idx") == F.col("other")).otherwise(F.col("equal")))
    gone = pairs.where("gone").select("query", "image_id", F.col("other").alias("caption_idx")).distinct().join(every, ["image_id", "caption_idx"])
    gone_tf = gone.groupBy("query", "term").agg(F.sum("n").alias("gone_tf"))
    gone_dl = gone.groupBy("query").agg(F.sum("n").alias("gone_dl"))
    target = terms.join(idx.withColumnRenamed("doc", "image_id"), ["image_id", "term"]).join(gone_tf, ["query", "term"], "left").join(gone_dl, "query", "left")
    tf = F.col("tf") - F.coalesce("gone_tf", F.lit(0))
    s = F.when(tf > 0, F.col("qtf") * weight(tf, F.col("dl") - F.coalesce("gone_dl", F.lit(0)))).otherwise(0.0)
    target = queries.select("query", "image_id", "category").join(target.groupBy("query").agg(F.round(F.sum(s), 9).alias("s")), "query", "left").fillna(0.0, ["s"])
    return _places(caps, terms, idx, stored(target))


def earlier(ids: DataFrame, key: str) -> DataFrame:
    """Adds ``before``, the number of rows of ``ids`` with a smaller ``key`` (distinct numbers; null is the smallest).

    Rows are ranked within ranges between about evenly spread keys only; what lies before
    each range comes from their counts, so that no task sorts all rows.
    """
    bounds = ids.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)])).first()[0] or []  # one literal for both uses: the estimate may vary
    dealt = ids.withColumn("_range", F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: b < F.col(key))))
    counts = dict(dealt.groupBy("_range").count().collect())  # a row a range
    starts = [sum(n for r, n in counts.items() if r < i) for i in range(len(set(bounds)) + 1)]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    start = F.get(F.lit(starts).cast("array<bigint>"), F.col("_range"))
    return dealt.withColumn("before", start + place).drop("_range")


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank, by category and over all (category null)."""
    hit = [F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"r{k}") for k in (1, 5, 10)]
    return ranks.rollup("category").agg(F.count("*").alias("queries"), *hit, F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))


def search(queries: DataFrame, docs: DataFrame, k: int = 10, every: bool = False) -> DataFrame:
    """(query, doc, score, rank): the best ``k`` documents of each query (query, text), or all if there are fewer; ties to the smaller document.

    With ``every``, also all others that share a term with the query.

    Where ``docs`` (doc, text) has a column owner, a document is a part of its owner: owners are found, by
    the best of their documents. What shares no term with a query has 0.
    """
    owned = "owner" in docs.columns
    if every:
        return _search_every(queries, docs, k)

    def best(of: pa.Table, lists: pa.Table) -> pa.Table:
        block = Postings(lists)
        query, met, score = block.best_of_each(Asked(of, block.terms), k)
        return pa.table({"query": query, "doc": block.owners.take(pa.array(met)), "score": score})

    def first(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("score", "descending"), ("doc", "ascending")]))
        query = rows["query"].to_numpy()
        return rows.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))

    name = "owner" if owned else "doc"
    terms = text_terms(queries)
    schema = f"query {queries.schema['query'].dataType.simpleString()}, doc {docs.schema[name].dataType.simpleString()}, score double"
    indexed = index(docs.select("doc", "text"))
    indexed = indexed.join(docs.select("doc", "owner").distinct(), "doc") if owned else indexed
    top = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    found = in_blocks(terms, indexed, rough_sizes(queries, F.col("query"), docs, "doc"), best, schema, first).withColumn("rank", F.row_number().over(top))
    return filled(found.where(F.col("rank") <= k), queries, docs.select(F.col(name).alias("doc")), k)


def text_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def filled(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``found`` (query, doc, score, rank) with the smallest other ``docs`` at score 0 after each query's own, until it has ``k`` or all."""
    first = docs.where("doc IS NOT NULL").distinct().orderBy("doc").limit(2 * k).agg(F.array_sort(F.collect_list("doc")).alias("first"))  # fewer than k of them are found
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "score"))).alias("l"))
    rows = queries.select("query").distinct().join(lists, "query", "left").crossJoin(F.broadcast(first)).withColumn("l", F.coalesce("l", F.array().cast(lists.schema["l"].dataType)))
    more = F.slice(F.array_except("first", "l.doc"), 1, F.greatest(F.lit(0), k - F.size("l")))
    both = F.concat(F.transform("l", lambda x: F.struct(x["doc"].alias("doc"), x["score"].alias("score"))), F.transform(more, lambda x: F.struct(x.alias("doc"), F.lit(0.0).alias("score"))))
    return rows.select("query", F.posexplode(both).alias("_at", "x")).select("query", "x.doc", "x.score", (F.col("_at") + 1).alias("rank"))


def rank_gallery(queries: DataFrame, scores: DataFrame, gallery: DataFrame) -> DataFrame:
    """(query, doc, score, rank): all of ``gallery`` (doc) for each of a stated set of ``queries`` (query), by ``scores`` (query, doc, score), all above 0.

    Documents without a score have 0; ties go to the smaller document. Ranks are taken within bands of
    near scores, or of neighbouring documents where there is none, and what lies before a
    band comes from counts, so that no task sorts a whole gallery.
    """
    part = F.floor(F.col("before") / DOCS_A_BAND).alias("part")
    blocks = earlier(gallery.select("doc").distinct(), "doc").groupBy(part).agg(F.collect_list(F.struct("doc", "before")).alias("docs"))
    pairs = queries.select("query").distinct().crossJoin(blocks).select("query", "part", F.explode("docs").alias("x")).select("query", "part", "x.*")
    rows = pairs.join(scores, ["query", "doc"], "left").fillna(0.0, ["score"])
    rows = rows.withColumn("band", F.when(F.col("score") > 0, -1 - F.floor(F.col("score") * BANDS)).otherwise(F.col("part")))
    start = F.sum("n").over(Window.partitionBy("query").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("query", "band").agg(F.count("*").alias("n")).select("query", "band", F.coalesce(start, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("query", "band").orderBy(F.desc("score"), "before"))
    return rows.withColumn("place", place).join(starts, ["query", "band"]).select("query", "doc", "score", (F.col("start") + F.col("place")).alias("rank"))


def _galleries(terms: DataFrame, indexed: DataFrame, n_queries: int, n_docs: int, n_owners: int, rank: Callable[[str | None, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], schema: str) -> DataFrame:
    """(query, doc, score, rank) as ``rank`` makes them of (query, all ids in order, their scores).

    One task holds the scores of its queries, about SCORES_A_TASK, and the ids; documents come block by block, and a pair is a row only when it is done.
    """
    cores = terms.sparkSession.sparkContext.defaultParallelism
    at_most = max(1, min(4 * FEWEST_QUERIES, SCORES_A_TASK // max(1, n_owners)))
    n_q = max(_parts(n_queries, at_most), min(_parts(n_queries, 16), 4 * cores))

    def task(pairs: Iterator[tuple[int, pa.Table, pa.Table]], blocks: int) -> Iterator[tuple[int, pa.Table]]:
        held = {}
        for q, of, lists in pairs:
            block = Postings(lists)
            asked = Asked(of, block.terms)
            names, ids, scores = held.setdefault(q, (asked.queries["query"], [], []))
            ids.append(block.owners.to_numpy())
            scores.append(np.concatenate([block.by_owner(s) for _, s in block.every(asked)]))
            if len(ids) == blocks:
                del held[q]
                for rows in _rows(names.to_pylist(), np.concatenate(ids), scores):
                    yield q, rows
        if held:
            raise ValueError("a gallery lacks some of its blocks")

    def _rows(names: list, ids: np.ndarray, scores: list[np.ndarray]) -> Iterator[pa.Table]:
        order, kept, n = np.argsort(ids), [], 0
        ids = ids[order]
        for i, name in enumerate(names):
            doc, score, place = rank(name, ids, np.round(np.concatenate([s[i] for s in scores])[order], DIGITS))
            kept.append((np.full(len(doc), i), doc, score, place))
            n += len(doc)
            if n > RANKS_A_BATCH or i == len(names) - 1:
                yield pa.table(dict(zip(("query", "doc", "score", "rank"), map(np.concatenate, zip(*kept, strict=True)), strict=True)))
                kept, n = [], 0

    return meet(terms, indexed, n_q, _parts(n_docs, DOCS_A_BLOCK), 1, task, schema)


def _best_first(score: np.ndarray) -> np.ndarray:
    """The places of scores above 0, largest first, of equal ones the earlier one first."""
    some = np.flatnonzero(score > 0)
    held = score[some]
    order = np.argsort(-held)
    if np.any(np.diff(held[order]) == 0):
        order = np.argsort(-held, kind="stable")
    return some[order]


def _weightless(rows: DataFrame) -> DataFrame:
    """``rows`` as documents of an index with a word that all have and that weighs nothing."""
    return rows.withColumns({"term": F.lit(""), "tf": F.lit(0), "dl": F.lit(0), "idf": F.lit(0.0), "avgdl": F.lit(1.0)})


def search_gallery(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, doc, score, rank): all ``docs`` (doc, a number; text) for each of ``queries`` (query, text), as ``rank_gallery``. A query or document without an id scores 0."""
    least = -(2**63)  # stands for no id, which comes first
    ids = docs.select(F.coalesce("doc", F.lit(least)).alias("doc")).distinct()
    n_queries, n_docs = rough_sizes(queries, F.col("query"), ids, "doc")
    indexed = index(docs).where("doc IS NOT NULL").unionByName(_weightless(ids))
    terms = text_terms(queries.where("query IS NOT NULL"))
    terms = terms.unionByName(queries.select("query").distinct().withColumns({"term": F.lit(""), "qtf": F.lit(0)}))

    def rank(query: str | None, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.concatenate((_best_first(score), np.flatnonzero(score <= 0)))
        return ids[order], score[order], np.arange(1, len(order) + 1)

    found = _galleries(terms, indexed, n_queries, n_docs, n_docs, rank, f"query {queries.schema['query'].dataType.simpleString()}, doc long, score double, rank long")
    return found.withColumn("doc", F.when(F.col("doc") != least, F.col("doc")))


def _search_every(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``search`` with ``every``, for documents or owners that are numbers."""
    owned = ["owner"] if "owner" in docs.columns else []
    name = owned[0] if owned else "doc"
    first = docs.select(F.col(name).alias("doc")).where("doc IS NOT NULL").distinct().orderBy("doc").limit(2 * k).collect()  # a stated few, for queries that share a term with fewer than k
    first = np.array(sorted(r["doc"] for r in first), np.int64)
    there = docs.where(F.col(name).isNotNull()).select(F.coalesce("doc", F.lit("")).alias("doc") if owned else "doc", *owned).distinct()
    indexed = index(docs.select("doc", "text"))
    indexed = (indexed.join(docs.select("doc", "owner").distinct(), "doc") if owned else indexed).unionByName(_weightless(there))
    terms = text_terms(queries).unionByName(queries.select("query").distinct().withColumns({"term": F.lit(""), "qtf": F.lit(0)}))
    n_queries, n_docs = rough_sizes(queries, F.col("query"), docs, "doc")
    n_owners = docs.agg(F.approx_count_distinct(name)).first()[0] if owned else n_docs

    def rank(query: str | None, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = _best_first(score)
        met, score = ids[order], score[order]
        place = np.arange(1, len(met) + 1)
        if query is None:  # its first ones have 0, see ``filled``
            met, score, place = met[k:], score[k:], place[k:]
            more = first[:k]
        else:
            more = first[~np.isin(first, met)][: max(0, k - len(met))]
        at = np.arange(1, len(more) + 1) + (0 if query is None else len(met))
        return np.concatenate((met, more)), np.concatenate((score, np.zeros(len(more)))), np.concatenate((place, at)).astype(np.int32)

    return _galleries(terms, indexed, n_queries, n_docs, n_owners, rank, f"query {queries.schema['query'].dataType.simpleString()}, doc {docs.schema[name].dataType.simpleString()}, score double, rank int")


def h1_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(tokenize(F.col("text"))).alias("tokens"))


def h2_index(spark: SparkSession, d: str) -> DataFrame:
    return index(image_docs(captions(spark, d))).select("doc", "term", "tf", "dl", F.round("idf", 6).alias("idf"))


def e3_search(spark: SparkSession, d: str) -> DataFrame:
    """The best ten images of every caption, with their categories."""
    caps = captions(spark, d)
    found = search(caps.select(query_id().alias("query"), "text"), image_docs(caps))
    kinds = caps.select(F.col("image_id").alias("doc"), "category").distinct()
    return found.join(kinds, "doc").select("query", "doc", F.round("score", 4).alias("score"), "rank", F.lit("bm25").alias("score_type"), "category")


def e1_rank_gallery(spark: SparkSession, d: str) -> DataFrame:
    """All images, with a score or without, for the captions of every image whose id is divisible by 20."""
    caps = captions(spark, d)
    asked, docs = caps.where("image_id % 20 = 0").select(query_id().alias("query"), "text"), image_docs(caps)
    return search_gallery(asked, docs).select("query", "doc", F.round("score", 4).alias("score"), "rank")


def h5_max_caption(spark: SparkSession, d: str) -> DataFrame:
    """All images that share a word with a caption, each by that of its captions that fits best; ten for every caption at least, if there are as many."""
    caps = captions(spark, d)
    found = search(caps.select(query_id().alias("query"), "text"), caps.select(query_id().alias("doc"), "text", F.col("image_id").alias("owner")), every=True)
    return found.select("query", F.col("doc").alias("image_id"), F.round("score", 4).alias("score"), "rank")


def h6_bm25_leave_one_out_ranks(spark: SparkSession, d: str) -> DataFrame:
    return loo_ranks(captions(spark, d)).select("query", "category", F.round("score", 6).alias("score"), "rank")


def h6_bm25_leave_one_out_metrics(spark: SparkSession, d: str) -> DataFrame:
    return retrieval_metrics(loo_ranks(captions(spark, d)))


def category_docs(caps: DataFrame) -> DataFrame:
    """(doc, text): for each image a label only, here the first three words of its first caption."""
    label = F.array_join(F.slice(F.split(F.min_by("text", "caption_idx"), " "), 1, 3), " ")
    return caps.groupBy(F.col("image_id").alias("doc")).agg(label.alias("text"))


def h7_category_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the captions' images where images are known by their labels alone."""
    caps = captions(spark, d)
    return target_ranks(caps, category_docs(caps)).select("query", "category", F.round("score", 6).alias("score"), "rank")


def c11_qualitative_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by three protocols, side by side, and the best five images, for the captions of every image whose id is divisible by 20."""
    caps = captions(spark, d)
    asked = caps.where("image_id % 20 = 0")
    ranks = {"loo_rank": loo_ranks(caps, asked), "label_rank": target_ranks(caps, category_docs(caps), asked), "whole_rank": target_ranks(caps, image_docs(caps), asked)}
    best = search(asked.select(query_id().alias("query"), "text"), image_docs(caps), 5).groupBy("query")
    out = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"].cast("string")), ",").alias("top_5"))
    for name, found in ranks.items():
        out = found.select("query", F.col("rank").alias(name)).join(out, "query", "left")
    return out


# fixed values: what a missed query is taken for, by parts of its text, before and after the length is looked at
SPATIAL = ("near", "next to", "beside", "between", "surrounded")
DENSE = ("many", "several", "dense", "rows", "lines")
ATTRIBUTES = ("green", "white", "yellow", "rectangular", "circular")


def d14_failures(spark: SparkSession, d: str) -> DataFrame:
    """Queries that miss the first ten by the first class that their text meets, with shares in percent."""
    caps = captions(spark, d)
    low, words = F.lower("text"), F.size(F.split(F.trim("text"), r"\s+"))
    any_of = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p))
    kind = F.when(any_of(SPATIAL), "spatial_relational_confusion").when(any_of(DENSE), "dense_small_objects").when(words <= 4, "generic_repetitive_caption")
    kind = kind.when(any_of(ATTRIBUTES), "fine_grained_attribute_mismatch").otherwise("broad_geographic_context")
    missed = loo_ranks(caps).where("rank > 10").join(caps.select(query_id().alias("query"), kind.alias("kind")), "query")
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # five rows at most
    return missed.groupBy("kind").agg(F.count("*").alias("n")).withColumn("pct", F.round(share * 100, 3))


def d1_corpus(spark: SparkSession, d: str) -> DataFrame:
    w = F.size(F.split(F.trim("text"), r"\s+"))
    return captions(spark, d).rollup("category").agg(F.count_distinct("image_id").alias("images"), F.count("*").alias("captions"), F.round(F.avg(w), 6).alias("mean_words"))


# fixed values: templates of prompts
PROMPTS = ("%s", "a satellite image of %s", "a remote sensing image of %s", "an overhead image showing %s", "an aerial photograph of %s")


def h10_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Queries without end marks, in each of five templates."""
    forms = F.array(*map(F.lit, PROMPTS))
    q = F.regexp_replace(F.trim("text"), "[.!?]+$", "")
    return captions(spark, d).select(query_id().alias("query"), F.posexplode(F.transform(forms, lambda f: F.replace(f, F.lit("%s"), q))).alias("form", "prompt"))


def h11_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several images share: a query by one is found in the other."""
    t = F.lower(F.trim("text"))
    return captions(spark, d).groupBy(t.alias("text")).agg(F.count_distinct("image_id").alias("images")).where("images > 1")


TOK = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))"
W = "idf * {tf} * 2.5 / ({tf} + 1.5 * (0.25 + 0.75 * {dl} / (avgdl + 1e-9)) + 1e-9)"


def _index(docs: str) -> str:
    return f"""docs AS ({docs}), toks AS (SELECT doc, unnest({TOK}) AS term FROM docs),
tf AS (SELECT doc, term, count(*) AS tf FROM toks GROUP BY ALL), dl AS (SELECT doc, sum(len({TOK}))::BIGINT AS dl FROM docs GROUP BY doc),
whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idx AS (SELECT doc, term, tf, dl, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, avgdl FROM tf JOIN dfs USING (term) JOIN dl USING (doc), whole)"""


QID = "image_id || '_cap' || caption_idx"
IMAGES = "SELECT image_id AS doc, text FROM captions"
QTERMS = f"qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT {QID} AS query, unnest({TOK}) AS term FROM captions) GROUP BY ALL)"
SCORED = f"scored AS (SELECT query, doc, round(sum(qtf * {W.format(tf='tf', dl='dl')}), 9) AS score FROM qt JOIN idx USING (term) GROUP BY ALL)"
LOO = f"""WITH {SQL_CAPTIONS}, {_index(IMAGES)}, {QTERMS}, {SCORED},
q AS (SELECT {QID} AS query, * FROM captions),
pr AS (SELECT q.query, q.image_id, q.caption_idx AS k, o.caption_idx AS other, o.text, (lower(trim(q.text)) = lower(trim(o.text)) OR q.caption_idx = o.caption_idx) AS eq FROM q JOIN captions o USING (image_id)),
pg AS (SELECT *, CASE WHEN bool_and(eq) OVER (PARTITION BY query) THEN k = other ELSE eq END AS gone FROM pr),
gt AS (SELECT query, term, count(*) AS gtf FROM (SELECT query, unnest({TOK}) AS term FROM pg WHERE gone) GROUP BY ALL),
gd AS (SELECT query, sum(gtf) AS gdl FROM gt GROUP BY query),
tg AS (SELECT q.query, q.image_id, q.category, coalesce(round(sum(CASE WHEN tf - coalesce(gtf, 0) > 0 THEN qtf * {W.format(tf="(tf - coalesce(gtf, 0))", dl="(dl - coalesce(gdl, 0))")} ELSE 0 END), 9), 0) AS s
  FROM q LEFT JOIN qt USING (query) LEFT JOIN idx ON idx.doc = q.image_id AND idx.term = qt.term LEFT JOIN gt ON gt.query = q.query AND gt.term = qt.term LEFT JOIN gd ON gd.query = q.query GROUP BY ALL),
bt AS (SELECT query, count(*) FILTER (score > s OR score = s AND doc < image_id) AS above, count(*) FILTER (doc < image_id) AS sb FROM scored JOIN tg USING (query) WHERE doc <> image_id GROUP BY query),
od AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS bf FROM (SELECT DISTINCT image_id FROM captions)),
ranks AS (SELECT query, category, s AS score, 1 + coalesce(above, 0) + CASE WHEN s = 0 THEN bf - coalesce(sb, 0) ELSE 0 END AS rank FROM tg LEFT JOIN bt USING (query) JOIN od USING (image_id))
"""
LABELS = "SELECT image_id AS doc, array_to_string(string_split(arg_min(text, caption_idx), ' ')[1:3], ' ') AS text FROM captions GROUP BY image_id"
#: Target ranks with and without a score, apart from the code above: plain counts of the images before the target.
RANKED = "ranks AS (SELECT q.query, q.image_id, q.category, q.s AS score, 1 + count(*) FILTER (o.image_id <> q.image_id AND (coalesce(c.score, 0) > q.s OR coalesce(c.score, 0) = q.s AND o.image_id < q.image_id)) AS rank FROM (SELECT k.*, coalesce(score, 0) AS s FROM (SELECT image_id || '_cap' || caption_idx AS query, image_id, caption_idx, category FROM captions) k LEFT JOIN scored ON scored.query = k.query AND scored.doc = k.image_id {where}) q, (SELECT DISTINCT image_id FROM captions) o LEFT JOIN scored c ON c.query = q.query AND c.doc = o.image_id GROUP BY ALL)"


#: Every pair of a query and an image, ranked.
PLACED = "placed AS (SELECT query, doc, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query ORDER BY coalesce(score, 0) DESC, doc) AS rank FROM (SELECT {q} AS query, o.doc FROM captions, (SELECT DISTINCT image_id AS doc FROM captions) o) LEFT JOIN {scored} USING (query, doc))"


def _target(docs: str, where: str = "") -> str:
    return f"WITH {SQL_CAPTIONS}, {_index(docs)}, {QTERMS}, {SCORED}, {RANKED.format(where=where)} "


SPACES = r"len(string_split_regex(trim(text), '\s+'))"


EVERY_20TH = "WHERE k.image_id % 20 = 0"


def _any(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, '{p}')" for p in parts) + ")"


QUERIES = {f.__name__: f for f in (h1_tokens, h2_index, e1_rank_gallery, e3_search, h5_max_caption, h6_bm25_leave_one_out_ranks, h6_bm25_leave_one_out_metrics, h7_category_ranks, c11_qualitative_matrix, d14_failures, d1_corpus, h10_prompts, h11_leakage)}
SQL = {
    "h1_tokens": f"SELECT doc_id, len({TOK}) AS tokens FROM documents",
    "h2_index": f"WITH {SQL_CAPTIONS}, {_index(IMAGES)} SELECT doc, term, tf, dl, round(idf, 6) AS idf FROM idx",
    "e1_rank_gallery": f"WITH {SQL_CAPTIONS}, {_index(IMAGES)}, {QTERMS}, {SCORED} SELECT k.query, k.doc, round(coalesce(score, 0), 4) AS score, row_number() OVER (PARTITION BY k.query ORDER BY coalesce(score, 0) DESC, k.doc) AS rank FROM (SELECT {QID} AS query, o.doc FROM captions, (SELECT DISTINCT image_id AS doc FROM captions) o WHERE image_id % 20 = 0) k LEFT JOIN scored USING (query, doc)",
    "e3_search": f"WITH {SQL_CAPTIONS}, {_index(IMAGES)}, {QTERMS}, {SCORED}, {PLACED.format(q=QID, scored='scored')} SELECT query, doc, round(score, 4) AS score, rank::INT AS rank, 'bm25' AS score_type, 'cat_' || doc % 10 AS category FROM placed WHERE rank <= 10",
    "h5_max_caption": f"WITH {SQL_CAPTIONS}, {_index(f'SELECT {QID} AS doc, text FROM captions')}, {QTERMS}, {SCORED}, most AS (SELECT query, image_id AS doc, max(score) AS score FROM scored JOIN (SELECT {QID} AS doc, image_id FROM captions) USING (doc) GROUP BY ALL), {PLACED.format(q=QID, scored='most')} SELECT query, doc AS image_id, round(score, 4) AS score, rank::INT AS rank FROM placed WHERE rank <= 10 OR score > 0",
    "h6_bm25_leave_one_out_ranks": LOO + "SELECT query, category, round(score, 6) AS score, rank FROM ranks",
    "h6_bm25_leave_one_out_metrics": LOO + "SELECT category, count(*) AS queries, round(avg((rank <= 1)::INT), 6) AS r1, round(avg((rank <= 5)::INT), 6) AS r5, round(avg((rank <= 10)::INT), 6) AS r10, round(avg(1 / rank), 6) AS mrr FROM ranks GROUP BY ROLLUP (category)",
    "h7_category_ranks": _target(LABELS) + "SELECT query, category, round(score, 6) AS score, rank FROM ranks",
    "c11_qualitative_matrix": f"SELECT l.query, l.rank AS loo_rank, g.rank AS label_rank, w.rank AS whole_rank, t.top_5 FROM ({_target(LABELS, EVERY_20TH)} SELECT query, rank FROM ranks) g JOIN ({_target(IMAGES, EVERY_20TH)} SELECT query, rank FROM ranks) w USING (query) JOIN ({LOO} SELECT query, rank FROM ranks) l USING (query) LEFT JOIN (WITH {SQL_CAPTIONS}, {_index(IMAGES)}, {QTERMS}, {SCORED}, {PLACED.format(q=QID, scored='scored')} SELECT query, string_agg(doc, ',' ORDER BY rank) AS top_5 FROM placed WHERE rank <= 5 GROUP BY query) t USING (query)",
    "d14_failures": LOO + ", k AS (SELECT CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in (("spatial_relational_confusion", _any(SPATIAL)), ("dense_small_objects", _any(DENSE)), ("generic_repetitive_caption", "w <= 4"), ("fine_grained_attribute_mismatch", _any(ATTRIBUTES)))) + f" ELSE 'broad_geographic_context' END AS kind FROM ranks JOIN (SELECT {QID} AS query, lower(text) AS low, {SPACES} AS w FROM captions) USING (query) WHERE rank > 10) SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 3) AS pct FROM k GROUP BY kind",
    "d1_corpus": f"WITH {SQL_CAPTIONS} SELECT category, count(DISTINCT image_id) AS images, count(*) AS captions, round(avg({SPACES}), 6) AS mean_words FROM captions GROUP BY ROLLUP (category)",
    "h10_prompts": f"WITH {SQL_CAPTIONS}, forms AS (SELECT unnest(range(5))::INT AS form, unnest({list(PROMPTS)}) AS f) SELECT {QID} AS query, form, replace(f, '%s', regexp_replace(trim(text), '[.!?]+$', '')) AS prompt FROM captions, forms",
    "h11_leakage": f"WITH {SQL_CAPTIONS} SELECT lower(trim(text)) AS text, count(DISTINCT image_id) AS images FROM captions GROUP BY ALL HAVING images > 1",
}
