"""Batched hybrid retrieval: BM25 and cosine legs, weighted reciprocal-rank fusion, rerank interleaving, budgets.

Every operator works on many queries at once and partitions its windows by query. What the reference-style engine would recompute per
query (tokens, lengths, document frequencies, norms) is computed once per corpus. Scores are rounded before ranking, so
the order of summation can't flip ties, and every order ends in a reference.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as Y
from pyspark.sql.pandas.types import to_arrow_schema

from attestor import scratch
from attestor.functions import text as T

# Fixed values of the ranking functions and budgets.
K1, B = 1.5, 0.75
RRF_K = 60
CROSS_LINGUAL_WEIGHT = 0.1
SNIPPET = 500
RERANK_DEPTH = 40
DIGITS = 9
#: Queries whose vectors a task holds at once.
QUERY_BLOCK = 4096


def postings(passages: DataFrame, vocabulary: DataFrame | None = None, ref: str = "ref", text: str = "text") -> DataFrame:
    """(term, ref, dl, tf): each passage's terms with its length; only those of the vocabulary (term), if there is one, leave the scan."""
    rows = passages.select(F.col(ref).alias("ref"), T.tokens(F.col(text)).alias("t"))
    rows = rows.select("ref", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    if vocabulary is not None:
        rows = rows.join(vocabulary, "term", "left_semi")
    return rows.groupBy("term", "ref", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(passages: DataFrame, text: str = "text") -> DataFrame:
    """One row: the number of passages, empty ones too, and their mean length."""
    return passages.agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(F.col(text)))).alias("avgdl"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term"))


def bm25(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ref, score) for passages that hold a term of the query. The scan keeps only what some query asks for before it is shuffled."""
    asked = query_terms(queries)
    vocabulary = asked.select("term").distinct()
    hits = postings(passages, vocabulary)
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(corpus_stats(passages))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = hits.join(frequency, "term").crossJoin(stats).select("term", "ref", weight.alias("w"))
    return weighed.join(asked, "term").groupBy("query_id", "ref").agg(F.round(F.sum("w"), DIGITS).alias("score"))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds the ordinal rank of each query's rows; with k, only the first k, which prunes before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref")
    out = scores.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def has_length(vector: Column) -> Column:
    """Whether a vector (array<double>) has a direction: some component, all of them numbers."""
    return F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def units(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1))[:, None]


#: Scores that a task holds at once, next to what they are summed from.
CELLS = 1 << 21
#: Scores are compared before they are rounded; what rounding can add is less than this.
MARGIN = 1e-8


class Sweep:
    """Scores of passages against a block of queries: all of them, or the k best of each query that a task has seen, equal ones by reference.

    With ``counted``, queries bring wanted passages along in order (``wanted_scores`` from high to low, ``wanted_refs`` rising within equal scores), and it is
    told of each how many passages come before it but not before the one above it. How passages are scored is up to ``matrices``.
    """

    #: Scores below aren't in a ranking.
    LEAST = -np.inf

    def __init__(self, asks: pd.DataFrame, k: int | None, counted: bool = False):
        self.k, self.counted = k, counted
        self.groups: dict[int, np.ndarray] = {}  # ids of queries by what they can be compared with
        self.least: dict[int, np.ndarray] = {}
        self.held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        told = zip(asks["query_id"], asks["wanted_scores"], asks["wanted_refs"], strict=True) if counted else ()
        self.wanted = {q: (-np.asarray(s, "f8"), list(r)) for q, s, r in told if s is not None and len(s)}
        self.counts = {q: np.zeros(len(r) + 1, "i8") for q, (_, r) in self.wanted.items()}

    def group(self, name: int, ids: np.ndarray) -> None:
        self.groups[name], self.least[name], self.held[name] = ids, np.full(len(ids), -np.inf), []

    def matrices(self, rows: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(group, references, scores before they are rounded: at most ``most`` passages by queries; less than LEAST where a passage isn't in a query's ranking)."""
        raise NotImplementedError

    def batch(self, rows: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        most = max(1, CELLS // max([1, *map(len, self.groups.values())]))
        for name, refs, got in self.matrices(rows, most):
            ids = self.groups[name]
            if self.k is None or self.wanted:
                exact = np.where(got >= self.LEAST, np.round(got, DIGITS), -np.inf)
                self.count(ids, refs, exact)
            if self.k is None:
                yield pd.DataFrame({"query_id": np.tile(ids, len(refs)), "ref": np.repeat(refs, len(ids)), "score": exact.ravel()})
                continue
            if self.k < len(refs) and not self.held[name]:  # a first bound; later ones come from what is held
                self.least[name] = np.maximum(self.least[name], -np.partition(-got, self.k - 1, axis=0)[self.k - 1])
            i, j = np.nonzero(got >= np.maximum(self.least[name] - MARGIN, self.LEAST))
            self.held[name].append((j.astype("i4"), refs[i], np.round(got[i, j], DIGITS)))
            if sum(len(x[0]) for x in self.held[name]) > 2 * self.k * len(ids):
                self.shrink(name)

    def count(self, ids: np.ndarray, refs: np.ndarray, got: np.ndarray) -> None:
        for j, q in enumerate(ids) if self.wanted else ():
            if q not in self.wanted:
                continue
            falling, names = self.wanted[q]
            some = np.flatnonzero(got[:, j] >= -falling[-1])
            score = -got[some, j]
            left, at = np.searchsorted(falling, score, "left"), np.searchsorted(falling, score, "right")
            for i in np.flatnonzero(left < at):  # equal scores: the lesser reference comes first
                at[i] = bisect.bisect_right(names, refs[some[i]], left[i], at[i])
            self.counts[q] += np.bincount(at, minlength=len(names) + 1)

    def shrink(self, name: int) -> tuple[np.ndarray, ...]:
        """The k best that are held of each query: their numbers, references and scores."""
        j, ref, score = (np.concatenate(c) for c in zip(*self.held[name], strict=True))
        refs = np.unique(ref, return_inverse=True)[1] if ref.dtype == object else ref
        order = np.lexsort((refs, -score, j))
        j, ref, score = j[order], ref[order], score[order]
        at = np.arange(len(j))
        nth = at - np.maximum.accumulate(np.where(np.diff(j, prepend=-1) > 0, at, 0)) if len(j) else at
        last, kept = nth == self.k - 1, nth < self.k
        self.least[name][j[last]] = score[last]
        self.held[name] = [(j[kept], ref[kept], score[kept])]
        return self.held[name][0]

    def end(self) -> Iterator[pd.DataFrame]:
        for name, held in self.held.items():
            if held:
                j, ref, score = self.shrink(name)
                best = pd.DataFrame({"query_id": self.groups[name][j], "ref": ref, "score": score})
                yield best.assign(n=pd.array([None] * len(best), "Int64")) if self.counted else best
        for q, counts in self.counts.items():
            falling, names = self.wanted[q]
            if len(at := np.flatnonzero(counts[:-1])):
                yield pd.DataFrame({"query_id": [q] * len(at), "ref": [names[i] for i in at], "score": -falling[at], "n": counts[at]})


class Cosines(Sweep):
    """Rows (v) of passages against rows of queries of the same width."""

    def __init__(self, asks: pd.DataFrame, k: int | None, counted: bool = False):
        super().__init__(asks, k, counted)
        self.units = {}
        for width, own in asks.groupby(asks["v"].map(len)):
            self.group(width, own["query_id"].to_numpy())
            self.units[width] = units(np.stack(own["v"]))

    def matrices(self, rows: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        refs, v = (rows.column(c) for c in ("ref", "v"))
        refs, flat = refs.to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
        widths = np.asarray(v.value_lengths(), "i8")
        starts = np.cumsum(widths) - widths
        for width in np.intersect1d(widths, list(self.units)):
            own = np.flatnonzero(widths == width)
            for at in range(0, len(own), most):
                some = own[at : at + most]
                yield int(width), refs[some], units(flat[starts[some][:, None] + np.arange(width)]) @ self.units[width].T


def vectors(rows: DataFrame, *names: str) -> DataFrame:
    """Rows (``names``, vector) with the vector as v, array<double>; vectors without length take no part."""
    return rows.select(*names, F.col("vector").cast("array<double>").alias("v")).where(has_length(F.col("v")))


def past(passages: DataFrame, queries: DataFrame, work: Callable[[pd.DataFrame], Sweep], schema: str) -> DataFrame:
    """Every passage past a block of queries, where it is read: each task holds the block; the driver hands it over as Arrow, never as objects."""
    kind, asks = to_arrow_schema(Y.StructType.fromDDL(schema)), queries.toArrow()  # a block

    def stay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = work(asks.to_pandas())
        for pdf in (pdf for rows in batches for pdf in held.batch(rows)):
            yield pa.RecordBatch.from_pandas(pdf, kind, preserve_index=False)
        for pdf in held.end():
            yield pa.RecordBatch.from_pandas(pdf, kind, preserve_index=False)

    return passages.mapInArrow(stay, schema)


def blocks(queries: DataFrame, block: int) -> Iterator[DataFrame]:
    """Written queries (query_id and more) in blocks of about ``block``, as many as that takes and one at least."""
    many = max(1, -(-queries.count() // block))
    return (queries.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == i) if many > 1 else queries for i in range(many))


def sweep(passages: DataFrame, queries: DataFrame, work: Callable[[pd.DataFrame], Sweep], counted: bool = False, block: int = QUERY_BLOCK, schema: str | None = None, deal: int | None = None, many: int | None = None) -> DataFrame:
    """Every passage (ref and what ``work`` scores) past every query (query_id and what it asks for; written, as it is read twice): rows (query_id, ref, score) and, if ``counted``, n.

    Queries are dealt in blocks of at most ``block``; a task holds a block and streams passages past it. The passages of one block stay where they
    are read; further blocks cost a copy of the passages each, dealt over all tasks (with ``deal``, about so many together, if that makes fewer parts). ``schema``: of the rows, if ``work`` tells others.
    ``many``: the number of queries, if it is known.
    """
    ref, query = passages.schema["ref"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = schema or f"query_id {query}, ref {ref}, score double" + ", n long" * counted
    kind = to_arrow_schema(Y.StructType.fromDDL(schema))
    blocks = max(1, -(-(queries.count() if many is None else many) // block))
    if blocks == 1:
        return past(passages, queries, work, schema)

    def told(rows: Iterable[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        return (pa.RecordBatch.from_pandas(pdf, kind, preserve_index=False) for pdf in rows)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("block", "salt", "asks")])
            starts = np.flatnonzero((np.diff(keys, prepend=-1) != 0).any(axis=0))
            for start, stop in zip(starts, [*starts[1:], len(batch)], strict=True):
                rows, (*place, mine) = batch.slice(start, stop - start), keys[:, start].tolist()
                if place != at:
                    if held:
                        yield from told(held.end())
                    at, waiting, held = place, [], None
                if mine:
                    waiting.append(rows)
                elif waiting:
                    held = held or work(pa.Table.from_batches(waiting).to_pandas())
                    yield from told(held.batch(rows))
        if held:
            yield from told(held.end())

    salts = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, min(salts, -(-passages.count() // deal))) if deal else salts
    own = {f.name: f.dataType for d in (queries, passages) for f in d.schema.fields if f.name not in ("query_id", "ref")}
    # keys are zero, not null, on the other side: a null would make floats of whole numbers
    column = lambda d, c: F.col(c) if c in d.columns else F.lit(0).cast(query if c == "query_id" else ref).alias(c) if c in ("query_id", "ref") else F.lit(None).cast(own[c]).alias(c)
    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = passages.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("salt", F.pmod(F.xxhash64("ref"), F.lit(salts)).cast("int"))
    dealt = lambda d, asks: d.select("block", "salt", F.lit(asks).alias("asks"), *(column(d, c) for c in ("query_id", "ref", *own)))
    rows = dealt(left, True).unionAll(dealt(right, False))
    # one after the other, not by a hash: so few keys would leave most tasks empty
    parts = blocks * salts if deal else min(blocks * salts, int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slot = F.pmod(F.col("block") * salts + F.col("salt"), F.lit(parts)).cast("int")
    return rows.repartitionById(parts, slot).sortWithinPartitions("block", "salt", F.desc("asks")).mapInArrow(stream, schema)


def cosine(passages: DataFrame, queries: DataFrame, k: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, ref, score) for every passage vector and query vector of its width, or for the k best of each query; vectors without length take no part.

    Exhaustive by definition: each query scores every passage.
    """
    return sweep(vectors(passages, "ref"), scratch.cut(vectors(queries, "query_id"), "query-vectors"), lambda asks: Cosines(asks, k), block=block)


def comparable(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id) of the queries for which ``cosine`` finds anything: those with a direction, of a width that some passage with a direction has. No pair is made."""
    width = lambda d, *names: vectors(d, *names).select(*names, F.size("v").alias("width"))
    return width(queries, "query_id").join(width(passages).distinct(), "width", "left_semi").select("query_id")


def fuse(lexical: DataFrame, vector: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings (query_id, ref, rank).

    ``weights`` (query_id, weight) discounts the lexical leg; it reweighs, it never removes. Gives lexical_rank, vector_rank, score, rank and via.
    """
    lex = lexical.select("query_id", "ref", F.col("rank").alias("lexical_rank"))
    vec = vector.select("query_id", "ref", F.col("rank").alias("vector_rank"))
    both = lex.join(vec, ["query_id", "ref"], "full")
    both = both.join(weights, "query_id", "left") if weights is not None else both.withColumn("weight", F.lit(1.0))
    score = F.coalesce(F.coalesce("weight", F.lit(1.0)) / (RRF_K + F.col("lexical_rank")), F.lit(0.0)) + F.coalesce(F.lit(1.0) / (RRF_K + F.col("vector_rank")), F.lit(0.0))
    via = F.when(F.col("vector_rank").isNull(), "bm25").when(F.col("lexical_rank").isNull(), "vector").otherwise("both")
    return ranked(both.select("query_id", "ref", "lexical_rank", "vector_rank", F.round(score, 12).alias("score"), via.alias("via")))


def language_weight(query_language: Column, corpus_language: Column) -> Column:
    """The lexical leg's weight: discounted only if both languages are known and differ."""
    known = query_language.isNotNull() & corpus_language.isNotNull()
    return F.when(known & (query_language != corpus_language), CROSS_LINGUAL_WEIGHT).otherwise(1.0)


def documents_of(ranking: DataFrame, document: str = "document_ref", k: int | None = None) -> DataFrame:
    """Documents in the order of their first passage: (query_id, document, first_rank, rank)."""
    first = ranking.groupBy("query_id", document).agg(F.min("rank").alias("first_rank"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", document)))
    return out.where(F.col("rank") <= k) if k else out


def interleave(ranking: DataFrame, document_order: DataFrame, depth: int = RERANK_DEPTH) -> DataFrame:
    """Passages of the reranked head: by their index in their document, then by the document's new rank; the tail keeps its order.

    ``ranking``: (query_id, ref, document_ref, rank); ``document_order``: (query_id, document_ref, new_rank) of the head's documents.
    """
    within = F.row_number().over(Window.partitionBy("query_id", "document_ref").orderBy("rank")) - 1
    rows = ranking.withColumn("index_in_document", within).join(document_order, ["query_id", "document_ref"], "left")
    head = F.col("new_rank").isNotNull()
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, F.col("index_in_document")).otherwise(0), F.coalesce("new_rank", "rank"), "ref")
    return rows.withColumn("final_rank", F.row_number().over(order))


def snippet_size(text: Column, snippet: int = SNIPPET) -> Column:
    return F.least(F.length(text), F.lit(snippet))


def truncate(ranking: DataFrame, max_candidates: int, max_characters: int, snippet: int = SNIPPET) -> DataFrame:
    """Matches (query_id, ref, rank, text) until the candidates or the characters run out; the last snippet is clipped. Rows with ``size``, a snippet's length, instead of the text are told without one."""
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("size") if "size" in ranking.columns else snippet_size(F.col("text"), snippet)
    rows = ranking.withColumn("prior", F.coalesce(F.sum(size).over(before), F.lit(0))).where((F.col("rank") <= max_candidates) & (F.col("prior") < max_characters))
    if "size" in ranking.columns:
        return rows.drop("prior", "size")
    return rows.withColumn("snippet", F.substring("text", F.lit(1), F.least(F.lit(snippet), F.lit(max_characters) - F.col("prior")).cast("int"))).drop("prior", "text")


def leg_notes(queries: DataFrame, lexical: DataFrame, vector: DataFrame | None) -> DataFrame:
    """Per query what its legs lacked: a leg that wasn't there, or one that found nothing; and whether that makes it partial."""
    def matched(leg: DataFrame, name: str) -> DataFrame:
        return leg.select("query_id").distinct().withColumn(name, F.lit(True))

    rows = queries.select("query_id").join(matched(lexical, "lex"), "query_id", "left")
    if vector is None:
        rows = rows.withColumn("vector_note", F.lit("vector_leg_unavailable"))
    else:
        rows = rows.join(matched(vector, "vec"), "query_id", "left").withColumn("vector_note", F.when(F.col("vec").isNull(), "vector_leg_no_matches"))
    notes = F.array_compact(F.array(F.when(F.col("lex").isNull(), "lexical_leg_no_matches"), F.col("vector_note")))
    shortfall = F.exists(notes, lambda n: ~(n.startswith("reranked:") | n.startswith("lexical_leg_discounted:")))
    return rows.select("query_id", notes.alias("notes"), F.when(shortfall, "partial").otherwise("complete").alias("status"))
