"""Exact top-k search by BM25 over an inverted index in shards.

Each shard is an inverted index of some documents: for every term its postings in
document order, cut into blocks of documents, with the largest contribution in each
block (before idf, which is global). A query of a few terms walks the shard's blocks from the
highest upper bound (the sum over its terms of block maxima) down, and stops at blocks whose
bound is below the k-th best score so far (block-max WAND). Bounds leave little out where a whole
document is the query: those are scored together, as matrix products over the terms that many
queries share with many documents (of a kind, as terms go with languages and lengths), plus the
postings of their other terms; what rounding could put among the k best is scored again in full. The shards' top k are merged. Document
counts, frequencies and the mean length are the whole corpus's, so the merged result is exact.

Queries come in blocks of bounded size, each sent to some shards and then, with the k-th best
scores found there as bounds, to all others; a block's results are settled before the next one
goes out, so neither plans nor broadcasts pile up.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import settle, slices, texts, tidied

#: Documents in a block; postings in a shard, about; queries sent out at once, and their terms, about.
BLOCK, SHARD_POSTINGS, QUERIES, QUERY_TERMS = 32, 1_500_000, 8_000, 3_000_000
#: Of so many tasks' shards those of one are asked first.
FIRST = 8
#: How much more blocks are scored between two looks at the bounds; partial results of a query that meet first.
WIDEN, GROUPS = 16, 64

#: Terms of a query that walks blocks, at most.
FEW = 16
#: Kinds of documents in a shard; common terms that may be columns of matrices. A term is a column for queries and documents of two
#: kinds if it is in so large a share of their pairs (a posting takes the time of about 400 columns); columns and cells of a matrix, at most.
KINDS, COMMON, SHARE, COLUMNS, CELLS = 8, 4096, 0.0025, 1024, 8_000_000
#: Parts of a shard whose best documents bound the k-th best score.
PARTS = 16

#: Covers sums in another order and scores that tie after rounding.
SLACK = 1e-8


@dataclass
class Shard:
    ids: np.ndarray  # document ids, in shard order
    terms: np.ndarray  # sorted term hashes
    cells: np.ndarray  # for each term where its blocks begin, one more at the end
    blocks: np.ndarray  # for each cell (term, block) its block
    starts: np.ndarray  # for each cell where its postings begin, one more at the end
    docs: np.ndarray  # for each posting its document's place
    parts: np.ndarray  # for each posting tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
    most: np.ndarray  # for each cell the largest part


def postings(held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """What is stored of a shard of (id, length, terms, tf): ids, lengths, terms, their ends, places and tf by term and place."""
    ids, lengths = (np.array([x[c] for x in held], np.int64) for c in (0, 1))
    places = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x[2]) for x in held])
    terms, tf = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    ends = np.flatnonzero(np.append(terms[1:] != terms[:-1], np.ones(min(len(terms), 1), bool))) + 1
    return [ids, lengths, terms[ends - 1], ends, places[order], tf[order].astype(np.uint32)]


def contributions(lengths: np.ndarray, tf: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    """Of each posting what its score is before idf."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths / mean))


def load(stored: list[np.ndarray], mean: float, k1: float, b: float) -> Shard:
    """Blocks and their maxima from stored postings."""
    ids, lengths, terms, ends, docs, tf = stored
    docs = docs.astype(np.int64)
    parts = contributions(lengths[docs], tf.astype(np.float64), mean, k1, b)
    begins = np.zeros(len(docs), bool)
    begins[(ends - np.diff(ends, prepend=0)) if len(ends) else []] = True
    starts = np.flatnonzero(begins | (np.diff(docs // BLOCK, prepend=-1) != 0))
    cells = np.append(np.flatnonzero(begins[starts]), len(starts))
    most = np.maximum.reduceat(parts, starts) if len(starts) else np.zeros(0)
    return Shard(ids, terms, cells, docs[starts] // BLOCK, np.append(starts, len(docs)), docs, parts, most)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the number of each one's range."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), owner


def top(shard: Shard, terms: np.ndarray, idf: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the shard's k best documents that share a term with the query, ties by id; none below ``least``."""
    n = len(shard.ids)
    at = np.minimum(np.searchsorted(shard.terms, terms), max(len(shard.terms) - 1, 0))
    there = shard.terms[at] == terms if len(shard.terms) else np.zeros(len(terms), bool)
    at, idf = at[there], idf[there]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0)
    cells, owner = _ranges(shard.cells[at], shard.cells[at + 1])
    weight = idf[owner]
    n_blocks = -(-n // BLOCK)
    bound = np.bincount(shard.blocks[cells], shard.most[cells] * weight, n_blocks)
    scores = np.zeros(n)
    waiting = np.argsort(-bound, kind="stable")
    waiting = waiting[bound[waiting] > 0]
    ahead = max(2, -(-k // BLOCK))
    while len(waiting):
        waiting = waiting[bound[waiting] >= least - SLACK]
        if not len(waiting):
            break
        now, waiting = waiting[:ahead], waiting[ahead:]
        chosen = np.zeros(n_blocks, bool)
        chosen[now] = True
        mine = chosen[shard.blocks[cells]]
        postings, cell = _ranges(shard.starts[cells[mine]], shard.starts[cells[mine] + 1])
        scores += np.bincount(shard.docs[postings], shard.parts[postings] * weight[mine][cell], n)
        if n >= k:
            least = max(least, np.partition(scores, n - k)[n - k])
        ahead *= WIDEN
    found = np.flatnonzero((scores > 0) & (scores >= least - SLACK))
    if len(found) > k:
        found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k] - SLACK]
    found = found[ranked(shard.ids[found], scores[found], k)]
    return found, scores[found]


def kinds(held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each document's number of KINDS kinds: the nearest of as many centres by cosine over common terms. Bounds times, not results."""
    some = np.concatenate([x[2] for x in held[:: -(-len(held) // 500)]])
    terms, n = np.unique(some, return_counts=True)
    if not len(terms):
        return np.zeros(len(held), np.int64)
    common = np.sort(terms[np.argsort(-n, kind="stable")[:256]])
    vectors = np.zeros((len(held), len(common)), np.float32)
    for vector, (_, _, terms, _) in zip(vectors, held, strict=True):
        at = np.minimum(np.searchsorted(terms, common), len(terms) - 1)
        vector[:] = terms[at] == common if len(terms) else 0
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    vectors = unit(vectors)
    centres = vectors[np.linspace(0, len(held) - 1, KINDS).astype(int)]
    for _ in range(6):
        kind = (vectors @ centres.T).argmax(1)
        centres = unit(np.stack([vectors[kind == c].sum(0) if (kind == c).any() else centres[c] for c in range(KINDS)]))
    return kind


def together(stored: list[np.ndarray], cuts: np.ndarray, mean: float, k1: float, b: float, vocabulary: np.ndarray, idf: np.ndarray, queries: list[np.ndarray], k: int, least: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (its terms' places in the sorted vocabulary) what ``top`` gives, in any order, none below its ``least``; cuts: where kinds of documents begin in the shard, and its end.

    Single precision adds up what is not negative, so a sum of n numbers errs by a share of n * 2^-24 at most; documents
    within it of the k-th best get their scores from all their postings, in the order of terms.
    """
    ids, lengths, terms, ends, docs, tf = stored
    n, n_kinds = len(ids), len(cuts) - 1
    width = -(-n // PARTS) * PARTS
    # postings of asked terms, weighted; by term, and by document
    place = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    asked = vocabulary[place] == terms
    sizes = np.diff(ends, prepend=0)
    kept = np.repeat(asked, sizes)
    sizes, place, docs = sizes[asked], place[asked], docs[kept].astype(np.int64)
    parts = contributions(lengths[docs], tf[kept].astype(np.float64), mean, k1, b)
    parts *= np.repeat(idf[place], sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    order = np.argsort(docs.astype(np.uint16) if n <= 1 << 16 else docs, kind="stable")
    terms_of, parts_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], parts[order]
    edges = np.append(0, np.cumsum(np.bincount(docs, minlength=n)))
    del kept, order
    number = np.full(len(vocabulary), -1, np.int32)
    number[place] = np.arange(len(place))
    mine = [(x := number[q])[x >= 0] for q in queries]

    # of common terms: documents and postings of each kind, and the kind that is most like each query
    common = np.sort(np.argsort(-sizes, kind="stable")[:COMMON])
    spot = np.full(len(sizes), -1, np.int32)
    spot[common] = np.arange(len(common))
    counts = np.stack([np.bincount(terms_of[edges[a] : edges[b]], minlength=len(sizes))[common] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], axis=1)
    upto = begins[common][:, None] + np.cumsum(counts, axis=1)
    since = upto - counts
    share = counts / np.maximum(np.diff(cuts), 1)
    like = share / np.maximum(np.linalg.norm(share, axis=0), 1e-9)
    spots = [(x := spot[t])[x >= 0] for t in mine]
    kind = np.array([like[x].sum(0).argmax() for x in spots])

    out = [(np.zeros(0, np.int64), np.zeros(0))] * len(mine)
    holds = np.zeros(len(sizes))
    rows = max(1, CELLS // 4 // width)
    for alike in (np.flatnonzero(kind == c) for c in np.unique(kind)):
        pairs = np.bincount(np.concatenate([spots[q] for q in alike]), minlength=len(common))[:, None] / len(alike) * share
        heads = [np.flatnonzero(x > SHARE) for x in pairs.T]
        heads = [h[np.argsort(-x[h], kind="stable")[: min(COLUMNS, CELLS // width)]] for h, x in zip(heads, pairs.T, strict=True)]
        matrices, dense = [], np.zeros(share.shape, bool)
        for c, head in enumerate(heads):
            dense[head, c] = True
            matrix = np.zeros((cuts[c + 1] - cuts[c], len(head)), np.float32)
            at, owner = _ranges(since[head, c], upto[head, c])
            matrix[docs[at] - cuts[c], owner] = parts[at]
            matrices.append(matrix)
        error = (max(map(len, heads)) + 4) * 2.0**-23
        whole = np.append(~dense.any(1), True)  # terms that are no column for any kind, uncommon ones at the end
        loose = ~dense & (counts > 0)
        for some in (alike[x : x + rows] for x in range(0, len(alike), rows)):
            has = np.zeros((len(some), len(common)), np.float32)
            for i, q in enumerate(some):
                has[i, spots[q]] = 1
            product = np.zeros((len(some), width), np.float32)
            for c, (head, matrix) in enumerate(zip(heads, matrices, strict=True)):
                product[:, cuts[c] : cuts[c + 1]] = has[:, head] @ matrix.T
            for i, q in enumerate(some):
                terms = mine[q]
                rest = terms[whole[spot[terms]]]
                mixed = spots[q][~whole[spots[q]]]
                x, c = np.nonzero(loose[mixed])
                x = mixed[x]
                begin, size = np.concatenate([begins[rest], since[x, c]]), np.concatenate([sizes[rest], counts[x, c]])
                at = np.ones(size.sum(), np.int64)  # steps between places: sums of them are faster than _ranges
                if len(at):
                    at[0] = begin[0]
                    at[np.cumsum(size[:-1])] += begin[1:] - begin[:-1] - size[:-1]
                    np.cumsum(at, out=at)
                about = np.bincount(docs[at], parts[at], width) + product[i]
                bound = least[q]
                if not bound and width >= k * PARTS:
                    # k parts have a document each that is no worse than the k-th best of the parts' best
                    best = about.reshape(PARTS, -1).max(0)
                    bound = np.partition(best, len(best) - k)[len(best) - k] * (1 - error)
                cut = bound * (1 - error) - SLACK
                found = np.flatnonzero(about >= cut if cut > 0 else about)
                if not len(found):
                    continue
                holds[terms] = 1
                scores = np.array([holds[terms_of[a:b]] @ parts_of[a:b] for a, b in zip(edges[found].tolist(), edges[found + 1].tolist(), strict=True)])
                holds[terms] = 0
                keep = np.flatnonzero(scores >= least[q] - SLACK)
                if len(keep) > k:
                    keep = ranked(ids[found], scores, k)
                out[q] = found[keep], scores[keep]
    return out


def ranked(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best by score to nine decimals, ties by id."""
    return np.lexsort((ids, -np.round(scores, 9)))[:k]


def _counted(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    words = (text or b"").lower().split()
    terms, n = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), return_counts=True)
    return terms, n, len(words)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): for each query its k best documents, rank from 1.

    ``docs`` has doc_id and text, ``queries`` query_id and text; a query is the set of all its
    words (runs without ASCII white space, A-Z lower-cased). Score: sum over shared words of
    ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)).
    Ties go to the smaller doc_id. Documents without a shared word don't count, so a query may
    have fewer than k rows, and one without words none. Rows with a null id are not searched
    or asked; repeated rows count as documents of their own and may hold several ranks; an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    queries = queries.where("query_id is not null").select("query_id", "text")

    def index(batches):
        """Shards of a task's documents, a new one where the postings of one would grow beyond bounds."""
        held, size = [], 0
        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                terms, n, length = _counted(text)
                held.append((i, length, terms, n))
                size += len(terms)
            if size > SHARD_POSTINGS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held):
        kind = kinds(held)
        stored = [*postings([held[i] for i in np.argsort(kind, kind="stable")]), np.append(0, np.cumsum(np.bincount(kind, minlength=KINDS)))]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in stored], names=fields)

    fields = ["ids", "lengths", "terms", "ends", "docs", "tf", "cuts"]
    numbers = [np.int64, np.int64, np.uint64, np.int64, np.uint32, np.uint32, np.int64]
    indexed = settle(docs.mapInArrow(tidied(index), ", ".join(f"{f} binary" for f in fields)))

    def sized(batches):
        for batch in batches:
            lengths = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in lengths], pa.int64()), pa.array([int(x.sum()) for x in lengths], pa.int64())], names=["n", "words"])

    n_docs, total = (x or 0 for x in indexed.mapInArrow(tidied(sized), "n long, words long").agg(F.sum("n"), F.sum("words")).first())
    mean = max(total / n_docs if n_docs else 0.0, 1e-9)

    def measure(batches):
        for batch in slices(batches):
            terms = [_counted(t)[0] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in terms], pa.int64()), pa.array([x.tobytes() for x in terms], pa.binary())], names=["id", "n", "terms"])

    asked = settle(queries.select(F.col("query_id").cast("long"), "text").mapInArrow(tidied(measure), "id long, n long, terms binary").where("n > 0").withColumn("row", F.monotonically_increasing_id()))

    def shard_terms(batches):
        for batch in batches:
            for terms, ends in zip(*(batch.column(fields.index(f)).to_pylist() for f in ("terms", "ends")), strict=True):
                n = np.diff(np.frombuffer(ends, np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(n), pa.array(np.zeros(len(n), bool))], names=["term", "n", "asked"])

    def query_terms(batches):
        for batch in batches:
            terms = np.unique(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.zeros(len(terms), np.int64)), pa.array(np.ones(len(terms), bool))], names=["term", "n", "asked"])

    # in how many documents each asked term is; a row for each term of a shard, however many queries there are
    both = indexed.mapInArrow(tidied(shard_terms), "term long, n long, asked boolean").unionByName(asked.mapInArrow(tidied(query_terms), "term long, n long, asked boolean"))
    frequent = settle(both.groupBy("term").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")).where("asked and n > 0").select("term", "n"))

    results = None
    n_asked, n_terms = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    width = max(1, -(-n_asked // QUERIES), -(-n_terms // QUERY_TERMS))
    for part in range(width):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(width)) == part).collect()  # about QUERIES queries or QUERY_TERMS terms
        ends = np.cumsum([r.n for r in block], dtype=np.int64)
        wanted = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.terms, np.uint64) for r in block)])
        vocabulary = np.unique(wanted)
        asks = spark.sparkContext.broadcast(vocabulary)

        def of_block(batches, asks=asks):
            for batch in batches:
                terms = batch.column(0).to_numpy().view(np.uint64)
                if len(asks.value):
                    yield batch.filter(pa.array(asks.value[np.minimum(np.searchsorted(asks.value, terms), len(asks.value) - 1)] == terms))

        df = frequent.mapInArrow(tidied(of_block), "term long, n long").toPandas()
        df_terms, df_n = df["term"].to_numpy(np.int64).view(np.uint64), df["n"].to_numpy(np.float64)
        idf = np.zeros(len(vocabulary))
        idf[np.searchsorted(vocabulary, df_terms)] = np.log(1 + (n_docs - df_n + 0.5) / (df_n + 0.5))
        plan = spark.sparkContext.broadcast(([(r.row, r.id) for r in block], idf, np.searchsorted(vocabulary, wanted).astype(np.int32), ends))
        del block, wanted

        def ask(batches, bounds, asks=asks, plan=plan):
            rows, idf, wanted, ends = plan.value
            wanted = np.split(wanted, ends)[:-1]  # each query's terms, as places in the vocabulary
            few, many = ([q for q, x in enumerate(wanted) if (len(x) <= FEW) == short] for short in (True, False))
            none = np.zeros(0, np.int64), np.zeros(0)
            best = [none] * len(rows)  # each query's k best of this task's shards
            least = lambda q: max(bounds[q], best[q][1][-1] if len(best[q][1]) == k else 0.0)
            for batch in batches:
                for i in range(batch.num_rows):  # a row is a shard
                    row = [batch.column(f)[i].as_buffer() for f in fields]
                    *stored, cuts = [np.frombuffer(x, number) for x, number in zip(row, numbers, strict=True)]
                    shard = load(stored, mean, k1, b) if few else None
                    more = [(q, top(shard, asks.value[wanted[q]], idf[wanted[q]], k, least(q))) for q in few]
                    del shard
                    if many:
                        more += zip(many, together(stored, cuts, mean, k1, b, asks.value, idf, [wanted[q] for q in many], k, [least(q) for q in many]), strict=True)
                    for q, (places, points) in more:
                        if len(places):
                            ids, scores = np.concatenate([best[q][0], stored[0][places]]), np.concatenate([best[q][1], points])
                            keep = ranked(ids, scores, k)
                            best[q] = ids[keep], scores[keep]
            held = [(*row, *found) for row, found in zip(rows, best, strict=True) if len(found[0])]
            columns = [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([x[2].tolist() for x in held], pa.list_(pa.int64())), pa.array([x[3].tolist() for x in held], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "query_id", "ids", "scores"])

        def found(shards, bounds):
            held = shards.mapInArrow(tidied(lambda batches: ask(batches, bounds)), "row long, query_id long, ids array<long>, scores array<double>")
            # k entries at most from each task
            entries = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-F.round(x["scores"], 9)).alias("by"), x["ids"].alias("doc_id"), x["scores"].alias("score")))
            return held.select("row", "query_id", entries.alias("best"))

        def merged(held):
            best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
            return held.groupBy("row", "query_id", (F.spark_partition_id() % GROUPS).alias("group")).agg(best).groupBy("row", "query_id").agg(best)

        early = F.spark_partition_id() % FIRST == 0
        some = settle(merged(found(indexed.where(early), np.zeros(len(ends)))))
        kth = dict(some.where(F.size("best") == k).select("row", F.col("best")[k - 1]["score"]).collect())
        whole = merged(some.unionByName(found(indexed.where(~early), np.array([kth.get(row, 0.0) for row, _ in plan.value[0]]))))
        settled = settle(whole.select("query_id", F.posexplode("best").alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), "x.doc_id", "x.score"))
        asks.unpersist()
        plan.unpersist()
        results = settled if results is None else results.unionByName(settled)
    return results
