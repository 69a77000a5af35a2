"""Three ways to find chunks for a batch of questions, and point lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.text import tokenize
from lodestone.operators.index import B, K1
from lodestone.scale import cut_lineage, in_blocks, over_blocks, running_totals, spread

#: Fixed values.
VECTOR_TOP, LEXICAL_TOP, CATEGORY_LEAST = 20, 20, 3


def ranked(rows: DataFrame, score: str = "score", key: str = "chunk_id", top: int | None = None) -> DataFrame:
    """Add ``rank`` by question: higher scores first, then by key.

    A bounded rank is pushed into the sort as a group limit, before the rows are moved; an unbounded one takes a question's hits over as
    many tasks as they need.
    """
    order = [F.col(score).desc(), F.col(key).asc()]
    if top is None:
        placed = running_totals(rows, ["qid"], order, {"_before": F.lit(1)})
        return placed.withColumn("rank", (F.col("_before") + 1).cast("int")).drop("_before")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= top)


def exact_hits(keys: DataFrame, index: DataFrame, mode: str = "strict") -> DataFrame:
    """``(qid, chunk_id, score)`` of every chunk under a question's keys; ``keys`` is ``(qid, kind, key)``.

    In ``strict`` mode the asked key loses all inner spaces while the index keeps them, so keys of several words never meet;
    ``normalized`` drops them on both sides. There is no limit on the hits.
    """
    asked = asked_keys(keys)
    held = index.withColumn("key", F.regexp_replace("key", r"(?U)\s+", "")) if mode == "normalized" else index
    return asked.join(held, ["kind", "key"]).groupBy("qid", "chunk_id").agg(F.lit(1.0).alias("score"))


def asked_keys(keys: DataFrame) -> DataFrame:
    """``(qid, kind, key)`` as they are looked up, each once."""
    return keys.select("qid", "kind", F.upper(F.regexp_replace("key", r"(?U)\s+", "")).alias("key")).filter(F.col("key") != "").distinct()


def exact_ranks(keys: DataFrame, index: DataFrame, others: DataFrame, top: int) -> DataFrame:
    """``(qid, chunk_id, score, rank)`` of :func:`exact_hits` in strict mode, ranked among all of a question, but only those that are its first ``top`` or stand
    in ``others``, ``(qid, chunk_id)``, for it or another question of the same keys. Of an index that does not repeat.

    The hits all have one score, so a rank is the number of hits up to an id: those under each key of the question, less those that were counted before
    under another of its keys. Questions of the same keys are one, and no list of all hits of a question is made.
    """
    asked = cut_lineage(asked_keys(keys))
    held = cut_lineage(index.select("kind", "key", "chunk_id").join(asked.select("kind", "key").distinct(), ["kind", "key"], "left_semi"))
    by = cut_lineage(asked.groupBy("qid").agg(F.sort_array(F.collect_set(F.struct("kind", "key"))).alias("keys")))  # one text's keys
    sets = cut_lineage(by.groupBy("keys").agg(F.min("qid").alias("set")))
    member = sets.select("set", F.explode("keys").alias("k")).select("set", "k.kind", "k.key")
    same = by.join(sets, "keys").select("qid", "set")

    def first(rows: DataFrame, *group: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("chunk_id"))).filter(F.col("rank") <= top)

    begun = cut_lineage(first(first(held, "kind", "key").join(member, ["kind", "key"]).select("set", "chunk_id").distinct(), "set"))
    wanted = others.select("qid", "chunk_id").join(same, "qid").select("set", "chunk_id").distinct().join(begun, ["set", "chunk_id"], "left_anti")
    wanted = cut_lineage(wanted.join(member, "set").join(held, ["kind", "key", "chunk_id"], "left_semi").select("set", "chunk_id").distinct())

    def pairs(rows: DataFrame, by: str) -> DataFrame:
        k = F.struct("kind", "key")
        return rows.select(by, k.alias("k1")).join(rows.select(by, k.alias("k2")), by).filter(F.col("k1") < F.col("k2"))

    # of m keys of a set that a chunk holds there are m * (m - 1) / 2 pairs, and m - 1 are too many
    twice = pairs(held, "chunk_id").join(pairs(member, "set"), ["k1", "k2"]).groupBy("set", "chunk_id").agg(F.count(F.lit(1)).alias("p"))
    extra = F.round((F.sqrt(1 + 8 * F.col("p")) - 1) / 2).cast("long")
    no_key, no_set = [F.lit(None).cast("string").alias(c) for c in ("kind", "key")], F.lit(None).cast(keys.schema["qid"].dataType)
    rows = held.select("kind", "key", no_set.alias("set"), "chunk_id", F.lit(1).cast("long").alias("n"), no_set.alias("by"))
    rows = rows.unionByName(twice.select(*no_key, "set", "chunk_id", (-extra).alias("n"), no_set.alias("by")))
    rows = rows.unionByName(wanted.join(member, "set").select("kind", "key", no_set.alias("set"), "chunk_id", F.lit(0).cast("long").alias("n"), F.col("set").alias("by")))
    rows = rows.unionByName(wanted.select(*no_key, "set", "chunk_id", F.lit(0).cast("long").alias("n"), F.col("set").alias("by")))
    # null comes first: what is counted before what asks
    placed = running_totals(rows, ["kind", "key", "set"], [F.col("chunk_id").asc(), F.col("by").asc_nulls_first()], {"_before": F.col("n")})
    later = placed.filter(F.col("by").isNotNull()).groupBy(F.col("by").alias("set"), "chunk_id").agg(F.sum("_before").cast("int").alias("rank"))
    return begun.unionByName(later).join(same, "set").select("qid", "chunk_id", F.lit(1.0).alias("score"), "rank")


def posting_weights(post: DataFrame, lengths: DataFrame, terms: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``(term, key, weight)``: what a posting adds to a document's score, whatever the question."""
    mean = lengths.agg(F.avg("dl").alias("avgdl"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return post.join(terms, "term").join(lengths, key).join(F.broadcast(mean)).select("term", key, (F.col("idf") * tf).alias("weight"))


def asked_terms(questions: DataFrame, text: str = "text") -> DataFrame:
    """``(qid, term, times)``"""
    return questions.select("qid", F.explode(tokenize(F.col(text))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def lexical_scores(questions: DataFrame, post: DataFrame, lengths: DataFrame, terms: DataFrame, text: str = "text", key: str = "chunk_id") -> DataFrame:
    """``(qid, key, score)`` of every document by the usual lexical score; a term asked twice counts twice; only positive scores stay.

    It emits every match, as one who wants all scores must; :func:`lexical_topk` finds the best without.
    """
    hits = posting_weights(post, lengths, terms, key).join(asked_terms(questions, text), "term")
    # rounded, so that ranks do not hang on the order of additions
    scored = hits.groupBy("qid", key).agg(F.round(F.sum(F.col("times") * F.col("weight")), 9).alias("score"))
    return scored.filter(F.col("score") > 0)


#: Postings that are scored at once.
SLAB = 1_000_000
#: Of so many documents one is scored first, for the floors of the others.
FIRST = 8


Bag = list[tuple[int, int]]


def alike(bags: list[Bag]) -> list[tuple[Bag, list[tuple[int, int, int]]]]:
    """Bags of terms in groups that share all but one term: ``(shared, [(number of the bag, its own term, times)])``.

    A bag goes where most others would go, so that what is shared is scored for all of them at once; one that is like no other is a group of its own.
    """
    pairs: dict[tuple[int, int], int] = {}
    flat = np.array([pairs.setdefault(p, len(pairs)) for bag in bags for p in bag], dtype=np.int64)
    starts = np.cumsum([0] + [len(bag) for bag in bags])
    drawn = np.random.default_rng(0).integers(0, 2**63, len(pairs), dtype=np.uint64)[flat]  # sums of them tell bags apart well enough to count
    left = np.repeat(np.add.reduceat(drawn, starts[:-1]), np.diff(starts)) - drawn
    _, same, counts = np.unique(left, return_inverse=True, return_counts=True)
    counts = counts[same]
    out: dict[tuple, list[tuple[int, int, int]]] = {}
    for k, bag in enumerate(bags):
        own = int(counts[starts[k] : starts[k + 1]].argmax())
        out.setdefault((*bag[:own], *bag[own + 1 :]), []).append((k, *bag[own]))
    return [(list(shared), members) for shared, members in out.items()]


class _Slab:
    """The postings of some whole documents, by term, with which many questions are scored.

    ``docs`` are numbered in the order of their keys.
    """

    def __init__(self, size: int, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray, terms_in_all: int) -> None:
        order = np.argsort(terms * size + docs)
        self.size, self.docs, self.weights = size, docs[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(terms_in_all + 1)).tolist()
        self.columns: dict[int, np.ndarray] = {}

    def column(self, term: int) -> np.ndarray | None:
        """The weights of a common term in all documents, spread out once."""
        a, b = self.starts[term], self.starts[term + 1]
        if 8 * (b - a) < self.size or a == b:
            return None
        if term not in self.columns:
            self.columns[term] = np.zeros(self.size)
            self.columns[term][self.docs[a:b]] = self.weights[a:b]
        return self.columns[term]

    def at(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The weights of a term in some documents, zero in those without it."""
        column = self.column(term)
        if column is not None:
            return column[docs]
        a, b = self.starts[term], self.starts[term + 1]
        if a == b:
            return np.zeros(len(docs))
        held = self.docs[a:b]
        places = np.minimum(np.searchsorted(held, docs), b - a - 1)
        return np.where(held[places] == docs, self.weights[a:b][places], 0.0)

    def shared(self, bag: Bag) -> np.ndarray:
        """The score of every document by a bag of terms."""
        spans, total = [], None
        for t, n in bag:
            column = self.column(t)
            if column is None:
                spans.append((self.starts[t], self.starts[t + 1], n))
            elif total is None:
                total = column * n
            else:
                total += column if n == 1 else column * n
        spans = [x for x in spans if x[0] < x[1]]
        if not spans:
            return np.zeros(self.size) if total is None else total
        rare = np.bincount(np.concatenate([self.docs[a:b] for a, b, _ in spans]), np.concatenate([self.weights[a:b] * n for a, b, n in spans]), self.size)
        return rare if total is None else total + rare

    def best(self, group: tuple[Bag, list[tuple[int, int, int]]], top: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(bag, documents, scores)`` of a group of :func:`alike`: each bag's ``top`` best documents whose score is positive and not below the bag's floor,
        by score, then by key. Without any, the bag is left out.

        A document comes into question by what is shared alone, or by holding the bag's own term.
        """
        base = self.shared(group[0])
        needed = {k: max(floors[k] - 1e-8, 1e-300) for k, _, _ in group[1]}  # scores are rounded at nine places
        high = np.nonzero(base >= min(needed.values()))[0]
        reached = base[high]
        for k, t, n in group[1]:
            a, b = self.starts[t], self.starts[t + 1]
            docs = high[reached >= needed[k]]
            if a < b:
                held = self.docs[a:b]
                held = held[base[held] + self.weights[a:b] * n >= needed[k]]
                docs = np.union1d(docs, held) if len(docs) and len(held) else held if len(held) else docs
            if not len(docs):
                continue
            scores = np.round(base[docs] + self.at(t, docs) * n, 9)
            good = np.nonzero((scores > 0) & (scores >= floors[k]))[0]
            if len(good) > top:
                good = good[scores[good] >= np.partition(scores[good], -top)[-top]]
            good = good[np.argsort(-scores[good], kind="stable")][:top]
            if len(good):
                yield k, docs[good], scores[good]


def _slabs(batches: Iterator[pa.RecordBatch], words: list[str], idf: np.ndarray, mean: float, first: int) -> Iterator[tuple[pa.Array, _Slab]]:
    """Keys in their order, and the asked postings of their documents: of the first ``first`` postings or so, then of :data:`SLAB` at a time."""
    values, held, size, most = pa.array(words, pa.string()), [], 0, first

    def slab() -> tuple[pa.Array, _Slab]:
        keys = pa.concat_arrays([k for k, *_ in held])
        order = pc.sort_indices(keys)
        place = np.empty(len(keys), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(keys))
        before = np.cumsum([0] + [len(k) for k, *_ in held])
        docs = place[np.concatenate([d + n for (_, d, _, _), n in zip(held, before, strict=False)])]
        return keys.take(order), _Slab(len(keys), docs, np.concatenate([t for *_, t, _ in held]), np.concatenate([w for *_, w in held]), len(words))

    for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
        keys, lists = batch.column(0), batch.column(2)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        terms = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        docs, asked = np.repeat(np.arange(len(keys)), lengths), terms >= 0
        docs, terms, tf = docs[asked], terms[asked], batch.column(3).flatten().to_numpy(zero_copy_only=False)[asked]
        dl = batch.column(1).to_numpy(zero_copy_only=False).astype(float)[docs]
        weights = idf[terms] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)))
        ends = np.cumsum(np.bincount(docs, minlength=len(keys)))
        at = 0
        while at < len(keys):
            done = ends[at - 1] if at else 0
            end = min(len(keys), int(np.searchsorted(ends, done + most - size)) + 1)  # whole documents, one at least
            held.append((keys.slice(at, end - at), docs[done : ends[end - 1]] - at, terms[done : ends[end - 1]], weights[done : ends[end - 1]]))
            size += int(ends[end - 1] - done)
            at = end
            if size >= most:
                yield slab()
                held, size, most = [], 0, SLAB
    if held:
        yield slab()


def lexical_topk(
    questions: DataFrame, post: DataFrame, lengths: DataFrame, terms: DataFrame, text: str = "text", key: str = "chunk_id", top: int = LEXICAL_TOP, block: int = 50_000, block_bytes: int = 64 << 20
) -> DataFrame:
    """``(qid, key, score, rank)`` of the ``top`` best documents of each question by :func:`lexical_scores`, exact.

    ``post`` are postings, which are gathered by document, or ``index.bags``. Questions of the same terms are asked once. They are held in blocks of at most ``block``
    and ``block_bytes`` bytes of terms, or one, each of which is broadcast. A task scores its documents for all questions of a block, those that share all but
    one term together (:func:`alike`), and hands on the best ``top`` of each. One document of :data:`FIRST` is scored first: what ``top`` of these reach is the
    floor of a question, and no document below it leaves a task.
    """
    spark = questions.sparkSession
    types = {"qid": questions.schema["qid"].dataType, key: post.schema[key].dataType}
    schema = f"qid {types['qid'].simpleString()}, {key} {types[key].simpleString()}, score double"
    if "tfs" in post.columns:
        docs = post.select(key, "dl", "terms", "tfs")
    else:
        rows = post.groupBy(key).agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("p")).join(lengths, key)
        docs = cut_lineage(rows.select(key, "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs")))
    mean = lengths.agg(F.avg("dl").alias("avgdl")).first()["avgdl"]
    asked = asked_terms(questions, text).join(terms.select("term", "idf"), "term")
    by = cut_lineage(asked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "times", "idf"))).alias("terms")))  # one text's words
    one = cut_lineage(by.groupBy("terms").agg(F.min("qid").alias("asker")))
    order = F.pmod(F.xxhash64(key), F.lit(FIRST)) == 0
    docs = spread(docs)
    parts = docs.rdd.getNumPartitions()

    def scored(shared: Broadcast, rows: DataFrame, floors: np.ndarray | None) -> DataFrame:
        asker_type = to_arrow_type(types["qid"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            askers, words, idf, groups = shared.value
            names = pa.array(askers, asker_type)
            least = np.zeros(len(askers)) if floors is None else floors.copy()

            def batch(keys: pa.Array, found: list) -> pa.RecordBatch:
                who = np.repeat([k for k, *_ in found], [len(d) for _, d, _ in found])
                columns = [names.take(pa.array(who)), keys.take(pa.array(np.concatenate([d for _, d, _ in found]))), pa.array(np.concatenate([s for *_, s in found]))]
                return pa.RecordBatch.from_arrays(columns, names=["qid", key, "score"])

            for keys, slab in _slabs(batches, words, idf, mean, SLAB // 32 if floors is None else SLAB):
                found = []
                for group in groups:
                    for k, best, scores in slab.best(group, top, least):
                        found.append((k, best, scores))
                        if len(scores) == top:
                            least[k] = max(least[k], scores[-1])
                    if len(found) >= 5000:
                        yield batch(keys, found)
                        found = []
                if found:
                    yield batch(keys, found)

        return rows.mapInArrow(score, schema)

    def run(shared: Broadcast) -> DataFrame:
        begun = docs.filter(order).coalesce(max(spark.sparkContext.defaultParallelism, parts // FIRST))
        first = cut_lineage(ranked(scored(shared, begun, None), key=key, top=top))
        numbers = {q: k for k, q in enumerate(shared.value[0])}
        floors = np.zeros(len(numbers))
        for r in first.filter(F.col("rank") == top).select("qid", "score").toLocalIterator():
            floors[numbers[r["qid"]]] = r["score"]
        return first.drop("rank").unionByName(scored(shared, docs.filter(~order), floors))

    def blocks() -> Iterator[tuple]:
        told = ((r["asker"], r["terms"]) for r in one.toLocalIterator())
        for held in in_blocks(told, block, block_bytes, lambda x: sum(64 + len(t["term"]) for t in x[1])):
            numbers: dict[str, int] = {}
            idf = {t["term"]: t["idf"] for _, bag in held for t in bag}
            bags = [[(numbers.setdefault(t["term"], len(numbers)), t["times"]) for t in bag] for _, bag in held]
            yield [q for q, _ in held], list(numbers), np.array([idf[w] for w in numbers]), alike(bags)

    found = over_blocks(spark, blocks(), run)
    best = ranked(spark.createDataFrame([], schema) if found is None else found, key=key, top=top).withColumnRenamed("qid", "asker")
    same = by.join(one.withColumnRenamed("asker", "_asker"), "terms").select("qid", "_asker")
    return best.join(same, F.col("asker").eqNullSafe(F.col("_asker"))).select("qid", key, "score", "rank")


def similarity(cosine: Column) -> Column:
    """From a cosine: half its distance from one, not below zero."""
    return F.greatest(F.lit(0.0), 1 - (1 - cosine) / 2)


def matrix_of(units: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, without a copy by Python."""
    return units.flatten().to_numpy(zero_copy_only=False).reshape(len(units), -1)


def nearest(
    queries: DataFrame, vectors: DataFrame, key: str = "vec_id", top: int = VECTOR_TOP, category: str | None = None, block: int = 2000, block_bytes: int = 64 << 20
) -> DataFrame:
    """``(qid, key, score)`` of the ``top`` nearest unit vectors of each query, exact, by cosine.

    ``queries`` is ``(qid, unit[, category])``. It is held in blocks of at most ``block`` vectors and ``block_bytes`` bytes, or one vector, each of which is broadcast and passed over
    all vectors as one matrix product a batch; every partition keeps its best ``top`` for each query, which the final rank merges. With
    ``category``, a query takes only vectors of its category if at least three of the ``top`` are left so, else all; null, empty and
    ``general`` take all.
    """
    columns = ["qid", "unit"] + ([category] if category else [])
    types = {"qid": queries.schema["qid"].dataType.simpleString(), "key": vectors.schema[key].dataType.simpleString()}
    schema = f"qid {types['qid']}, {key} {types['key']}, score double, wanted boolean"
    batch_types = {k: {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[v] for k, v in types.items()}

    def over(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, kinds = [q for q, _, _ in shared.value], [c for _, _, c in shared.value]
            matrix = np.vstack([v for _, v, _ in shared.value])
            best: list[list] = [[] for _ in ids]
            same: list[list] = [[] for _ in ids]
            floor, same_floor = np.full(len(ids), -1.0), np.full(len(ids), -1.0)

            def take(held: list[list], least: np.ndarray, j: int, col: np.ndarray, names: list, rows: np.ndarray, mine: bool) -> None:
                held[j] = sorted(held[j] + [(-col[i], names[i], mine) for i in rows])[:top]
                if len(held[j]) == top:
                    least[j] = -held[j][-1][0]

            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    names = piece.column(0).to_pylist()
                    scores = np.maximum(0.0, 1 - (1 - matrix_of(piece.column(1)) @ matrix.T) / 2)
                    # only queries that this piece can better are looked at
                    for j in np.nonzero((scores >= floor).any(axis=0))[0]:
                        col = scores[:, j]
                        edge = np.partition(col, -top)[-top] if len(col) > top else -1.0
                        take(best, floor, j, col, names, np.nonzero(col >= max(edge, floor[j]))[0], False)
                    if category:
                        groups = np.array([g or "" for g in piece.column(2).to_pylist()])
                        for j in np.nonzero((scores >= same_floor).any(axis=0))[0]:
                            if kinds[j] not in (None, "", "general"):
                                col = scores[:, j]
                                take(same, same_floor, j, col, names, np.nonzero((groups == kinds[j]) & (col >= same_floor[j]))[0], True)
            rows = [(q, n, -s, w) for q, a, b in zip(ids, best, same, strict=True) for s, n, w in a + b]
            if rows:
                q, n, s, w = zip(*rows, strict=True)
                kind = batch_types
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, kind["qid"]), pa.array(n, kind["key"]), pa.array(s, pa.float64()), pa.array(w, pa.bool_())], names=["qid", key, "score", "wanted"]
                )

        return vectors.select(key, "unit", *([category] if category else [])).mapInArrow(run, schema)

    asked = ((r["qid"], np.array(r["unit"]), r[category] if category else None) for r in queries.select(*columns).toLocalIterator())
    found = over_blocks(vectors.sparkSession, in_blocks(asked, block, block_bytes, lambda x: x[1].nbytes), over)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    if category:
        w = Window.partitionBy("qid")
        enough = F.least(F.count_if(F.col("wanted")).over(w), F.lit(top)) >= CATEGORY_LEAST
        found = found.withColumn("_enough", enough).filter(F.col("wanted") == F.col("_enough")).drop("_enough")
    return ranked(found.drop("wanted"), key=key, top=top)


def lookup(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of the given ids; ids that do not exist are skipped."""
    return ids.join(chunks, "chunk_id")
