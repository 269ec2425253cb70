"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

The terms are all words of the labelled examples. A term's weight is that of TF-IDF, the inverse document frequency over all
documents, times how firmly the labels associate it with label 1 (the root of chi-squared, as in Debole and Sebastiani,
"Supervised Term Weighting for Automated Text Categorization", SAC 2003): a text is toxic by a few of its words, and the
cosine by TF-IDF alone compares the texts' subjects. No term is left out: all others keep a share of their weight, and texts
without any that is associated are compared by TF-IDF alone. The index has the examples' postings in blocks with the greatest weight of
each term in each block (Ding and Suel, "Faster Top-k Document Retrieval Using Block-Max Indexes", SIGIR 2011): the blocks with
the highest bounds are scored, then all others that could hold a nearer example, so the k nearest are exact. Votes weigh by
cosine and are calibrated on the examples themselves, each scored without itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm.common import text_bytes

#: Most labelled rows that are learned from: those with the least hash of their id. It bounds the index, too.
SAMPLE_ROWS = 4_000
NEIGHBOURS, BLOCK, FIRST_BLOCKS, DENSE = 15, 64, 8, 20
#: What a term weighs, times TF-IDF, besides its association with label 1.
REST = 0.3

# lower-cases A-Z and turns all ASCII that is no letter or digit into spaces
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are never learned from: CRC-32 of the id's text mod 3 is 1. A null id isn't one (nor is it learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of ``length[0]`` numbers, then those of first[1], and so on."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + length, length)


class BlockMaxIndex:
    """Examples as unit vectors. ``rows``: for each example its (term, weight) pairs; ``labels``: 0 or 1.

    Examples are put into blocks by their heaviest term, so that bounds tell blocks apart. Terms that one in ``DENSE`` examples
    has, or more, keep a weight for every example in place of postings.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_terms: int) -> None:
        self.labels = np.asarray(labels, float)
        n = len(rows)
        heaviest = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in rows], np.int64)
        self.number = np.argsort(heaviest, kind="stable")  # of the example at each place
        self.place = np.argsort(self.number)
        term = np.concatenate([t for t, _ in rows]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in rows]) if n else np.zeros(0)
        at = np.repeat(self.place, [len(t) for t, _ in rows]) if n else np.zeros(0, np.int64)
        self.blocks = -(-n // BLOCK)
        often = np.nonzero(np.bincount(term, minlength=n_terms) * DENSE >= max(n, 1))[0]
        self.row = np.full(n_terms, -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        dense = self.row[term] >= 0
        self.dense[self.row[term[dense]], at[dense]] = weight[dense]
        self.dense_greatest = np.maximum.reduceat(self.dense, np.arange(0, n, BLOCK), axis=1) if n else self.dense
        term, at, weight = term[~dense], at[~dense], weight[~dense]
        order = np.lexsort((at, term))
        self.at, self.weight = at[order].astype(np.int32), weight[order]
        # a list is a term's postings in a block
        key = term[order] * max(self.blocks, 1) + self.at // BLOCK
        lists, self.first = np.unique(key, return_index=True)
        self.length = np.diff(np.append(self.first, len(key)))
        self.greatest = np.maximum.reduceat(self.weight, self.first) if len(lists) else np.zeros(0)
        self.block = lists % max(self.blocks, 1)
        self.starts = np.searchsorted(lists, np.arange(n_terms + 1) * max(self.blocks, 1))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the ``k`` nearest with a cosine above 0, falling; ties by place. ``without``: not this one.

        The blocks with the highest bounds are scored first, then all others whose bound reaches the k-th cosine so far.
        """
        row = self.row[term]
        rows, by = row[row >= 0], weight[row >= 0].astype(np.float32)
        term, weight = term[row < 0], weight[row < 0]
        n = self.starts[term + 1] - self.starts[term]
        lists, query = _ranges(self.starts[term], n), np.repeat(weight, n)
        of = self.block[lists]
        bound = np.bincount(of, query * self.greatest[lists], minlength=self.blocks) + by @ self.dense_greatest[rows]
        scores, often = np.zeros(len(self.labels)), by @ self.dense[rows]

        def add(blocks: np.ndarray) -> float:
            """Scores the examples of blocks; the k-th best cosine of all so far."""
            chosen = np.zeros(self.blocks, bool)
            chosen[blocks] = True
            there = chosen[of]
            few = lists[there]
            postings = _ranges(self.first[few], self.length[few])
            scores[:] += np.bincount(self.at[postings], np.repeat(query[there], self.length[few]) * self.weight[postings], minlength=len(scores))
            scores[:] += often * np.repeat(chosen, BLOCK)[: len(scores)]
            if without >= 0:
                scores[self.place[without]] = 0
            return float(np.partition(scores, -k)[-k]) if len(scores) >= k else 0.0

        order = np.argsort(-bound, kind="stable")
        kth, rest = add(order[:FIRST_BLOCKS]), order[FIRST_BLOCKS:]
        rest = rest[(bound[rest] > 0) & (bound[rest] >= kth * (1 - 1e-6))]
        if len(rest):
            kth = add(rest)
        found = np.nonzero((scores > 0) & (scores >= kth))[0]
        top = found[np.lexsort((found, -scores[found]))[:k]]
        return self.number[top], scores[top]

    def vote(self, near: tuple[np.ndarray, np.ndarray], prior: float) -> float:
        """The share of label 1 by cosine, with one pseudo-neighbour of cosine 0.1 that has the prior."""
        e, s = near
        return float((s @ self.labels[e] + 0.1 * prior) / (s.sum() + 0.1))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (x, y) of the least-squares rising fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        pools.append([b, 1.0, a])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][2] == pools[-1][2]):
            m, n, a = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][1] + m * n) / (pools[-1][1] + n), pools[-1][1] + n, a]
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


def factors(with_label: np.ndarray, without: np.ndarray, n1: int, n0: int, idf: np.ndarray) -> np.ndarray:
    """A term's weight in a text that has it once. The arrays: examples of either label that have the term."""
    a, b, n = with_label.astype(float), without.astype(float), n1 + n0
    if not n1 or not n0:
        return idf.astype(float)
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / (n1 * n0 * np.maximum(a + b, 1) * np.maximum(n - a - b, 1))
    return idf * (REST + np.where(a * n0 > b * n1, np.sqrt(chi), 0.0))


class Scorer:
    """What the executors need: the terms' weights and the index; ``steps``: the calibration, once there is one."""

    def __init__(self, factor: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int = NEIGHBOURS) -> None:
        self.k, self.factor, self.labels = k, factor, np.asarray(labels, float)
        self.own = [self.vector(t, n) for t, n in examples]
        bare = self.labels[[not w.any() for _, w in self.own]] if len(self.own) else self.labels
        self.prior = float(self.labels.mean()) if len(self.labels) else 0.5
        # texts without any term: the share among such examples, with one more that has the prior
        self.bare = (float(bare.sum()) + self.prior) / (len(bare) + 1)
        self.index = BlockMaxIndex(self.own, self.labels, len(factor))
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(np.maximum(n, 1))) * self.factor[term]
        return term, w / (np.sqrt(w @ w) or 1.0)

    def held_vote(self, i: int) -> float:
        """The vote on example ``i`` by the others."""
        return self.index.vote(self.index.nearest(*self.own[i], self.k, i), self.prior)

    def score(self, term: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, nearest examples, their cosines)"""
        term, weight = self.vector(term, n)
        if not weight.any() or not len(self.labels):
            return self.bare, np.zeros(0, np.int64), np.zeros(0)
        near = self.index.nearest(term, weight, self.k)
        raw = self.index.vote(near, self.prior)
        if self.steps is None:
            return raw, *near
        # some of the raw vote keeps the order where the fit is flat
        return min(1.0, max(0.0, 0.9 * float(np.interp(raw, *self.steps)) + 0.1 * raw)), *near


def numbered(text: bytes, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(term, count) of the known terms of a text, ascending."""
    found = [k for k in map(known.get, terms(text)) if k is not None]
    return np.unique(np.array(found, np.int64), return_counts=True)


def labelled_terms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> pa.Table:
    """(id, label, terms) of at most ``sample_rows`` labelled documents, in order of id; terms are the different words of a text."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("label"))
    sample = F.broadcast(usable.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(sample_rows))  # bounded by sample_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.array(terms(t.as_py()), object), return_counts=True) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([t.tolist() for t, _ in found], pa.list_(pa.binary())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int64()))], names=["id", "label", "terms", "counts"])

    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("_text")).join(sample, "id")
    # of documents that repeat an id, the text that comes first
    once = texts.groupBy("id", "label").agg(F.min("_text").alias("_text")).select("_text", "id", "label")
    kind = once.schema["id"].dataType.simpleString()
    return once.mapInArrow(run, f"id {kind}, label int, terms array<binary>, counts array<long>").orderBy("id").toArrow()


def document_frequencies(docs: DataFrame, text_col: str, known, n_terms: int) -> tuple[int, np.ndarray]:
    """The number of rows, and of rows that have each term. ``known``: the broadcast numbers of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                df[numbered(text.as_py(), known.value)[0]] += 1
        term = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(df[term], rows))], names=["term", "n"])

    counted = docs.select(text_bytes(text_col).alias("_text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the sample
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(n_terms, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, calibrate_rows: int = SAMPLE_ROWS, k: int = NEIGHBOURS) -> DataFrame:
    """(id, held_out, score, evidence) for every row of ``docs``.

    ``evidence``: the nearest examples as (id, cosine, label), nearest first. ``sample_rows``: most labelled rows that are learned
    from; ``calibrate_rows``: most of them that the calibration is fitted on, evenly spaced by id. An id that is labelled more
    than once has label 1 if any of its labels is. Texts without any word that an example has, empty and null ones among them,
    get the share of label 1 among such examples. Without labels of both kinds all scores are the prior, 0.5 if there are none.
    Repeated rows are as many rows; an empty table gives an empty one; other columns are not read.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    sample = labelled_terms(docs, labels, id_col, text_col, label_col, sample_rows)
    ids, label = sample.column("id").combine_chunks(), sample.column("label").to_numpy().astype(float)
    words = sample.column("terms").combine_chunks()
    words = words if isinstance(words, pa.ListArray) else pa.concat_arrays(words.chunks)
    coded = words.flatten().dictionary_encode()
    n_terms, number = len(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = spark.sparkContext.broadcast({w: i for i, w in enumerate(coded.dictionary.to_pylist())})  # the sample's words
    sizes = np.diff(words.offsets.to_numpy())
    counts = sample.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    examples = list(zip(np.split(number, np.cumsum(sizes)[:-1]), np.split(counts, np.cumsum(sizes)[:-1]))) if len(sizes) else []
    hit = np.repeat(label, sizes)
    a, b = np.bincount(number, hit, minlength=n_terms), np.bincount(number, 1 - hit, minlength=n_terms)
    total, df = document_frequencies(docs, text_col, known, n_terms)
    scorer = Scorer(factors(a, b, int(label.sum()), int((1 - label).sum()), np.log((1 + total) / (1 + df))), examples, label, k)
    if 0 < label.sum() < len(label) and len(label) >= 50:
        tried = spark.range(0, len(label), max(1, -(-len(label) // calibrate_rows)), int(spark.conf.get("spark.sql.shuffle.partitions")))
        whole = spark.sparkContext.broadcast(scorer)

        def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([whole.value.held_vote(i) for i in batch.column(0).to_pylist()], pa.float64())], names=["i", "vote"])

        votes = tried.mapInArrow(left_out, "i long, vote double").orderBy("i").toArrow()  # calibrate_rows numbers at most
        scorer.steps = isotonic(votes.column("vote").to_numpy(), label[votes.column("i").to_numpy()])
        whole.unpersist()
    scorer.own = []
    del sample, words, coded, examples, hit
    ready = spark.sparkContext.broadcast((scorer, ids, pa.array(label.astype(np.int32))))
    evidence = pa.list_(pa.struct([("id", ids.type), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, named, marks = ready.value
        for batch in batches:
            found = [model.score(*numbered(text.as_py(), known.value)) for text in batch.column(0)]
            ends = np.cumsum([0, *(len(e) for _, e, _ in found)]).astype(np.int32)
            near = pa.array(np.concatenate([e for _, e, _ in found]) if found else np.zeros(0, np.int64))
            cosines = pa.array(np.concatenate([c for *_, c in found]) if found else np.zeros(0))
            held = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([named.take(near), cosines, marks.take(near)], names=["id", "cosine", "label"]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([s for s, *_ in found], pa.float64()), held.cast(evidence)], names=["id", "score", "evidence"])

    rows = docs.select(text_bytes(text_col).alias("_text"), F.col(id_col).alias("id"))
    out = rows.mapInArrow(run, f"id {kind}, score double, evidence array<struct<id:{kind},cosine:double,label:int>>")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "evidence")
