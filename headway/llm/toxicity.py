"""Toxicity by the labels of the nearest examples.

Examples: labelled rows that are not held out, one of each group of equal texts
and labels, at most ``MAX_EXAMPLES`` of them (those with the smallest hash of
doc_id). Their terms are whole words and word beginnings of ``PREFIXES`` letters,
all of them; a text's vector holds, for each of these terms in it,
(1 + log occurrences) * idf * (how well the term tells labels apart), and has
length 1. Idf comes from all documents. The last factor is z2 / (z2 + SHRINK),
z2 being a chi-square that is shrunk for rare terms; near copies (examples with
the same least hash of three words) share one vote in it.

Scoring: the examples stand in blocks of ``BLOCK``; for each term and block that
holds it the index has the postings and their largest weight. The largest weights
bound the cosine of any example of a block with a document. The blocks with the
highest bounds are scored first, then all whose bound reaches the K-th best so
far, so the K nearest are exact (equal cosines, to 5 places, by smaller doc_id).
Their labels, weighted by cosine and drawn to the prior, give a vote, and an
isotonic fit turns it into a score. It is fitted on votes on the examples
themselves, by ``FOLDS`` folds: terms, index and neighbours of a vote come from the
other folds only, and near copies share a fold. Evidence are the doc_ids of the
nearest examples. Held-out figures are in the README.

Scale: the examples, and with them terms and postings, are bounded by
``MAX_EXAMPLES`` and broadcast; documents are read twice for idf and scores and
never shuffled. Each time the words of a few texts are split and told apart by
Arrow and looked up once, as most are in no example. Only (doc_id, digest) of rows
meets the labels.

Null and empty texts, and others without any known term, have no neighbours; their
vote is the toxic share of such examples, drawn to the prior. Very long texts are
read whole. Unlabelled and null labels teach nothing; of several labels for a
doc_id the largest counts. Repeated rows are scored each, and teach once; of rows
with one doc_id and different texts each teaches. Ties are stated above. Without
examples of both labels every score is the prior (0 without any). An empty table
gives no rows. Columns besides doc_id and text are ignored or, by ``keep_clean``,
passed on, so names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.base import let, named_back, plainly_named, words, written

MAX_EXAMPLES = 2_000
PREFIXES = (4,)
SHRINK, FOLDS = 30.0, 4
K, BLOCK, OFTEN, FIRST_BLOCKS, PRIOR_WEIGHT, STEPS = 15, 64, 16, 4, 1.0, 5
THRESHOLD = 0.3
#: Texts whose cosines are begun together; texts, and about as many bytes of them, whose words are told apart together.
TOGETHER, FEW, FEW_BYTES = 64, 256, 1_000_000
EDGES = ".,;:!?*&$%#|<>\"'()[]{}-_/\\"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def terms_of(word: str) -> list[str]:
    """``=word`` and its beginnings; a word is lower-cased and bare of marks at its ends."""
    w = word.strip(EDGES).lower()
    return [f"={w}", *(w[:k] for k in PREFIXES if len(w) > k)] if w else []


class Vocabulary:
    """Terms by number, found by whole word and by beginning."""

    def __init__(self, terms: list[str]):
        self.size = len(terms)
        self.whole = {t[1:]: i for i, t in enumerate(terms) if t[0] == "=" and len(t) > 1}
        self.starts = {k: {t: i for i, t in enumerate(terms) if len(t) == k} for k in PREFIXES}

    def numbers(self, bare: list[str]) -> np.ndarray:
        """The numbers of the terms of words that are bare of marks at their ends, a row each; -1 where there is none."""
        # Lower-cased as one text: no word border changes what a letter becomes.
        lower = "\n".join(bare).lower().split("\n") if bare else []
        found = np.full((len(lower), 1 + len(self.starts)), -1, np.int64)
        found[:, 0] = np.fromiter(map(self.whole.get, lower, repeat(-1)), np.int64, len(lower))
        for at, (k, number) in enumerate(self.starts.items(), 1):
            found[:, at] = np.fromiter((number.get(w[:k], -1) if len(w) > k else -1 for w in lower), np.int64, len(lower))
        return found

    def entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's entries begin, and by entry, sorted, a term in the text and how often it occurs.

        Words are split and told apart by Arrow, so Python sees each different word of the texts once.
        """
        words = pc.utf8_split_whitespace(texts.fill_null(""))  # white space is that of str.split
        coded = words.flatten().dictionary_encode()
        bare = pc.utf8_trim(coded.dictionary, characters=EDGES).to_numpy(zero_copy_only=False).tolist()
        found, code = self.numbers(bare), coded.indices.to_numpy()
        base = np.repeat(np.arange(len(texts)) * self.size, words.value_lengths().to_numpy())
        keys = []
        for numbers in found.T:
            number = numbers[code]
            on = number >= 0
            keys.append(base[on] + number[on])
        key = np.concatenate(keys)
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        first = np.searchsorted(key[at], np.arange(len(texts) + 1) * self.size)
        return first, (key[at] % max(self.size, 1)).astype(np.int32), np.diff(np.append(at, len(key))).astype(np.int32)

    def counts(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """By text, the numbers of its terms, sorted, and how often each occurs."""
        first, terms, n = self.entries(texts)
        return [(terms[a:b], n[a:b]) for a, b in pairwise(first.tolist())]


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and how long each range is."""
    size = ends - starts
    total = np.cumsum(size)
    return np.repeat(starts - total + size, size) + np.arange(total[-1] if len(total) else 0), size


@dataclass
class Index:
    """Unit vectors as postings by term and block.

    Term t has the segments first[t] to first[t + 1]; a segment is one block's
    part of its postings, from start on, with the largest weight among them. The
    few terms that more than one in ``OFTEN`` examples hold have no segments but
    a row of ``rows`` (row[t], or -1), a weight for every example.
    """

    size: int
    ids: np.ndarray
    labels: np.ndarray
    row: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    block: np.ndarray
    start: np.ndarray
    largest: np.ndarray
    place: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int) -> Index:
        """``owner``, ``terms`` and ``weights`` are the entries of all vectors."""
        n, heaviest, top = len(ids), np.full(len(ids), -1, np.int64), np.zeros(len(ids))
        # Examples whose heaviest term is the same stand together, which keeps the largest weights of blocks sharp.
        np.maximum.at(top, owner, weights)
        is_top = weights >= top[owner]
        np.maximum.at(heaviest, owner[is_top], terms[is_top])
        order = np.lexsort((ids, heaviest))
        seat = np.empty(n, np.int64)
        seat[order] = np.arange(n)
        row, often = np.full(n_terms, -1, np.int32), np.flatnonzero(np.bincount(terms, minlength=n_terms) * OFTEN > n)
        row[often] = np.arange(len(often))
        wide = row[terms] >= 0
        rows = np.zeros((len(often), -(-n // BLOCK) * BLOCK), np.float32)
        rows[row[terms[wide]], seat[owner[wide]]] = weights[wide]
        owner, terms, weights = owner[~wide], terms[~wide], weights[~wide]
        by = np.lexsort((seat[owner], terms))
        t, place, weight = terms[by].astype(np.int64), seat[owner][by].astype(np.int32), weights[by].astype(np.float32)
        key = t * (n // BLOCK + 1) + place // BLOCK
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        largest = np.maximum.reduceat(weight, start) if len(start) else np.zeros(0, np.float32)
        first = np.searchsorted(t[start], np.arange(n_terms + 1)).astype(np.int32)
        return cls(BLOCK, ids[order], labels[order], row, rows, first, place[start] // BLOCK, np.append(start, len(t)).astype(np.int32), largest, place, weight)

    def by_rows(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms with rows add to the cosines of some vectors with all examples."""
        q = np.zeros((len(vectors), len(self.rows)), np.float32)
        for own, (terms, weights) in zip(q, vectors, strict=True):
            row = self.row[terms]
            own[row[row >= 0]] = weights[row >= 0]
        return q @ self.rows

    def nearest(self, terms: np.ndarray, weights: np.ndarray, added: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest with a cosine above 0; ``added`` is the vector's row of :meth:`by_rows`."""
        scores, rare = added.astype(float), self.row[terms] < 0
        terms, weights = terms[rare], weights[rare]
        segments, size = _spread(self.first[terms], self.first[terms + 1])
        if len(segments):
            q, block = np.repeat(weights, size), self.block[segments]
            bound = scores.reshape(-1, self.size).max(1) + np.bincount(block, q * self.largest[segments], len(scores) // self.size)
            chosen = np.zeros(len(bound), bool)
            chosen[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
            self._add(segments, q, chosen[block], scores)
            kth = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
            rest = (bound >= kth - 1e-4) & ~chosen
            if rest.any():
                self._add(segments, q, rest[block], scores)
        rounded = np.round(scores[: len(self.ids)], 5)
        at = np.flatnonzero(rounded >= max(np.partition(rounded, -k)[-k] if len(rounded) > k else 0.0, 1e-5))
        at = at[np.lexsort((self.ids[at], -rounded[at]))][:k]
        return at, rounded[at]

    def _add(self, segments: np.ndarray, q: np.ndarray, on: np.ndarray, scores: np.ndarray) -> None:
        segments = segments[on]
        places, size = _spread(self.start[segments], self.start[segments + 1])
        scores += np.bincount(self.place[places], np.repeat(q[on], size) * self.weight[places], len(scores))


@dataclass
class Model:
    terms: list[str]
    weight: np.ndarray
    index: Index | None
    prior: float
    bare: float
    votes: np.ndarray
    scores: np.ndarray

    def votes_on(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[float], list[list[int]]]:
        """Votes and evidence of texts, given by their terms and counts."""
        votes, evidence = [], []
        for low in range(0, len(counted), TOGETHER):
            vectors = [unit(*c, self.weight) for c in counted[low : low + TOGETHER]]
            added = self.index.by_rows(vectors) if self.index is not None else [None] * len(vectors)
            for (terms, weights), row in zip(vectors, added, strict=True):
                if not len(terms) or self.index is None:
                    votes.append(self.bare)
                    evidence.append([])
                    continue
                at, cosine = self.index.nearest(terms, weights, row)
                # Drawn to the share among texts without known terms, so few and far neighbours say little.
                votes.append(float((cosine @ self.index.labels[at] + PRIOR_WEIGHT * self.bare) / (cosine.sum() + PRIOR_WEIGHT)))
                evidence.append(self.index.ids[at[:STEPS]].tolist())
        return votes, evidence

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.votes, self.scores) if len(self.votes) else np.clip(votes, 0, 1)


def unit(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of weight above 0, and their part of the text's vector of length 1."""
    raw = (1 + np.log(counts)) * weight[terms]
    on = raw > 0
    return terms[on], raw[on] / math.sqrt(float(raw[on] @ raw[on])) if on.any() else raw[on]


def telling(owner: np.ndarray, terms: np.ndarray, labels: np.ndarray, share: np.ndarray, n_terms: int) -> np.ndarray:
    """By term, from 0 to 1, how well its presence tells labels apart; an example counts ``share``."""
    toxic = float(share @ labels) / max(float(share.sum()), 1e-9)
    held = np.bincount(terms, share[owner], n_terms)
    bad = np.bincount(terms, (share * labels)[owner], n_terms)
    z2 = (bad - held * toxic) ** 2 / (held * toxic * (1 - toxic) + 1)
    return z2 / (z2 + SHRINK)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step fit of y over x, by pooling neighbours that fall."""
    pools: list[list[float]] = []  # sum of y, number, sum of x
    for i in np.argsort(x, kind="stable"):
        pools.append([float(y[i]), 1, float(x[i])])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([s / n for _, n, s in pools]), np.array([s / n for s, n, _ in pools])


def _few(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts of a batch, a few at a time, so that Python holds no batch of words and vectors; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        fit = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + FEW_BYTES, "right"))
        high = max(low + 1, min(low + FEW, fit))
        yield texts.slice(low, high - low)
        low = high


def examples(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, label, body and sign of at most ``limit`` examples, as a written table."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    bodies = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    present = bodies.select("doc_id", "digest").join(known, "doc_id").groupBy("digest", "label").agg(F.min("doc_id").alias("doc_id"))
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id", "digest", "label").limit(limit)
    rows = bodies.join(F.broadcast(chosen), ["doc_id", "digest"])  # at most ``limit`` rows of a digest and two numbers
    hashes = lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    sign = let(words(F.col("body")), lambda ws: F.coalesce(F.array_min(hashes(ws)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest", "label").orderBy(F.lit(0)))
    rows = rows.withColumn("_nth", nth).filter("_nth = 1")  # equal rows teach once
    return written(rows.select("doc_id", "label", "body", sign.alias("sign")))


def document_frequencies(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many there are."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df = Vocabulary(sent.value), np.zeros(len(sent.value) + 1, np.int64)
        for batch in batches:
            for bodies in _few(batch.column("body")):
                df[:-1] += np.bincount(vocabulary.entries(bodies)[1], minlength=vocabulary.size)
                df[-1] += len(bodies)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["number", "n"])

    got = docs.select(F.coalesce("text", F.lit("")).alias("body")).mapInArrow(run, "number int, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    df = np.bincount(got.column("number").to_numpy(), got.column("n").to_numpy(), len(terms) + 1).astype(np.int64)
    return df[:-1], int(df[-1])


def vocabulary_of(rows: DataFrame) -> list[str]:
    """All terms of the examples, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {t for body in batch.column("body").to_pylist() for w in set(body.split()) for t in terms_of(w)}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["term"])

    return sorted(rows.select("body").mapInArrow(run, "term string").distinct().toArrow().column("term").to_pylist())


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES) -> Model:
    rows = examples(docs, labels, limit)
    terms = vocabulary_of(rows)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        for batch in batches:
            found = [c for bodies in _few(batch.column("body")) for c in vocabulary.counts(bodies)]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label", "sign")), *lists], ["doc_id", "label", "sign", "at", "n"])

    got = rows.select("doc_id", "label", "sign", "body").mapInArrow(run, "doc_id long, label int, sign long, at array<int>, n array<int>").toArrow()
    got = got.combine_chunks().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("sign", "ascending")])
    ids, label, sign = (got.column(c).to_numpy() for c in ("doc_id", "label", "sign"))
    prior = float(label.mean()) if len(label) else 0.0
    if not 0 < prior < 1:
        return Model([], np.zeros(0), None, prior, prior, np.zeros(0), np.zeros(0))
    at, n = got.column("at").combine_chunks(), got.column("n").combine_chunks().flatten().to_numpy()
    owner, flat = np.repeat(np.arange(len(ids)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()
    df, total = document_frequencies(docs, terms)
    return fitted(terms, np.log((1 + total) / (1 + df)) + 1, ids, label, sign, owner, flat, n)


def fitted(terms: list[str], idf: np.ndarray, ids: np.ndarray, label: np.ndarray, sign: np.ndarray, owner: np.ndarray, flat: np.ndarray, n: np.ndarray) -> Model:
    """The model of examples whose terms are the entries (owner, flat, n)."""
    prior, size = float(label.mean()), len(ids)
    _, group, together = np.unique(sign, return_inverse=True, return_counts=True)
    share, fold = 1.0 / together[group], group % FOLDS
    full = np.bincount(owner, minlength=size) > 0
    bare = (float(label[~full].sum()) + prior) / (int((~full).sum()) + 1)
    entries = np.searchsorted(owner, np.arange(size + 1))

    def over(use: np.ndarray) -> Model:
        on = use[owner]
        weight = idf * telling(owner[on], flat[on], label, share * use, len(terms))
        raw = (1 + np.log(n)) * weight[flat]
        norm = np.sqrt(np.bincount(owner, raw * raw, size))
        on &= (raw > 0) & (norm[owner] > 0)
        kept = np.flatnonzero(np.bincount(owner[on], minlength=size))
        seat = np.full(size, -1)
        seat[kept] = np.arange(len(kept))
        index = Index.of(ids[kept], label[kept], seat[owner[on]], flat[on], raw[on] / norm[owner[on]], len(terms)) if len(kept) else None
        return Model(terms, weight, index, prior, bare, np.zeros(0), np.zeros(0))

    votes = np.empty(size)
    for f in range(FOLDS):
        model, test = over(fold != f), np.flatnonzero(fold == f)
        votes[test] = model.votes_on([(flat[entries[i] : entries[i + 1]], n[entries[i] : entries[i + 1]]) for i in test])[0]
    model = over(np.ones(size, bool))
    model.votes, model.scores = isotonic(votes, label.astype(float))
    return model


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row: ``keep``, score, predicted and evidence (doc_ids of the nearest examples). The text goes to the model once, also if it is kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        vocabulary = Vocabulary(m.terms)
        for batch in batches:
            votes, evidence = [], []
            for bodies in _few(batch.column(text)):
                some = m.votes_on(vocabulary.counts(bodies))
                votes += some[0]
                evidence += some[1]
            rest = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(m.calibrated(np.array(votes))), pa.array(evidence, pa.list_(pa.int64()))], [*keep, "score", "evidence"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    out = docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, f"{fields}, score double, evidence array<long>")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def judge(docs: DataFrame, labels: DataFrame, limit: int = MAX_EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row."""
    return scored(docs, fit(docs, labels, limit)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    rows, names = plainly_named(docs)
    kept = scored(rows, fit(docs, labels), tuple(names.values()), names["text"]).filter("predicted = 0")
    return named_back(kept, names)
