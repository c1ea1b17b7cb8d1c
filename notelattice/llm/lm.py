"""Language-model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

Tokens of a text are its words (A-Z folded) and one end. Their counts over all training texts are a distributed table
(partial sums by task, one shuffle). The probability of a word is factored by classes: the `head` most frequent words and
the end are classes of their own; every other word, seen in training or not, belongs to one of `kinds` classes by the hash
of its last three bytes (so endings, and languages, fall together), and has within it its smoothed share of the class's
training tokens. So every word of the corpus is modelled, as target and as context, however large the corpus is, and a
text's probability is normalised over all words and one slot of unseen ones in each class.

For a position with the two preceding tokens u, v the score of w is
    s(w | u, v) = q_w . (near * r_v + far * r_u) + b_w
and its log probability is s(w) less the log of the sum over the vocabulary. That sum separates over u and v, so the
normalisers of all contexts are one matrix product, and scoring is table look-up.

Training is data-parallel: in each of `rounds` passes every task starts from the same parameters, runs minibatch NCE
(shared noise words drawn from the unigram counts, Adagrad) over all its training rows, and the parameters are averaged
with the number of tokens as weight, FAN_IN tasks' at a time in a tree, so that no task and not the driver holds many. No
training text is left out.

Looking counts up: at most `dictionary` words, those above a count that a histogram of counts gives, are broadcast (a
fixed bound); all others are joined by a shuffle on the word's hash. A rare or unseen word that very many texts share makes
one row for each of them there; both sides are plain exchanges, so adaptive execution splits such a key. Words are told
apart by 64-bit hashes.

Defined cases: a null or empty text is one end token. With no training rows N = V = 0, every word is unknown and the
model gives every class an equal share. Texts of any length are scored whole. Repeated rows and doc_ids are scored row by
row, ties in counts fall on one side of the dictionary together. An empty table gives an empty result. Of extra columns only those
in `keep` are returned; they may have any names but those of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import BYTE_VALUE, LOWER, U64, Chunk, chunks, mix, release, row_sums, span_hashes
from .storage import materialize

LN10 = np.log(10.0)


END, BEGIN, FIRST = 0, 1, 2  # model ids: the end, what is before the text (context only), the classes by ending; then the head
FAN_IN = 32


@dataclass
class Vocabulary:
    """hashes are sorted; counts, kinds and ids go with them."""

    hashes: np.ndarray  # of the dictionary, sorted
    counts: np.ndarray
    ids: np.ndarray  # model id of each dictionary word
    totals: np.ndarray  # training tokens by model id
    sizes: np.ndarray  # by class: its training tokens, its distinct words and one unseen
    n: int  # training tokens
    v: int  # distinct training tokens
    ends: int
    slots: np.ndarray = field(default=None)
    shift: int = 0

    def __post_init__(self):
        bits = max(10, int(2 * max(1, len(self.hashes)) - 1).bit_length())
        self.shift = 64 - bits
        # where the words whose leading bits are i begin: a word is then found within a few steps
        self.slots = np.searchsorted(self.hashes, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(self.shift)) if bits < 64 else None
        self.slots[-1] = len(self.hashes)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places in the dictionary, -1 for words outside it."""
        if not len(self.hashes):
            return np.full(len(words), -1, np.int64)
        lead = (words >> np.uint64(self.shift)).astype(np.int64)
        at, stop = self.slots[lead], self.slots[lead + 1]
        out = np.full(len(words), -1, np.int64)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            place = at[open_]
            hit = self.hashes[place] == words[open_]
            out[open_[hit]] = place[hit]
            at[open_] += 1
            open_ = open_[~hit & (at[open_] < stop[open_])]
        return out


def word_kinds(chunk: Chunk, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z folded), the class of each by its last three bytes, and the offsets of each row's words."""
    starts, ends, off = chunk.words()
    data = LOWER[chunk.data]
    ending = np.zeros(len(starts), U64)
    for k in range(1, 4):
        at = ends - k
        ending = ending * U64(256) + np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(U64)
    return span_hashes(BYTE_VALUE[data], starts, ends), (mix(ending + U64(0xE0D)) % U64(kinds)).astype(np.int32), off


KINDS = 1024


def count_words(docs: DataFrame, kinds: int = KINDS) -> DataFrame:
    """word (64-bit hash as long), kind (its class) and c, its count over all rows of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0), 1 << 22):
                words, kind, _ = word_kinds(chunk, kinds)
                found, first, n = np.unique(words, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(kind[first]), pa.array(n.astype(np.int64))], ["word", "kind", "c"])
        release()

    return docs.select("text").mapInArrow(run, "word long, kind int, c long").groupBy("word", "kind").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, n_texts: int, head: int = 2048, dictionary: int = 1 << 18, kinds: int = KINDS) -> Vocabulary:
    """From the table of counts the driver gets a histogram, sums by class, and at most `dictionary` words."""
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # 16 steps to a doubling
    room, least = dictionary, None
    for r in sorted(steps, reverse=True):
        room -= r.words
        if room < 0:
            break
        least = r.step
    got = counts.where(F.floor(F.log2("c") * 16) >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    got = got.sort_values(["c", "word"], ascending=[False, True])
    words, c, kind = got["word"].to_numpy(np.int64).view(U64), got["c"].to_numpy(np.int64), got["kind"].to_numpy(np.int64)
    total, distinct = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
    for r in counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        total[r.kind], distinct[r.kind] = r.c, r.v
    n, v = int(total.sum()), int(distinct.sum())
    n_head = min(head, len(words))
    np.subtract.at(total, kind[:n_head], c[:n_head])
    np.subtract.at(distinct, kind[:n_head], 1)
    ids = (FIRST + kind).astype(np.int32)
    ids[:n_head] = FIRST + kinds + np.arange(n_head)
    order = np.argsort(words)
    return Vocabulary(words[order], c[order], ids[order], np.concatenate([[n_texts, 0], total, c[:n_head]]), total + distinct + 1, n + n_texts, v + bool(n_texts), n_texts)


def start(vocab: Vocabulary, width: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = len(vocab.totals)
    unigram = (vocab.totals + 1.0) / (vocab.totals + 1.0).sum()
    return {"r": rng.normal(0, 0.1, (size, width)).astype(np.float32), "q": rng.normal(0, 0.1, (size, width)).astype(np.float32), "near": np.ones(width, np.float32), "far": np.full(width, 0.5, np.float32), "b": np.log(unigram).astype(np.float32)}


def sequences(words: np.ndarray, kind: np.ndarray, off: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Model ids with an end after each row, the ids one and two before, row offsets, and the words' dictionary places."""
    place = vocab.find(words)
    ids = kind + FIRST
    known = np.flatnonzero(place >= 0)
    ids[known] = vocab.ids[place[known]]
    n = len(off) - 1
    seq = np.insert(ids, off[1:], END)
    ends = off[1:] + np.arange(n)
    seq_off = np.concatenate([[0], ends + 1])
    one, two = np.empty_like(seq), np.empty_like(seq)
    one[1:], two[2:] = seq[:-1], seq[:-2]
    one[seq_off[:-1]] = BEGIN
    two[seq_off[:-1]] = BEGIN
    second = seq_off[:-1] + 1
    two[second[second < seq_off[1:]]] = BEGIN
    return seq, one, two, seq_off, place


class Nce:
    """Minibatch noise-contrastive estimation with Adagrad, from given parameters."""

    def __init__(self, params: dict[str, np.ndarray], vocab: Vocabulary, noise: int, rate: float, seed: int):
        self.p = {k: v.copy() for k, v in params.items()}
        self.g = {k: np.full_like(v, 1e-8) for k, v in params.items()}
        weight = (vocab.totals + 1.0) / (vocab.totals + 1.0).sum()
        self.log_noise = (np.log(weight) + np.log(noise)).astype(np.float32)
        self.cumulative, self.noise, self.rate, self.rng = np.cumsum(weight), noise, rate, np.random.default_rng(seed)
        self.size = len(weight)

    def _scatter(self, index: np.ndarray, grad: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(index, weights=grad[:, j], minlength=self.size) for j in range(grad.shape[1])], axis=1).astype(np.float32)

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p = self.p
        r1, r2 = p["r"][one], p["r"][two]
        context = r1 * p["near"] + r2 * p["far"]
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise)), self.size - 1)
        qw, qn = p["q"][w], p["q"][drawn]
        data = np.einsum("ij,ij->i", context, qw) + p["b"][w] - self.log_noise[w]
        fake = context @ qn.T + (p["b"][drawn] - self.log_noise[drawn])
        e_data = -1.0 / (1.0 + np.exp(np.clip(data, -30, 30)))  # gradient of -log sigmoid
        e_fake = 1.0 / (1.0 + np.exp(-np.clip(fake, -30, 30)))
        scale = np.float32(1.0 / len(w))
        e_data, e_fake = (e_data * scale).astype(np.float32), (e_fake * scale).astype(np.float32)
        d_context = e_data[:, None] * qw + e_fake @ qn
        grad_q = self._scatter(w, e_data[:, None] * context)
        np.add.at(grad_q, drawn, e_fake.T @ context)
        grad_b = np.bincount(w, weights=e_data, minlength=self.size).astype(np.float32)
        np.add.at(grad_b, drawn, e_fake.sum(axis=0))
        grads = {"q": grad_q, "b": grad_b, "r": self._scatter(one, d_context * p["near"]) + self._scatter(two, d_context * p["far"]), "near": (d_context * r1).sum(axis=0), "far": (d_context * r2).sum(axis=0)}
        for k, g in grads.items():
            self.g[k] += g * g
            p[k] -= self.rate * g / np.sqrt(self.g[k])


def _add(rows: DataFrame, n: int) -> DataFrame:
    """The sums of the vectors in rows (x binary, of doubles) by n tasks; a task holds one vector, and reads FAN_IN or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                got = np.frombuffer(x.as_buffer(), np.float64)
                total = got.copy() if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    return rows.repartition(n).mapInArrow(run, "x binary")


def train(docs: DataFrame, vocab: Vocabulary, width: int = 16, noise: int = 32, batch_size: int = 1024, rate: float = 0.03, rounds: int = 1, seed: int = 5) -> dict[str, np.ndarray]:
    params = start(vocab, width, seed)
    names, spark = list(params), docs.sparkSession
    kinds = len(vocab.sizes)
    texts = docs.select("text")
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((params, vocab))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            params, vocab = shared.value
            model, tokens = Nce(params, vocab, noise, rate, seed + turn), 0
            for batch in batches:
                for chunk in chunks(batch.column(0)):
                    w, one, two, _, _ = sequences(*word_kinds(chunk, kinds), vocab)
                    for i in range(0, len(w), batch_size):
                        model.step(w[i : i + batch_size], one[i : i + batch_size], two[i : i + batch_size])
                    tokens += len(w)
            if tokens:
                flat = np.concatenate([model.p[k].ravel() for k in names]).astype(np.float64) * tokens
                yield pa.RecordBatch.from_arrays([pa.array([np.append(flat, tokens).tobytes()], pa.binary())], ["x"])
            release()

        sums, n = texts.mapInArrow(run, "x binary"), texts.rdd.getNumPartitions()
        while n > 1:
            n = -(-n // FAN_IN)
            sums = _add(sums, n)
        got = [np.frombuffer(bytes(r.x)) for r in sums.collect()]
        if got:
            total = np.sum(got, axis=0)
            flat, at = total[:-1] / total[-1], 0
            for k in names:
                size = params[k].size
                params[k] = flat[at : at + size].reshape(params[k].shape).astype(np.float32)
                at += size
    return params


def tables(params: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores by (context token, token) for either distance, the bias, and the log normaliser of every context (two, one)."""
    near = (params["r"] * params["near"]) @ params["q"].T
    far = (params["r"] * params["far"]) @ params["q"].T
    bias = params["b"].copy()
    bias[BEGIN] = -np.inf  # never predicted
    one = near + bias
    top_near, top_far = one.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
    np.exp(np.subtract(one, top_near, out=one), out=one)
    log_z = np.empty_like(far)
    for i in range(0, len(far), 256):
        block = slice(i, i + 256)
        log_z[block] = np.log(np.exp(far[block] - top_far[block]) @ one.T) + top_far[block] + top_near.T
    return near, far, bias, log_z


_KEPT: list = []  # the parameters that a worker has seen last, and their tables


def score(docs: DataFrame, params: dict[str, np.ndarray], vocab: Vocabulary, counts: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs (text is read), n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((params, vocab))
    docs = docs.select(*keep, F.col("text").alias("__text"))
    floor = float(vocab.n + vocab.v + 1)
    added = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double", "tail": "array<long>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, vocab = shared.value
        if not _KEPT or _KEPT[0] is not params:
            _KEPT[:] = [params, tables(params)]
        near, far, bias, log_z = _KEPT[1]
        log_floor, log_count, log_size = np.log(floor), np.log(vocab.counts + 1.0), np.log(vocab.sizes)
        kinds = len(vocab.sizes)
        for batch in batches:
            for chunk in chunks(batch.column(len(keep))):
                words, kind, off = word_kinds(chunk, kinds)
                w, one, two, seq_off, place = sequences(words, kind, off, vocab)
                model = (near[one, w] + far[two, w] + bias[w] - log_z[two, one]).astype(np.float64)
                known = place >= 0
                count = np.zeros(len(words))  # of words outside the dictionary it is added by the join below
                count[known] = log_count[place[known]]
                alone = np.zeros(len(words), bool)
                alone[known] = vocab.ids[place[known]] >= FIRST + kinds
                inner = np.where(alone, 0.0, count - log_size[kind])
                base = row_sums(count - log_floor, off) + np.log((vocab.ends + 1.0) / floor)
                out = [np.diff(seq_off), row_sums(known, off).astype(np.int64) + (vocab.ends > 0), base / LN10, (row_sums(model, seq_off) + row_sums(inner, off)) / LN10]
                outside = np.flatnonzero(~known)
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(outside, off).astype(np.int32)), pa.array(words[outside].view(np.int64)))
                part = batch.slice(chunk.start, len(chunk))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, out), tail], [*keep, *added])
        release()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]), *(f"{c} {t}" for c, t in added.items())])
    rows = materialize(docs.mapInArrow(run, fields).withColumn("__row", F.monotonically_increasing_id()), "scored")
    tail = rows.select("__row", F.explode("tail").alias("word")).groupBy("__row", "word").agg(F.count(F.lit(1)).alias("tf"))
    tail = tail.join(counts, "word").groupBy("__row").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"))  # a word without a count adds log 1
    more = F.coalesce("more", F.lit(0.0))
    return rows.drop("tail").join(tail, "__row", "left").select(
        *keep, "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
