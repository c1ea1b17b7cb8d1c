"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Voters look at the whole text and vote "toxic" or abstain: fixed lexicons (several kinds of insult, four languages),
patterns (address with an insult, repeated insults, several kinds together, shouting with an insult) and lexicons learned
from the labelled training rows (words, and beginnings of words, of high smoothed log odds, in a few lists from the surest
to the least sure; beginnings catch the inflected and compound forms of a telling word).

The label model is fitted by expectation-maximisation on the counts of vote patterns over *all* training rows (at most
2**voters patterns, gathered as counts), starting from the labelled rows' rates. Accuracies are each voter's rates of
voting in either class. Correlations are estimated from the residuals of the votes given the posterior; correlated voters
share their weight (a voter's log-odds are divided by one plus its correlations with the others), then EM goes on. The
learned lexicons are cross-fitted: what they vote on a labelled row comes from lists learned from the other half of the
labelled rows, so their rates are not those on the rows that they were picked from.

The classifier is a logistic regression on hashed words, beginnings of words and the votes, trained with the posteriors as targets on a bounded
sample of training rows: at most `max_labelled` labelled ones and about `max_unlabelled` others, by keyed hashes of doc_id,
as far as they have `max_values` words together. A label that a row has counts as one more voter there, right with the
probability `annotator`. Its score is the probability. Lists and classifier are each fitted in one
task, which holds the bounded sample; the driver gets lists, pattern counts and weights.

Defined cases: a null, empty or wordless text has no votes and gets the score of the bias alone; texts of any length are
taken whole. With no labelled rows the voters' prior rates stand in. Rows without doc_id and labels without doc_id or toxic
are not learned from (their votes are counted); several labels of one doc_id count as the greatest. Repeated rows are scored
alike. An empty table gives an empty result. Columns named like those added are replaced, all others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .arrow_text import BYTE_VALUE, LOWER, U64, Chunk, chunks, mix, release, row_sums, span_hashes
from .storage import fresh, materialize

# The lexicons.
LEXICONS = {
    "mind": "idiot idiots moron morons stupid dumb imbecile clown clowns fool fools dimwit halfwit cretin brainless retarded dunce simpleton",
    "worth": "worthless pathetic loser losers useless failure garbage trash waste nobody lowlife scum scumbag vermin parasite filth",
    "disgust": "disgusting vile repulsive revolting filthy nasty gross sickening ugly creep pervert pig swine rat",
    "swearing": "damn bastard bitch asshole crap shit fuck fucking bullshit jerk dick prick whore slut",
    "threat": "kill die hurt destroy hate hang burn beat murder strangle",
    "german": "idiot trottel dummkopf arschloch scheiße abschaum versager wertlos widerlich blödmann schwein mistkerl drecksau",
    "french": "imbécile crétin connard salaud ordure minable dégoûtant abruti nul merde débile pourriture",
    "spanish": "imbécil estúpido estúpida inútil basura asqueroso asquerosa perdedor escoria patético payaso mierda cabrón",
}
LEARNED_LISTS = 3
LEAST_APART, LEAST_ODDS = 4, 3.5  # of a learned word: distinct toxic rows, log odds
VOTERS = [*LEXICONS, "two_kinds", "repeated", "shouting", *(f"learned_{i}" for i in range(LEARNED_LISTS))]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


BEGINNINGS = (4, 5, 6)  # bytes


def _words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the letter runs, A-Z folded, and of their beginnings, their offsets by row, and whether each run is all capitals.

    Each run has one entry and one for each of BEGINNINGS, which is 0 if the run is not longer."""
    letter = _LETTER[chunk.data]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    inner = chunk.off[1:-1]  # cut runs that reach over a row's end
    cut = inner[(inner > 0) & (inner < len(letter))]
    cut = cut[letter[cut] & letter[cut - 1]] if len(cut) else cut
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    lower = (chunk.data >= 97) & letter
    capital = row_sums(lower, np.concatenate([starts, [len(letter)]]))[: len(starts)] if len(starts) else np.zeros(0)
    values = BYTE_VALUE[LOWER[chunk.data]]
    units = np.zeros((len(starts), 1 + len(BEGINNINGS)), U64)
    units[:, 0] = span_hashes(values, starts, ends)
    for k, n in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(ends - starts > n)
        units[longer, k] = mix(span_hashes(values, starts[longer], starts[longer] + n) + U64(n))
    return units.ravel(), np.searchsorted(starts, chunk.off) * units.shape[1], np.repeat(capital == 0, units.shape[1])


def word_hash(word: str) -> int:
    data = np.frombuffer(word.lower().encode(), np.uint8)
    return int(span_hashes(BYTE_VALUE[data], np.zeros(1, np.int64), np.array([len(data)]))[0])


def _table(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all listed words, and bit masks of the lists they are in."""
    masks: dict[int, int] = {}
    for k, words in enumerate(lists):
        for w in words:
            masks[w] = masks.get(w, 0) | 1 << k
    keys = np.array(sorted(masks), U64)
    return keys, np.array([masks[int(k)] for k in keys], np.int64)


def votes(chunk: Chunk, table: tuple[np.ndarray, np.ndarray], found: tuple | None = None) -> np.ndarray:
    """A bit mask of the voters that vote toxic, for each row."""
    words, off, capital = found or _words(chunk)
    keys, masks = table
    n = len(chunk)
    if not len(keys) or not len(words):
        return np.zeros(n, np.int64)
    place = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    at = np.flatnonzero(keys[place] == words)
    mask, row = masks[place[at]], np.searchsorted(off, at, side="right") - 1
    listed = len(LEXICONS)
    out = np.zeros(n, np.int64)
    kinds = np.zeros(n, np.int64)
    for k in range(listed):
        hit = np.bincount(row, weights=(mask >> k) & 1, minlength=n) > 0
        kinds += hit
        out |= hit.astype(np.int64) << k
    for k in range(LEARNED_LISTS):
        out |= (np.bincount(row, weights=(mask >> (listed + k)) & 1, minlength=n) > 0).astype(np.int64) << (listed + 3 + k)
    insult = (mask & ((1 << listed) - 1)) > 0
    out |= (kinds >= 2).astype(np.int64) << listed
    out |= (np.bincount(row, weights=insult, minlength=n) >= 2).astype(np.int64) << (listed + 1)
    out |= (np.bincount(row, weights=insult & capital[at], minlength=n) > 0).astype(np.int64) << (listed + 2)
    return out


@dataclass(frozen=True)
class LabelModel:
    prior: float
    rates: np.ndarray  # 2 x voters: how often each votes in class 0 and 1
    correlation: np.ndarray  # voters x voters, given the class
    weight: np.ndarray  # what is left of each voter's log odds

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        on = ((masks[:, None] >> np.arange(self.rates.shape[1])) & 1).astype(bool)
        odds = np.where(on, np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0])))
        return linear.sigmoid(odds @ self.weight + np.log(self.prior / (1 - self.prior)))


def fit_label_model(masks: np.ndarray, n: np.ndarray, labelled: tuple[np.ndarray, np.ndarray] | None, rounds: int = 30) -> LabelModel:
    """masks with their counts n over all training rows; labelled: masks and labels of the labelled sample."""
    m = len(VOTERS)
    prior, rates = 0.1, np.stack([np.full(m, 0.02), np.full(m, 0.3)])
    anchor_mask, anchor = labelled if labelled is not None else (np.zeros(0, np.int64), np.zeros(0))
    bits = lambda x: ((x[:, None] >> np.arange(m)) & 1).astype(float)
    on, known = bits(masks), bits(anchor_mask)
    if len(anchor) and 0 < anchor.mean() < 1:
        prior = float(np.clip(anchor.mean(), 0.005, 0.5))
        rates = np.stack([(known[anchor == c].sum(axis=0) + 0.05 * (1 + 5 * c)) / ((anchor == c).sum() + 1) for c in (0, 1)])
    model = LabelModel(prior, np.clip(rates, 1e-3, 0.99), np.eye(m), np.ones(m))
    total = max(1.0, float(n.sum()))
    boost = total / max(1, len(anchor)) * 0.5  # the labelled rows weigh half as much as all others together
    for turn in range(rounds):
        p = model.posterior(masks)
        one, zero = n * p, n * (1 - p)
        hits = np.stack([(zero @ on) + boost * known[anchor == 0].sum(axis=0), (one @ on) + boost * known[anchor == 1].sum(axis=0)])
        sizes = np.array([zero.sum() + boost * (anchor == 0).sum(), one.sum() + boost * (anchor == 1).sum()])
        rates = np.clip((hits + np.array([[1e-3], [1e-2]]) * 5) / (sizes[:, None] + 5), 1e-4, 0.99)
        residual = [on - rates[c] for c in (0, 1)]
        cov = (residual[0] * zero[:, None]).T @ residual[0] + (residual[1] * one[:, None]).T @ residual[1]
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation = np.clip(cov / scale[:, None] / scale, -1, 1)
        np.fill_diagonal(correlation, 1)
        weight = 1 / np.maximum(correlation, 0).sum(axis=1) if turn >= 5 else np.ones(m)
        model = LabelModel(float(np.clip((sizes[1] + prior) / (sizes.sum() + 1), 1e-3, 0.5)), rates, correlation, weight)
    return model


@dataclass(frozen=True)
class ToxicityModel:
    table: tuple[np.ndarray, np.ndarray]
    label_model: LabelModel
    weights: np.ndarray
    vote_weights: np.ndarray
    bias: float
    bits: int


def _buckets(words: np.ndarray, bits: int) -> np.ndarray:
    return (mix(words + U64(3)) >> U64(64 - bits)).astype(np.int64)


def _learned(sets: list[np.ndarray], label: np.ndarray) -> list[np.ndarray]:
    """Hashes of telling words in LEARNED_LISTS lists, from the surest on, by the word sets of labelled rows."""
    if not 0 < label.sum() < len(label):
        return [np.zeros(0, U64)] * LEARNED_LISTS
    names, place = np.unique(np.concatenate([*sets, np.zeros(0, U64)]), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bad = np.bincount(place, weights=label[row], minlength=len(names))
    good = np.bincount(place, weights=1 - label[row], minlength=len(names))
    odds = np.log((bad + 0.5) / (label.sum() + 1)) - np.log((good + 0.5) / ((1 - label).sum() + 1))
    # a learned word is hardly in other rows, and in several toxic ones that are not copies of each other: copies
    # share the least rehashed word, so equal (word, least) are counted once
    least = np.array([mix(x ^ U64(0x77)).min() if len(x) else 0 for x in sets], U64)
    toxic = label[row] > 0
    once = np.unique(np.stack([place[toxic].astype(U64), least[row[toxic]]], axis=1), axis=0)[:, 0].astype(np.int64)
    apart = np.bincount(once, minlength=len(names))
    sure = np.flatnonzero((apart >= LEAST_APART) & (odds > LEAST_ODDS))
    sure = sure[np.lexsort((names[sure], -odds[sure]))]
    return [names[part] for part in np.array_split(sure, LEARNED_LISTS)]


FIXED = [[word_hash(w) for w in x.split()] for x in LEXICONS.values()]
TABLES = ("all", "even", "odd")  # learned from all labelled rows, and from either half


def _mask_of(words: np.ndarray, base: int, table: tuple[np.ndarray, np.ndarray]) -> int:
    """A row's votes: those of the fixed voters, and of the learned lists of the table."""
    keys, masks = table
    if not len(keys) or not len(words):
        return base
    place = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    hit = masks[place[keys[place] == words]]
    learned = int(np.bitwise_or.reduce(hit)) >> len(LEXICONS) if len(hit) else 0
    return base | learned << (len(LEXICONS) + 3)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, toxic, words (the text's distinct words) and mask (of the fixed voters) of rows (key, toxic, text)."""
    fixed = _table(FIXED)
    for batch in batches:
        for chunk in chunks(batch.column(2)):
            words, off, capital = _words(chunk)
            part = batch.slice(chunk.start, len(chunk))
            lists = [np.unique(w[w > 0]).tobytes() for w in (words[off[i] : off[i + 1]] for i in range(len(chunk)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.binary()), pa.array(votes(chunk, fixed, (words, off, capital)))], ["key", "toxic", "words", "mask"])
    release()


FEATURES = "key long, toxic int, words binary, mask long"


def _bounded_rows(batches: Iterator[pa.RecordBatch], max_values: int) -> list[tuple[int, int | None, np.ndarray, int]]:
    kept = linear.Bounded(max_values)
    for batch in batches:
        for key, toxic, words, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kept.add((key, zlib.crc32(words)), (key, toxic, words, mask), len(words) // 8)
    return [(key, toxic, np.frombuffer(words, U64), mask) for _, _, (key, toxic, words, mask) in kept.rows]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, max_unlabelled: int = 8000, max_values: int = 1 << 23, bits: int = 17, annotator: float = 0.95, seed: int = 23) -> ToxicityModel:
    """docs: all training rows (doc_id, text); labels: (doc_id, toxic) of training rows. The bounds are those of the samples;
    annotator is how often a given label is taken to be right."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(key, "doc_id").limit(max_labelled)
    sample = materialize(sample.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(key.alias("key"), "toxic", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _bounded_rows(batches, max_values)
        label = np.array([float(toxic) for _, toxic, _, _ in got])
        even = np.array([key % 2 == 0 for key, _, _, _ in got], bool)
        lists = {"all": _learned([r[2] for r in got], label)}
        for name, side in (("even", even), ("odd", ~even)):
            lists[name] = _learned([r[2] for r, s in zip(got, side, strict=True) if s], label[side])
        tables = {name: _table([*FIXED, *(x.tolist() for x in own)]) for name, own in lists.items()}
        own = np.array([_mask_of(words, base, tables["odd" if e else "even"]) for (_, _, words, base), e in zip(got, even, strict=True)], np.int64)
        columns = [lists[name][k].tobytes() for name in TABLES for k in range(LEARNED_LISTS)]
        yield pa.RecordBatch.from_arrays([pa.array([columns], pa.list_(pa.binary())), pa.array([own.tobytes()], pa.binary()), pa.array([label.tobytes()], pa.binary())], ["lists", "masks", "labels"])
        release()

    got = rows.mapInArrow(_features, FEATURES).repartition(1).mapInArrow(learn, "lists array<binary>, masks binary, labels binary").collect()
    lists = [np.frombuffer(bytes(x), U64).tolist() for x in got[0].lists] if got else [[]] * (3 * LEARNED_LISTS)
    tables = {name: _table([*FIXED, *lists[i * LEARNED_LISTS : (i + 1) * LEARNED_LISTS]]) for i, name in enumerate(TABLES)}
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                for mask, n in zip(*np.unique(votes(chunk, shared.value["all"]), return_counts=True), strict=True):
                    seen[int(mask)] = seen.get(int(mask), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["mask", "n"])
        release()

    counted = docs.select("text").mapInArrow(patterns, "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n")).orderBy("mask").toPandas()
    anchors = (np.frombuffer(bytes(got[0].masks), np.int64), np.frombuffer(bytes(got[0].labels))) if got and len(got[0].labels) else None
    model = fit_label_model(counted["mask"].to_numpy(np.int64), counted["n"].to_numpy(float), anchors)
    size = 1 << bits
    if anchors is None:
        weights, bias = np.zeros(size + len(VOTERS)), float(np.log(model.prior / (1 - model.prior)))
        weights[size:] = np.log(model.rates[1] / model.rates[0]) * model.weight
        return ToxicityModel(tables["all"], model, weights[:size], weights[size:], bias, bits)
    share = max_unlabelled / max(1.0, float(counted["n"].sum()))
    drawn = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(1 << 40)) < int(share * (1 << 40))
    either = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").where(F.col("toxic").isNotNull() | drawn).select(key.alias("key"), "toxic", "text")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _bounded_rows(batches, max_values)
        own = np.array([_mask_of(words, base, shared.value["all" if toxic is None else "odd" if key % 2 == 0 else "even"]) for key, toxic, words, base in got], np.int64)
        voted = [np.flatnonzero((m >> np.arange(len(VOTERS))) & 1) for m in own]
        index = np.concatenate([np.concatenate([_buckets(r[2], bits), size + v]) for r, v in zip(got, voted, strict=True)])
        value = np.concatenate([np.concatenate([np.full(len(r[2]), 1 / np.sqrt(max(1, len(r[2])))), np.ones(len(v))]) for r, v in zip(got, voted, strict=True)])
        off = np.concatenate([[0], np.cumsum([len(r[2]) + len(v) for r, v in zip(got, voted, strict=True)])])
        said = np.array([0.0 if toxic is None else 1.0 if toxic else -1.0 for _, toxic, _, _ in got]) * np.log(annotator / (1 - annotator))
        target = np.clip(model.posterior(own), 1e-6, 1 - 1e-6)
        target = linear.sigmoid(np.log(target / (1 - target)) + said)
        weights, bias = linear.fit(index, value, off, target, size + len(VOTERS), l2=3e-5, steps=120, rate=0.2)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])
        release()

    trained = either.mapInArrow(_features, FEATURES).repartition(1).mapInArrow(classify, "weights binary, bias double").first()
    weights = np.frombuffer(bytes(trained.weights))
    return ToxicityModel(tables["all"], model, weights[:size], weights[size:], trained.bias, bits)


def probabilities(chunk: Chunk, model: ToxicityModel) -> np.ndarray:
    """The score of each row of the chunk."""
    words, off, capital = _words(chunk)
    some = np.flatnonzero(words)
    row = np.repeat(np.arange(len(chunk), dtype=U64), np.diff(off))[some]
    _, first = np.unique(words[some] ^ mix(row + U64(1)), return_index=True)  # distinct ones of a row
    row = row[first].astype(np.int64)
    total = np.bincount(row, weights=model.weights[_buckets(words[some[first]], model.bits)], minlength=len(chunk))
    distinct = np.bincount(row, minlength=len(chunk))
    on = ((votes(chunk, model.table, (words, off, capital))[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    return linear.sigmoid(total / np.sqrt(np.maximum(1, distinct)) + on @ model.vote_weights + model.bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with score (probability that the text is toxic) and predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(probabilities(chunk, shared.value) for chunk in chunks(texts))]))
        release()

    p = fresh(docs, "probability")
    judged = docs.withColumn(p, judge.asNondeterministic()(F.col(text)))  # not to be computed twice
    return judged.select(*[c for c in docs.columns if c == text or c not in ("score", "predicted")], F.col(p).alias("score"), (F.col(p) >= 0.5).cast("int").alias("predicted"))
