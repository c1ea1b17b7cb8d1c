"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is read from a model file (a parameter) on the driver and broadcast as tables; executors need no file.
A text gets a leading word mark, spaces become word marks, and the segments between marks are encoded on their own (no
piece has a mark after another character, which is checked). Within a segment the best-scored neighbouring pair is merged
again and again, the leftmost first among equals; a candidate merge is *skipped* for good when its keyed hash falls below
the dropout. The key is (seed, document, place of the segment in the document, place of the pair, merged piece): the same
run always gives the same segmentation, and every occurrence of a word draws its own. With dropout 0 the pieces are those
of the reference algorithm.

All segments of a chunk are merged together, one merge for each segment in a round, in numpy; long segments go through a
heap instead, in O(n log n).

Characters without a piece become byte pieces; so does a literal U+2581, which would otherwise decode to a space.
Defined cases: null stays null; an empty text has no pieces; repeated rows (equal doc_id and text) give equal pieces, and so
do ties in scores; a null doc_id counts as one more document; any length is encoded whole; an empty table gives an empty
result. Columns named like those added (ids, decoded) are replaced, all others pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, mix, release, span_hashes

MARK = 0x2581
LONG = 48  # symbols; longer segments go through the heap
PIECE = 1 << 16  # characters encoded at once
NONE = np.int64(1) << np.int64(62)


@dataclass(frozen=True)
class Pieces:
    char_id: np.ndarray  # piece of each code point, -1 without one
    byte_id: np.ndarray  # piece of each byte
    pair_key: np.ndarray  # open-addressed table: left * size + right, -1 free
    pair_id: np.ndarray  # the merged piece
    rank: np.ndarray  # by piece: 0 is merged first; equal scores share a rank
    data: tuple[bytes, ...]  # what each piece decodes to
    size: int
    probes: int

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, -1 if none."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        bits = int(len(self.pair_key)).bit_length() - 1
        slot = ((key.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        hit = self.pair_key[slot] == key
        out[hit] = self.pair_id[slot[hit]]
        rest = np.flatnonzero(~hit & (self.pair_key[slot] != -1) & (key >= 0))
        for _ in range(self.probes):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & (len(self.pair_key) - 1)
            found = self.pair_key[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.pair_id[slot[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out


def load(path: str) -> Pieces:
    """Tables of the BPE model file at path; it is read here, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    own = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ids = {names[i]: i for i in own}
    byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    if not all(model.is_byte(int(i)) for i in byte_id):
        raise ValueError("the model has no byte pieces, so it can't encode every text")
    if any("▁" in n.lstrip("▁") for n in ids):
        raise ValueError("a piece has a word mark after another character; segments would not be independent")
    char_id = np.full(0x110000, -1, np.int64)
    for n, i in ids.items():
        if len(n) == 1:
            char_id[ord(n)] = i
    scores = sorted({model.get_score(i) for i in own}, reverse=True)
    ranks = {s: k for k, s in enumerate(scores)}
    rank = np.array([ranks.get(model.get_score(i), len(scores)) for i in range(size)], np.int64)
    pairs = [(ids[n[:k]] * size + ids[n[k:]], i) for n, i in ids.items() for k in range(1, len(n)) if n[:k] in ids and n[k:] in ids]
    bits = max(4, int(4 * len(pairs)).bit_length())
    key, value, probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64), 0
    for k, i in pairs:
        slot = ((k * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - bits)
        steps = 0
        while key[slot] != -1:
            slot, steps = (slot + 1) & ((1 << bits) - 1), steps + 1
        key[slot], value[slot], probes = k, i, max(probes, steps)
    data = [n.replace("▁", " ").encode() if i in set_own else b"" for set_own in [set(own)] for i, n in enumerate(names)]
    for b, i in enumerate(byte_id):
        data[int(i)] = bytes([b])
    return Pieces(char_id, byte_id, key, value, rank, tuple(data), size, probes)


def _skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, limit: np.uint64) -> np.ndarray:
    return mix(key ^ mix(place.astype(U64) * U64(0x100000001B3) + piece.astype(U64))) < limit


def _heap(symbols: list[int], key: int, pieces: Pieces, limit: np.uint64) -> list[int]:
    """The pieces of one segment, by an agenda of candidate merges."""
    n = len(symbols)
    left, right, alive, ids = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n, list(symbols)
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(places: list[int]) -> None:
        places = [i for i in places if i >= 0 and right[i] >= 0]
        if not places:
            return
        a, b = np.array([ids[i] for i in places], np.int64), np.array([ids[right[i]] for i in places], np.int64)
        made = pieces.merged(a, b)
        drop = _skipped(np.full(len(places), key, U64), np.array(places, np.int64), made, limit) if limit else np.zeros(len(places), bool)
        for i, m, x, y, d in zip(places, made.tolist(), a.tolist(), b.tolist(), drop.tolist(), strict=True):
            if m >= 0 and not d:
                heapq.heappush(agenda, (int(pieces.rank[m]), i, m, x, y))

    offer(list(range(n - 1)))
    while agenda:
        _, i, m, x, y = heapq.heappop(agenda)
        j = right[i]
        if not alive[i] or j < 0 or ids[i] != x or ids[j] != y:
            continue
        ids[i], alive[j] = m, False
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer([left[i], i])
    return [ids[i] for i in range(n) if alive[i]]


def merge_segments(symbols: np.ndarray, off: np.ndarray, keys: np.ndarray, pieces: Pieces, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each segment (symbols between offsets), with the segments' keys for the skipping of merges."""
    n = np.diff(off)
    done_id, done_seg, done_place = [], [], []
    for s in np.flatnonzero(n > LONG):
        got = _heap(symbols[off[s] : off[s + 1]].tolist(), int(keys[s]), pieces, limit)
        done_id.append(np.array(got, np.int64))
        done_seg.append(np.full(len(got), s))
        done_place.append(np.arange(len(got)))
    few = np.flatnonzero((n > 0) & (n <= LONG))
    seg = np.repeat(few.astype(np.int32), n[few])
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(n[few])])[:-1]
    place = np.arange(len(seg), dtype=np.int32) - np.repeat(starts.astype(np.int32), n[few])
    ids = symbols[off[seg] + place].astype(np.int32)
    made = np.full(len(ids), -1, np.int32)  # what each symbol and its right neighbour make
    cost = np.full(len(ids), NONE)  # its rank, in the upper half
    fresh = np.arange(len(ids))
    while len(ids):
        # candidates beside the last merges are looked up anew
        fresh = fresh[fresh < len(ids) - 1]
        inside = seg[fresh] == seg[fresh + 1]
        cost[fresh[~inside]] = NONE
        fresh = fresh[inside]
        got = pieces.merged(ids[fresh], ids[fresh + 1])
        able = np.flatnonzero(got >= 0)
        if limit:
            able = able[~_skipped(keys[seg[fresh[able]]], place[fresh[able]], got[able], limit)]
        cost[fresh] = NONE
        cost[fresh[able]] = pieces.rank[got[able]] << np.int64(32)
        made[fresh] = got
        cost[-1] = NONE
        best = np.minimum.reduceat(cost | np.arange(len(ids)), starts)
        ended = best >= NONE
        at = best[~ended] & np.int64(0xFFFFFFFF)
        ids[at] = made[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        if ended.any():
            out = np.repeat(ended, np.diff(np.append(starts, len(ids))))
            done_id.append(ids[out])
            done_seg.append(seg[out])
            done_place.append(place[out])
            keep[out] = False
        moved = np.cumsum(keep, dtype=np.int32) - 1
        fresh, starts = moved[at], moved[starts[~ended]]
        ids, seg, place, made, cost = ids[keep], seg[keep], place[keep], made[keep], cost[keep]
        beside = np.zeros(len(ids), bool)
        beside[fresh] = True
        beside[fresh[fresh > 0] - 1] = True
        fresh = np.flatnonzero(beside)
    ids = np.concatenate([np.zeros(0, np.int64), *done_id])
    seg = np.concatenate([np.zeros(0, np.int64), *done_seg])
    order = np.lexsort((np.concatenate([np.zeros(0, np.int64), *done_place]), seg))
    seg = seg[order]
    return ids[order], np.searchsorted(seg, np.arange(len(n) + 1))


def encode_texts(texts: list[str], doc_keys: np.ndarray, pieces: Pieces, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts one after another, and their offsets by text."""
    joined = "".join(" " + t if t else "" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    text_off = np.concatenate([[0], np.cumsum(lengths)])
    literal = points == MARK
    space = points == 32
    symbols = pieces.char_id[np.where(space, MARK, points)]
    symbols[literal] = -1
    alone = symbols < 0
    cut = np.zeros(len(points), bool)
    cut[text_off[:-1][lengths > 0]] = True
    cut |= alone
    cut[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(points))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    owner = np.searchsorted(text_off, starts, side="right") - 1
    values = mix(np.where(space, MARK, points).astype(U64) + U64(0x51ED270B) + literal.astype(U64))
    hashes = span_hashes(values, starts, ends)
    limit = U64(min(int(dropout * 2**64), 2**64 - 1))
    if dropout > 0:
        first = np.searchsorted(starts, text_off[:-1])
        place = (np.arange(len(starts)) - first[owner]).astype(U64)
        keys = mix(hashes ^ mix(doc_keys[owner] + mix(place + U64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))))
        chosen = inverse = np.arange(len(keys))
    else:  # equal segments have equal pieces
        keys = hashes
        _, chosen, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    size = (ends - starts)[chosen]
    seg_off = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts[chosen] - seg_off[:-1], size) + np.arange(seg_off[-1])
    ids, off = merge_segments(symbols[at], seg_off, keys[chosen], pieces, limit)
    # back to the texts, byte pieces for characters without one
    n = np.diff(off)[inverse]
    out_off = np.concatenate([[0], np.cumsum(n)])
    out = ids[np.repeat(off[:-1][inverse] - out_off[:-1], n) + np.arange(out_off[-1])]
    piece_off = out_off[np.searchsorted(starts, text_off)]
    missing = np.flatnonzero(out < 0)
    if len(missing):  # each is a segment of one character
        segment = np.searchsorted(out_off, missing, side="right") - 1
        chars, which = np.unique(points[starts[segment]], return_inverse=True)
        raw = [chr(c).encode() for c in chars]
        width = np.array([len(r) for r in raw], np.int64)[which]
        grown = np.ones(len(out), np.int64)
        grown[missing] = width
        new_off = np.concatenate([[0], np.cumsum(grown)])
        full = np.repeat(out, grown)
        table = np.zeros((len(raw), 4), np.int64)
        for k, r in enumerate(raw):
            table[k, : len(r)] = pieces.byte_id[list(r)]
        place = np.repeat(new_off[missing] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        full[place] = table[np.repeat(which, width), place - np.repeat(new_off[missing], width)]
        out, piece_off = full, new_off[piece_off]
    return out, piece_off


def decode_ids(ids: np.ndarray, pieces: Pieces) -> str:
    data = b"".join([pieces.data[i] for i in ids.tolist()])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode(docs: DataFrame, vocab: str, dropout: float = 0.1, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ids (array of int). vocab: path of the model file, read on the driver. A null key counts as 0."""
    shared = docs.sparkSession.sparkContext.broadcast(load(vocab))
    docs = docs.drop("ids").withColumn("__key", F.xxhash64(F.lit(seed), F.col(key)))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= PIECE):
                    size += len(texts[stop] or "")
                    stop += 1
                part = [t or "" for t in texts[start:stop]]
                ids, off = encode_texts(part, keys[start:stop], pieces, dropout, seed)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array([t is None for t in texts[start:stop]]))
                rows = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], [*batch.schema.names[:-1], "ids"])
                start = stop
        release()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]), "ids array<int>"])
    return docs.mapInArrow(run, fields)


def decode(rows: DataFrame, vocab: str, ids: str = "ids") -> DataFrame:
    """rows with decoded, the text of ids."""
    shared = rows.sparkSession.sparkContext.broadcast(load(vocab))
    rows = rows.drop("decoded")
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value.data
        for batch in batches:
            lists = batch.column(at)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = []
            for i in range(len(lists)):
                raw = b"".join([data[k] for k in flat[off[i] : off[i + 1]].tolist()])
                texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()))], [*batch.schema.names, "decoded"])
        release()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "decoded string"])
    return rows.mapInArrow(run, fields)
