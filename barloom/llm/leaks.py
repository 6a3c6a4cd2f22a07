"""Passages of held-out items inside corpus documents (problem 9).

Words of documents and passages become one string each, blank before each word. If a stretch of L characters occurs in
both with at most e edits, the two share L + 1 - q - q*e of their q-grams, on diagonals that differ by at most e (the
q-gram lemma). So shared q-grams are counted in overlapping bands of diagonals; bands with fewer than the bound for the
shortest stretch of min_words words of the item are dropped, losing nothing, and in what is left every stretch of
min_words words is aligned within its band. Longer stretches need no alignment: one of k times min_words words with at
most k * e edits holds min_words words with at most e.

The items are a query set, stated and held out; they are run against all documents in blocks of bounded size, each block
one index that is sent to the executors. Documents are read where they lie: nothing of the corpus is shuffled or
collected, so neither hot groups nor copies matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import spaced_words
from barloom.sources.tables import written

#: Characters of a gram. Long ones are rare outside the items; 24 leave a bound above 1 for one edit in 15 short words.
Q = 24
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
#: Grams hashed at once; bounds the memory of very long texts.
SLICE = 1 << 20
#: A gram of more items than this doesn't by itself set a document against them.
HOT = 16


def _grams(cp: np.ndarray) -> np.ndarray:
    """A hash of the Q code points from each place on; equal grams have equal hashes, hits are compared later."""
    with np.errstate(over="ignore"):
        h8, factor = cp.astype(np.uint64) + np.uint64(1), _FACTOR
        for n in (1, 2, 4):
            h8, factor = h8[:-n] * factor + h8[n:], factor * factor
        h24 = (h8[:-16] * factor + h8[8:-8]) * factor + h8[16:]
    return h24 ^ (h24 >> np.uint64(29))


@dataclass
class Index:
    """The q-grams of a block of items. grams are sorted and different; those of gram g are the places first[g] up to
    first[g + 1] of item and place, which run by item. shortest: the length of each item's shortest stretch of min_words
    words; least: the grams that it shares after as many edits as are looked for; stretches: where each item's stretches
    of min_words words begin and stop, with the blanks around them.

    hot: grams of more than HOT items. A document isn't held against all of them for such a gram alone: parts is an index
    of its own of the stretches that hot grams could fill, each text once, and of_part names the items that have each."""

    ids: list[str]
    words: list[np.ndarray]
    shortest: np.ndarray
    least: np.ndarray
    stretches: list[tuple[np.ndarray, np.ndarray]]
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    hot: np.ndarray
    known: np.ndarray
    parts: Index | None = None
    of_part: list[list[int]] | None = None


def index(items: list[tuple[str, str]], min_words: int, edits: int) -> Index:
    """Items with fewer than min_words words can't leak and are left out."""
    cp, edge = spaced_words([t for _, t in items])
    own = [cp[edge[k] : edge[k + 1] + 1] for k in range(len(items))]
    return _index([(name, w[1:] if w[1] == 32 else w) for (name, _), w in zip(items, own)], min_words, edits, HOT)  # one blank before the first word


def _index(items: list[tuple[str, np.ndarray]], min_words: int, edits: int, most: int | None) -> Index:
    ids, words, shortest, least, stretches, hashes = [], [], [], [], [], []
    for name, own in items:
        blanks = np.flatnonzero(own == 32)
        if len(blanks) - 1 < min_words:
            continue
        ends = blanks[min_words:]
        begins = blanks[: len(blanks) - min_words]
        length = int((ends - begins).min()) + 1
        bound = min((b for e in range(edits + 1) if (b := length + 1 - Q - Q * e) >= 1), default=1)
        hashes.append(_grams(own))
        ids.append(name)
        words.append(own)
        shortest.append(max(length, Q))
        least.append(bound)
        stretches.append((begins, ends + 1))
    sizes = [len(h) for h in hashes]
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.zeros(0, np.int32)
    order = np.argsort(every, kind="stable")
    grams, first, which = np.unique(every, return_index=True, return_inverse=True) if ids else (every, np.zeros(0, np.int64), np.zeros(0, np.int64))
    known = np.zeros(1 << _BITS, bool)
    known[every & np.uint64((1 << _BITS) - 1)] = True
    sorted_item = item[order]
    first = np.concatenate((np.searchsorted(every[order], grams, "left"), [len(every)]))
    hot = np.zeros(len(grams), bool)
    if most is not None and len(grams):
        new = np.concatenate(([True], sorted_item[1:] != sorted_item[:-1]))
        new[first[:-1]] = True
        hot = np.add.reduceat(new, first[:-1], dtype=np.int64) > most
    out = Index(ids, words, np.array(shortest, np.int64), np.array(least, np.int64), stretches, grams, first, sorted_item, place[order], hot, known)
    if hot.any():
        parts: dict[bytes, list[int]] = {}
        for k, (own, (begins, stops), is_hot) in enumerate(zip(words, stretches, np.split(hot[which], np.cumsum(sizes)[:-1]))):
            upto = np.concatenate(([0], np.cumsum(is_hot)))
            count = upto[np.clip(stops - Q + 1, 0, len(is_hot))] - upto[np.minimum(begins, len(is_hot))]
            full = np.flatnonzero(count >= np.maximum(1, stops - begins + 1 - Q - Q * edits))
            for run in np.split(full, np.flatnonzero(np.diff(full) > 1) + 1) if len(full) else ():
                of = parts.setdefault(own[begins[run[0]] : stops[run[-1]]].tobytes(), [])
                if not of or of[-1] != k:
                    of.append(k)
        out.parts = _index([(str(i), np.frombuffer(text, np.uint32)) for i, text in enumerate(parts)], min_words, edits, None)
        out.of_part = [of for of in parts.values()]
    return out


def _aligned(own: np.ndarray, begins: np.ndarray, stops: np.ndarray, doc: np.ndarray, low: int, high: int, edits: int) -> int | None:
    """The least edits, up to `edits`, between one of the stretches own[begin:stop] and any part of doc, on diagonals from
    low to high; None if all have more.

    For each stretch and diagonal, the place of the item reached with k edits follows from those reached with k - 1.
    """
    first, last = int(begins.min()), int(stops.max())
    diagonals = np.arange(low, high + 1)
    spots = np.arange(first, last) + diagonals[:, None]
    within = (spots >= 0) & (spots < len(doc))
    differs = ~within | (doc[np.where(within, spots, 0)] != own[first:last])
    differing = np.where(differs, np.arange(first, last), last)
    # The next place from each one on, last included, where item and document differ.
    after = np.full((len(diagonals), last - first + 1), last)
    after[:, :-1] = np.minimum.accumulate(differing[:, ::-1], axis=1)[:, ::-1]
    row = np.arange(len(diagonals))
    reached = after[row, begins[:, None] - first]
    for k in range(edits + 1):
        if (reached >= stops[:, None]).any():
            return k
        further = reached + 1  # a character replaced
        further[:, :-1] = np.maximum(further[:, :-1], reached[:, 1:] + 1)  # one left out of the document
        further[:, 1:] = np.maximum(further[:, 1:], reached[:, :-1])  # one put into it
        reached = after[row, np.minimum(further, last) - first]
    return None


def _verified(own: np.ndarray, stretches: tuple[np.ndarray, np.ndarray], doc: np.ndarray, place: np.ndarray, diagonal: np.ndarray, edits: int) -> bool | None:
    """Whether a region of shared grams in a band is a leak: True if it holds a stretch of min_words words unchanged, False
    if only one with at most `edits` edits, None if neither.

    place runs upwards. A region ends where no shared gram follows within what the edits can break.
    """
    begins, stops = stretches
    found = None
    breaks = np.flatnonzero(np.diff(place) > Q * (edits + 1)) + 1
    for first, last in zip([0, *breaks.tolist()], [*breaks.tolist(), len(place)]):
        shared = np.searchsorted(place[first:last], stops - Q, "right") - np.searchsorted(place[first:last], begins, "left")
        near = np.flatnonzero(shared >= np.maximum(1, stops - begins + 1 - Q - Q * edits))
        if not len(near):
            continue
        on = diagonal[first:last]
        least = _aligned(own, begins[near], stops[near], doc, int(on.min()) - edits, int(on.max()) + edits, edits)
        if least == 0:
            return True
        if least is not None:
            found = False
    return found


def find(texts: list[str | None], ix: Index, min_words: int, edits: int) -> list[tuple[int, int, bool]]:
    """(place of the text, place of the item, exact): the leaks in a batch of texts."""
    if not ix.ids:
        return []
    cp, edge = spaced_words(texts)
    found = _found(cp, edge, ix, edits)
    if ix.parts is not None and ix.parts.ids:
        for (t, p), exact in _found(cp, edge, ix.parts, edits).items():
            for k in ix.of_part[int(ix.parts.ids[p])]:
                found[t, k] = exact or found.get((t, k), False)
    return [(t, k, e) for (t, k), e in sorted(found.items())]


def _shared(cp: np.ndarray, edge: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """(spot, place in item and place) of each shared gram with each place of each item that it counts for: a hot gram
    only for the items that share a gram with the text that isn't hot."""
    parts = []
    for s in range(0, len(cp) - Q + 1, SLICE):
        grams = _grams(cp[s : s + SLICE + Q - 1])
        own = np.flatnonzero(ix.known[grams & np.uint64((1 << _BITS) - 1)])
        at = np.minimum(np.searchsorted(ix.grams, grams[own]), len(ix.grams) - 1)
        same = ix.grams[at] == grams[own]
        parts.append(np.stack((own[same] + s, at[same])))
    spots, gram = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)

    def fanned(spots: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fan = np.repeat(np.arange(len(spots)), count)
        return spots[fan], low[fan] + np.arange(len(fan)) - np.repeat(np.cumsum(count) - count, count)

    hot = ix.hot[gram]
    cold = gram[~hot]
    spot, at = fanned(spots[~hot], ix.first[cold], ix.first[cold + 1] - ix.first[cold])
    if not hot.any() or not len(spot):
        return spot, at
    pairs = np.unique((np.searchsorted(edge, spot, "right") - 1) * len(ix.ids) + ix.item[at])
    text, item = pairs // len(ix.ids), pairs % len(ix.ids)
    hot_spot, hot_gram = spots[hot], gram[hot]
    begin, stop = (np.searchsorted(hot_spot, edge[text + i], "left") for i in (0, 1))
    which, near = fanned(np.arange(len(pairs)), begin, stop - begin)
    # Places run by item within a gram.
    code = np.repeat(np.arange(len(ix.grams)), np.diff(ix.first)) * len(ix.ids) + ix.item
    wanted = hot_gram[near] * len(ix.ids) + item[which]
    low = np.searchsorted(code, wanted, "left")
    more, more_at = fanned(hot_spot[near], low, np.searchsorted(code, wanted, "right") - low)
    return np.concatenate((spot, more)), np.concatenate((at, more_at))


def _found(cp: np.ndarray, edge: np.ndarray, ix: Index, edits: int) -> dict[tuple[int, int], bool]:
    """(place of the text, place of the item) -> whether it is exact."""
    spots, at = _shared(cp, edge, ix)
    if not len(spots):
        return {}
    text = np.searchsorted(edge, spots, "right") - 1
    pair = text * len(ix.ids) + ix.item[at]
    place = ix.place[at].astype(np.int64)
    diagonal = spots - edge[text] - place
    # Bands overlap by the edits, so that a stretch with that many lies in one of them.
    width = 4 * (edits + 1)
    band = diagonal // width
    again = np.flatnonzero((diagonal + edits) // width != band)
    pair, place, diagonal, band = (np.concatenate((x, y)) for x, y in ((pair, pair[again]), (place, place[again]), (diagonal, diagonal[again]), (band, band[again] + 1)))
    order = np.lexsort((place, band, pair))
    pair, place, diagonal, band = pair[order], place[order], diagonal[order], band[order]
    opens = np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(band) != 0)))
    fresh = opens | np.concatenate(([True], np.diff(place) != 0))  # of hits at one place of the item, one counts
    group = np.cumsum(opens) - 1
    item = pair % len(ix.ids)
    along = group[fresh] * (int(place.max()) + int(ix.shortest.max()) + 2) + place[fresh]
    within = np.searchsorted(along, along + ix.shortest[item[fresh]] - Q, "right") - np.arange(len(along))
    kept = np.unique(group[fresh][within >= ix.least[item[fresh]]])
    begins, stops = np.searchsorted(group, kept, "left"), np.searchsorted(group, kept, "right")
    found: dict[tuple[int, int], bool] = {}
    for a, b in zip(begins.tolist(), stops.tolist()):
        t, k = divmod(int(pair[a]), len(ix.ids))
        if not found.get((t, k)):
            doc = cp[edge[t] : edge[t + 1] + 1]
            verdict = _verified(ix.words[k], ix.stretches[k], doc, place[a:b], diagonal[a:b], edits)
            if verdict is not None:
                found[t, k] = verdict
    return found


def leaks(
    documents: DataFrame, id: str, text: str, items: DataFrame, item_id: str, passage: str, min_words: int = 15, edits: int = 1, block_chars: int = 2_000_000
) -> DataFrame:
    """(id, item_id, exact): documents that hold a stretch of at least min_words successive words of an item's passage
    with at most `edits` edits for each min_words words; exact: they hold min_words successive words unchanged.

    Every exact leak is found; so is every other of an item whose shortest stretch of min_words words, with the blanks
    around it, has at least Q * (edits + 1) characters. Of items of shorter words, only those that still share a gram are.
    A blank before or after the stretch that the document lacks is an edit.
    Words are compared by `plain`. Null and empty texts and passages, and passages with fewer than min_words words,
    match nothing. An item given twice counts once for each passage; a document once for each item. An empty table on
    either side gives no rows. Items are brought to the driver block by block, at most block_chars characters (or one
    passage) at a time and the next block; each block is one reading of the documents. The rows of several blocks are
    written to the shared folder, block by block.
    """
    docs = documents.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    source = items.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{passage}`").cast("string")).where(F.col(f"`{passage}`").isNotNull())
    blocks = _blocks(source.toLocalIterator(), block_chars)
    block, after = next(blocks), next(blocks, None)
    out, sent = _run(docs, index(block, min_words, edits), min_words, edits)
    if after is not None:
        # One block is on the driver and the executors at a time: its rows are written before the next is read.
        parts = []
        while True:
            parts.append(written(out, "leaks"))
            sent.destroy()
            if after is None:
                break
            out, sent = _run(docs, index(after, min_words, edits), min_words, edits)
            after = next(blocks, None)
        out = reduce(DataFrame.unionByName, parts)
    return out.groupBy("id", "item_id").agg(F.max("exact").alias("exact")).select(F.col("id").alias(id), F.col("item_id").alias(item_id), "exact")


def _blocks(rows: Iterator[tuple[str, str]], block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """Rows in blocks of at most block_chars characters, or of one row; one empty block if there are none."""
    block, size = [], 0
    for name, words in rows:
        if size + len(words) > block_chars and block:
            yield block
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    yield block


def _run(docs: DataFrame, ix: Index, min_words: int, edits: int, rows_at_once: int = 256) -> tuple[DataFrame, Broadcast]:
    sent = docs.sparkSession.sparkContext.broadcast(ix)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                found = find(batch.column(1).to_pylist(), own, min_words, edits)
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[t] for t, _, _ in found], pa.int64()), pa.array([own.ids[k] for _, k, _ in found], pa.string()), pa.array([e for _, _, e in found], pa.bool_())],
                    ["id", "item_id", "exact"],
                )

    return docs.mapInArrow(rows, "id long, item_id string, exact boolean"), sent
