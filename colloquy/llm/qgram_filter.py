"""Benchmark decontamination by the q-gram lemma and banded alignment.

An occurrence of an item of m characters with at most e edits shares at least
``T = m - Q + 1 - Q e`` of the item's q-grams with the text, all on diagonals (place
in text minus place in item) within e of one another. Hits are counted in diagonal
bands of width ``2 (e + 1)`` that overlap by half, so one band holds them all. Bands
with T hits are aligned within the band, and regions within the edit budget reported.

Texts and items are compared in lower case with every run of white space as one
space. The budget is ``ERROR_PERCENT`` of the item, less for short items so that T stays
at ``LEAST_HITS`` or more. Items over ``LONG`` characters are searched in consecutive
windows of half of that, each a passage of its own with an even share of the budget.
Items under ``SHORTEST`` characters say too little and match nothing.

The items are taken in blocks of at most ``BLOCK_CHARS`` characters; each block's index
goes to the tasks and meets every text once. Texts are whole; long ones are searched
in slices that overlap by more than any occurrence.

Rows: NULL or empty texts and items match nothing; repeated rows and ids are searched
and reported each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
ERROR_PERCENT = 10
LEAST_HITS = 4
SHORTEST = 16
LONG = 1000  # below 1024, as places in an item take ten bits
BLOCK_CHARS = 1 << 22
SLICE = 1 << 19
_BITS = 22
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with single spaces, and their places in ``text``."""
    low = text.lower()
    if len(low) != len(text):  # a character whose lower case is longer stays as it is
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (codes <= 32) & ((codes == 32) | (codes >= 9) & (codes <= 13)) | (codes == 0xA0) | (codes == 0x85)
    codes = np.where(space, np.uint32(32), codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return codes[at], at


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of Q = 8 code points, by doubling."""
    h = codes.astype(np.uint64) + np.uint64(1)
    for step, factor in zip((1, 2, 4), _FACTORS):
        h = h[:-step] * factor + h[step:]
        h ^= h >> np.uint64(31)
    return h * _FACTORS[0]


def budget(m: int) -> int:
    """Edits allowed in an item of m characters."""
    return max(0, min(m * ERROR_PERCENT // 100, (m - Q + 1 - LEAST_HITS) // Q))


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, self.codes = [], []
        for item, text in items:
            codes, _ = normalized((text or "").strip())
            if len(codes) < SHORTEST:
                continue
            step = LONG // 2 if len(codes) > LONG else len(codes)
            for a in range(0, len(codes), step):
                part = codes[a : a + step]
                if len(part) < step and a:  # the last window ends with the item
                    part = codes[-step:]
                self.ids.append(item)
                self.codes.append(part)
        lengths = [len(c) for c in self.codes]
        self.length = np.array(lengths, np.int64)
        self.edits = np.array([budget(m) for m in lengths], np.int64)
        self.hits = self.length - Q + 1 - Q * self.edits
        self.reach = int((self.length + 4 * self.edits + 8).max()) if lengths else 0
        hashes = [grams(c) for c in self.codes]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, int)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, first, count = np.unique(every[order], return_index=True, return_counts=True)
        self.first, self.count = first, count
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """``(item, first diagonal)`` of the bands with enough hits."""
        if len(codes) < Q or not len(self.grams):
            return []
        h = grams(codes)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).view(np.int64)])
        h = h[at]
        k = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        true = self.grams[k] == h
        at, k = at[true], k[true]
        n = self.count[k]
        entry = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[entry]
        diagonal = np.repeat(at, n) - self.place[entry] + self.reach
        band = diagonal // (self.edits[item] + 1)
        # A q-gram of the item counts once in a band, so that repetitive texts do not fill it.
        once = np.unique(item << 44 | band << 10 | self.place[entry]) >> 10
        if not len(once):
            return []
        keys, counts = np.unique(once, return_counts=True)
        both = counts.copy()
        both[:-1] += np.where(keys[1:] == keys[:-1] + 1, counts[1:], 0)
        good = np.flatnonzero(both >= self.hits[keys >> 34])
        return [
            (int(x >> 34), int((x & ((1 << 34) - 1)) * (self.edits[x >> 34] + 1) - self.reach)) for x in keys[good]
        ]


def _ends(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """Least edits of ``item`` against a run of ``text``, and that run's end; diagonals ``low`` to ``high`` only.

    Row by row; within a row insertions are a running minimum. Ends early with
    more than ``most`` edits once every cell has them.
    """
    width = high - low + 1
    ramp = np.arange(width)
    big = len(item) + width + 9
    shift = len(item) + width + abs(low)  # place 0 of the text in ``padded``
    padded = np.full(shift + len(text) + len(item) + width + abs(high) + 4, np.uint32(0xFFFFFFFF))
    padded[shift : shift + len(text)] = text
    ends = np.arange(low, high + 1)
    row = np.where((ends >= 0) & (ends <= len(text)), 0, big)
    for i, c in enumerate(item):
        window = padded[shift + i + low : shift + i + low + width]
        best = np.minimum(row + (window != c), np.append(row[1:], big) + 1)
        row = np.minimum.accumulate(best - ramp) + ramp
        outside = ramp + (i + 1 + low)
        row = np.where((outside < 0) | (outside > len(text)), big, row)
        if i % 8 == 7 and row.min() > most:
            return most + 1, 0
    k = int(row.argmin())
    return int(row[k]), len(item) + low + k


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """``(start, end, edits)`` of the best run of ``text`` within the diagonals, if within ``most`` edits."""
    for start in range(max(0, low), min(high, len(text) - len(item)) + 1):  # runs without edits lie on one diagonal
        if text[start] == item[0] and np.array_equal(text[start : start + len(item)], item):
            return start, start + len(item), 0
    edits, end = _ends(item, text, low, high, most)
    if edits > most:
        return None
    # The start is the end of the reversed item in the reversed prefix.
    back = text[:end][::-1]
    edits, length = _ends(item[::-1], back, -most, most, most)
    return (end - length, end, edits) if edits <= most else None


def _regions(index: Index, codes: np.ndarray, bounds: np.ndarray):
    """``(unit, item, start, end, edits)`` of verified regions; units lie between ``bounds``."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for item, diagonal in index.candidates(codes):
        m, e = int(index.length[item]), int(index.edits[item])
        low, high = diagonal - e, diagonal + 3 * e + 2
        first = max(0, int(np.searchsorted(bounds, low, side="right")) - 1)
        last = min(len(bounds) - 1, int(np.searchsorted(bounds, high + m, side="left")))
        for unit in range(first, last):  # a band may begin before the unit that holds its region
            a, b = max(int(bounds[unit]), low - e), min(int(bounds[unit + 1]) - 1, high + m + e)
            known = found.setdefault((unit, item), [])
            if b - a < m - e or any(s >= low and s <= high and n == 0 for s, _, n in known):
                continue
            hit = align(index.codes[item], codes[a:b], low - a, high - a, e)
            if hit:
                start, end, edits = a + hit[0], a + hit[1], hit[2]
                over = [x for x in known if x[0] < end and start < x[1]]  # the same region by another band
                if all(edits < x[2] for x in over):
                    known[:] = [x for x in known if x not in over] + [(start, end, edits)]
    return [(unit, item, *hit) for (unit, item), hits in found.items() for hit in hits]


def search(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """``(row, item number, start, end, edits)`` over whole texts, in code points of each."""
    out, units, parts, size = set(), [], [], 0

    def flush():
        nonlocal units, parts, size
        if not units:
            return
        lengths = [len(p[0]) + 1 for p in parts]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        codes = np.full(int(bounds[-1]), np.uint32(0), np.uint32)
        for (c, _), a in zip(parts, bounds):
            codes[a : a + len(c)] = c
        for unit, item, start, end, edits in _regions(index, codes, bounds):
            row, offset = units[unit]
            places = parts[unit][1]
            s, e = start - int(bounds[unit]), end - int(bounds[unit])
            if e > s:
                out.add((row, item, offset + int(places[s]), offset + int(places[e - 1]) + 1, edits))
        units, parts, size = [], [], 0

    for row, text in enumerate(texts):
        if not text:
            continue
        overlap = 2 * index.reach + 64
        for a in range(0, max(1, len(text) - overlap if len(text) > SLICE else 1), SLICE):
            piece = text[a : a + SLICE + overlap]
            units.append((row, a))
            parts.append(normalized(piece))
            size += len(piece)
            if size >= SLICE:
                flush()
    flush()
    return sorted(out)


def _blocks(benchmark: DataFrame, item: str, text: str, block_chars: int):
    """Lists of items of at most ``block_chars`` characters, one list at a time."""
    block, size = [], 0
    for r in benchmark.where(F.length(text) >= SHORTEST).select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        if block and size + len(r["t"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(key, text_hash, item, start, end, edits)``: regions of ``docs`` that repeat an item within its budget."""
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, text_hash bigint, `{item}` {kinds[1]}, start bigint, end bigint, edits int"
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    results = []
    for block in _blocks(benchmark, item, item_text, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                hits = search(index, batch.column("_text").to_pylist())
                if not hits:
                    continue
                row, number, start, end, edits = zip(*hits)
                at = pa.array(row)
                arrays = [batch.column("_key").take(at), batch.column("_hash").take(at), pa.array([index.ids[n] for n in number])]
                arrays += [pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "text_hash", item, "start", "end", "edits"])

        results.append(rows.mapInArrow(run, schema))
    out = docs.sparkSession.createDataFrame([], schema)
    for r in results:
        out = out.unionByName(r)
    return out
