"""Packing documents into fixed-length token sequences by the linear grouping scheme.

1. Documents are tokenized, ended by an id and cut only where longer than a
   sequence. One pass leaves a narrow row per piece; no text is shuffled.
2. The histogram of piece lengths, at most ``capacity`` counts, is planned on the
   driver. Large lengths, sorted down, are split into groups of equal cardinality
   and rounded up to the group's largest. Few sizes are left, and a linear program
   over their configurations, solved by column generation, says how many
   sequences take each configuration.
3. Actual pieces, longest first, take the slots of their group. A run of sequences
   with equal contents stays one row of the plan, so the plan's size depends on
   ``capacity`` and the number of groups, not on the number of documents.
4. What the whole-numbered solution leaves over, and the small pieces, go longest
   first into the sequence with the least room that takes them.
5. Every piece finds its slot by its length and its rank among pieces of that length.

Rows: a NULL text is empty (one piece, the end id). Repeated rows, NULL ids and
ties are pieces like any other.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import stored

CAPACITY = 2048
GROUPS = 96
#: Pieces above capacity / LARGE are grouped; so many fit in a sequence at most.
LARGE = 8
#: Entries of one generation of a worker's tables, the longest word that is kept, and parts joined for one call.
CACHE_WORDS, CACHE_CHARS, JOINED = 1 << 18, 64, 512
#: Characters that are encoded at a time, if a single text is not longer.
SLICE_CHARS = 1 << 20

# White-space words of these characters are unchanged by Unicode normalisation and
# lower-cased one character at a time, so that they can be split here.
_LATIN = re.compile("[\x21-\x7e\u00c0-\u017f]+")
_PARTS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]"
    "|[^\\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
)


class _Table:
    """What ``learn`` makes of words, in two bounded generations.

    When the young entries are full they become the old ones, and those found there are young again.
    """

    def __init__(self, learn):
        self.learn, self.young, self.old = learn, {}, {}

    def of(self, words: set[str]) -> dict[str, bytes]:
        got = dict(zip(words, map(self.young.get, words)))
        missing = [w for w, ids in got.items() if ids is None]
        if not missing:
            return got
        found = {w: self.old[w] for w in missing if w in self.old}
        found.update(self.learn([w for w in missing if w not in found] if found else missing))
        got.update(found)
        if max(map(len, found)) > CACHE_CHARS:
            found = {w: ids for w, ids in found.items() if len(w) <= CACHE_CHARS}
        if len(self.young) + len(found) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        if len(found) <= CACHE_WORDS:
            self.young.update(found)
        return got


class _WordIds:
    """Ids of white-space words as little-endian bytes, for a tokenizer that never joins words.

    Words of plain letters and marks are put together from their parts, which
    recur more often and are encoded many at a time: an id that ends a word ends a part.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = _Table(self.word_ids), _Table(self.part_ids)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def part_ids(self, parts: list[str]) -> dict[str, bytes]:
        out, groups = {}, [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        for group, joined in zip(groups, self.ids([" ".join(g) for g in groups])):
            ends = (4 * np.flatnonzero(self.ends[np.frombuffer(joined, "<u4")]) + 4).tolist()
            if len(ends) == len(group):
                out.update(zip(group, [joined[a:b] for a, b in zip([0, *ends], ends)]))
            else:  # a part that lower-casing made two of, or a tokenizer that ends words otherwise
                out.update(zip(group, self.ids(group)))
        return out

    def word_ids(self, words: list[str]) -> dict[str, bytes]:
        odd = [] if _LATIN.fullmatch("".join(words)) else [w for w in words if not _LATIN.fullmatch(w)]
        if odd:
            words = list(set(words).difference(odd))
        whole = [w for w in words if w.isalpha()]
        split = {w: _PARTS.findall(w.lower()) for w in words if not w.isalpha()}
        lower = list(map(str.lower, whole))
        of = self.parts.of(set(lower).union(*split.values())).__getitem__
        out = dict(zip(whole, map(of, lower)))
        out.update((w, b"".join(map(of, parts))) for w, parts in split.items())
        out.update(zip(odd, self.ids(odd)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        ids_of = self.words.of(set().union(*split)).__getitem__
        return [b"".join(map(ids_of, words)) for words in split]


#: Per worker process, so only functions of this module that workers import touch it.
_ENCODERS: dict[str, _WordIds] = {}


def encode_words(path: str, texts: list[str]) -> list[bytes]:
    """Ids of ``texts`` by a tokenizer file whose lower-casing pieces never span white space.

    A text with ``<|`` may hold a special token and is encoded as a whole.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = _WordIds(path)
    words = _ENCODERS[path]
    plain = iter(words.encode([t for t in texts if "<|" not in t]))
    return [words.ids([t])[0] if "<|" in t else next(plain) for t in texts]


def word_encoder(path: str):
    return functools.partial(encode_words, path)


def runs_of_rows(sizes: list[int], most: int = SLICE_CHARS):
    """``(first, rows)`` of neighbouring rows with at most ``most`` in all, or a single row."""
    first, held = 0, 0
    for at, size in enumerate(sizes):
        if at > first and held + size > most:
            yield first, at - first
            first, held = at, 0
        held += size
    if sizes:
        yield first, len(sizes) - first


def pieces(
    docs: DataFrame, encode, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, part, rank[, ids])``: the cut documents.

    ``rank`` counts the pieces of equal length within the task ``part``. Pin the
    result before using those two.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    extra = ", ids array<int>" if with_ids else ""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for whole in batches:
            for at, n in runs_of_rows(pc.binary_length(whole.column("_text")).to_pylist()):
                batch = whole.slice(at, n)
                keys, out = [], []
                texts = batch.column("_text").to_pylist()
                for row, ids in enumerate(encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        length = len(cut) // 4
                        keys.append(row)
                        out.append((k, start, length, zlib.crc32(cut), part, seen[length], cut))
                        seen[length] += 1
                k, start, length, crc, parts, rank, cut = zip(*out)
                arrays = [batch.column("_key").take(pa.array(keys)), pa.array(k, pa.int32())]
                arrays += [pa.array(x, pa.int64()) for x in (start, length, crc, parts, rank)]
                names = ["_key", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cut], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).mapInArrow(
        run,
        f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, rank bigint{extra}",
    )


def group_lengths(histogram: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs of ``(length, count)``, longest first, in groups of equal cardinality."""
    total = sum(histogram.values())
    size = max(1, -(-total // groups))
    out, room = [[]], size
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return [g for g in out if g]


def _best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes of the highest value that fits, by one table row per item placed."""
    best = np.zeros(capacity + 1)
    chosen = []
    for _ in range(int(capacity // sizes.min())):
        with_one = np.full((len(sizes), capacity + 1), -1.0)
        for i, s in enumerate(sizes):
            with_one[i, s:] = best[: capacity + 1 - s] + value[i]
        pick = with_one.argmax(0)
        new = with_one.max(0)
        pick[new <= best] = -1
        chosen.append(pick)
        best = np.maximum(best, new)
    counts, w = np.zeros(len(sizes), int), capacity
    for pick in reversed(chosen):
        if pick[w] >= 0:
            counts[pick[w]] += 1
            w -= sizes[pick[w]]
    return counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """How many sequences take which multiset of sizes: the linear program, rounded down.

    Simplex on the covering program, entering columns found by a knapsack over
    the dual prices. What rounding down leaves over is packed with the small pieces.
    """
    s, d = np.array(sizes), np.array(demand, float)
    columns = np.diag(capacity // s).astype(float)
    for _ in range(40 * len(s) + 200):
        prices = np.linalg.solve(columns.T, np.ones(len(s)))
        new = _best_configuration(s, np.maximum(prices, 0), capacity)
        if new @ prices <= 1 + 1e-7:
            break
        amount, step = np.linalg.solve(columns, d), np.linalg.solve(columns, new.astype(float))
        ratios = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, ratios.argmin()] = new
    amount = np.linalg.solve(columns, d)
    out = []
    for k in range(len(s)):
        n = int(np.floor(amount[k] + 1e-6))
        if n > 0:
            out.append((tuple(int(round(x)) for x in columns[:, k]), n))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Segments ``(length, rank, count, sequence, copies, offset)`` and the number of sequences.

    The ``t``-th piece of a segment goes to sequence ``sequence + t // copies`` at
    ``offset + (t % copies) * length``.
    """
    segments, taken, sequences = [], defaultdict(int), 0
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs (sequence, count)
    free: list[int] = []

    def put(length, count, sequence, copies, offset):
        segments.append((length, taken[length], count, sequence, copies, offset))
        taken[length] += count

    def leave(left, sequence, count):
        if left and count:
            if not room[left]:
                insort(free, left)
            room[left].append((sequence, count))

    large = {x: n for x, n in histogram.items() if capacity // LARGE < x < capacity}
    rest = {x: n for x, n in histogram.items() if x not in large and x < capacity}
    if n := histogram.get(capacity, 0):
        put(capacity, n, sequences, 1, 0)
        sequences += n
    if large:
        grouped = group_lengths(large, groups)
        sizes = [g[0][0] for g in grouped]
        merged: list[list[tuple[int, int]]] = []  # groups of one size are one size of the program
        for k, g in enumerate(grouped):
            if k and sizes[k] == sizes[k - 1]:
                merged[-1] += g
            else:
                merged.append(list(g))
        sizes = [g[0][0] for g in merged]
        solved = configurations(sizes, [sum(n for _, n in g) for g in merged], capacity)
        for config, n in solved:
            # Actual pieces for every slot of these n sequences, as runs of equal length.
            slots = []
            for k, times in enumerate(config):
                for _ in range(times):
                    runs, need = [], n
                    while need and merged[k]:
                        length, have = merged[k][0]
                        take = min(have, need)
                        runs.append((length, take))
                        need -= take
                        merged[k][0] = (length, have - take)
                        if have == take:
                            merged[k].pop(0)
                    slots.append(runs)
            cuts = sorted({0, n} | {int(c) for runs in slots for c in np.cumsum([t for _, t in runs])})
            lookup = [np.cumsum([t for _, t in runs]) for runs in slots]
            for a, b in zip(cuts, cuts[1:]):
                offset = 0
                for runs, ends in zip(slots, lookup):
                    at = int(np.searchsorted(ends, a, side="right"))
                    if at < len(runs):
                        put(runs[at][0], b - a, sequences + a, 1, offset)
                        offset += runs[at][0]
                leave(capacity - offset, sequences + a, b - a)
            sequences += n
        for g in merged:
            for length, n in g:
                rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect_left(free, length)
            if at == len(free):
                copies = capacity // length
                run = (sequences, -(-left // copies))
                sequences += run[1]
                have = capacity
            else:
                have = free[at]
                run = room[have].pop()
                if not room[have]:
                    free.pop(at)
            sequence, count = run
            copies = have // length
            full = min(count, left // copies)
            if full:
                put(length, full * copies, sequence, copies, capacity - have)
                leave(have - copies * length, sequence, full)
                left -= full * copies
            if full < count and left:  # fewer than one sequence's fill is left
                put(length, left, sequence + full, copies, capacity - have)
                leave(have - left * length, sequence + full, 1)
                left, full = 0, full + 1
            leave(have, sequence + full, count - full)
    return np.array(sorted(segments), dtype=np.int64).reshape(-1, 6), sequences


def pack(
    docs: DataFrame, encode, capacity: int = CAPACITY, end_id: int = 0, groups: int = GROUPS, key: str = "doc_id",
    text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Every piece with its ``sequence_id`` and gapless ``offset`` there.

    Ranks of equal lengths are local ranks plus the pieces of earlier tasks; the
    window that adds those up sees one row per task and length.
    """
    cut = stored(pieces(docs, encode, capacity, end_id, key, text, with_ids), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, _ = plan(histogram, capacity, groups)
    ranked = cut.join(offsets, ["length", "part"]).select(
        *[c for c in cut.columns if c not in ("part", "rank")], (F.col("rank") + F.col("before")).alias("rank")
    )
    starts = segments[:, 0] << 40 | segments[:, 1]
    fields = [f for f in ranked.schema.fields if f.name != "rank"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, length << 40 | rank, side="right") - 1
            _, first, _, sequence, copies, offset = segments[at].T
            t = rank - first
            arrays = [batch.column(f.name) for f in fields]
            arrays += [pa.array(sequence + t // copies), pa.array(offset + (t % copies) * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*[f.name for f in fields], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """``(sequence_id, ids)``: the token ids of every sequence, from ``pack(with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", ids)))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x[ids])).alias("ids"))
