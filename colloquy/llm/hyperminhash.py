"""Near-duplicate classes of documents by HyperMinHash sketches and exact verification.

1. One pass over the texts leaves per document the size and a 128-bit hash of its
   set of word shingles and its sketch. Documents of equal sets become one class.
2. A sketch has ``BUCKETS`` registers: leading zeros and ``MANTISSA`` bits of the
   least hash in each bucket. Sets of up to ``SMALL_MOST`` shingles insert every
   shingle ``REPEATS`` times under different seeds, so that their buckets fill as
   well; sets around that size have both kinds of sketch.
3. Bands of ``ROWS`` registers are candidates' keys. At similarity 0.8 a pair shares
   none of the 32 bands with probability 5e-8.
4. Within a key everyone is paired with one hub, the member that shares most keys
   with others, so a key of n members costs n pairs. Pairs whose sizes or
   collision-corrected estimate rule a link out are dropped; the rest are verified
   on their full sets.
5. Keys whose members are still in several components are compared member by member,
   in blocks of bounded size, and verified inside the task that holds the block. Only
   links leave it, so nothing grows with the square of a key, and no link is lost.

Shingles are compared as 64-bit hashes; two different ones in a pair of documents
collide with a probability of about (shingles)**2 / 2**64.

Rows: a NULL or wordless text is linked with nothing. A text of fewer words than a
shingle is one shingle. Repeated rows and repeated ids belong to the class of their
own text. Rows with NULL id take part; a component of such rows only has id NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stored

BUCKETS = 128
MANTISSA = 10
ROWS = 4
REPEATS = 32
SMALL_MOST = 320
LARGE_LEAST = 205  # below 0.8 * 256, so pairs across SMALL_MOST share a kind
#: Estimates below the threshold by so many standard deviations rule a pair out.
DEVIATIONS = 5.5
BLOCK_MEMBERS = 256
BLOCK_CHARS = 1 << 24
_WORDS_KEPT = 1 << 20
_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"seed %d" % i) for i in range(REPEATS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes. Bytes lower and split on ASCII alone."""
    split = (text or b"").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.array([_HASHES[w] for w in split], np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Registers of sorted hashes: 0 where empty, else 1 + leading zeros and mantissa of the least."""
    bits = 64 - (BUCKETS.bit_length() - 1)
    bounds = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(bits)
    first = np.searchsorted(hashes, bounds)
    least = hashes[np.minimum(first, len(hashes) - 1)]
    there = (first < len(hashes)) & (least >> np.uint64(bits) == np.arange(BUCKETS, dtype=np.uint64))
    fraction, exponent = np.frexp((least & np.uint64((1 << bits) - 1)).astype(float))
    zeros = np.clip(bits - exponent, 0, 61)
    mantissa = np.where(fraction > 0, (2 * fraction - 1) * (1 << MANTISSA), 0).astype(np.int64)
    value = 1 + (zeros.astype(np.int64) << MANTISSA) + np.minimum(mantissa, (1 << MANTISSA) - 1)
    return np.where(there, value, 0).astype("<u2")


def small_registers(shingles: np.ndarray) -> np.ndarray:
    return registers(np.sort(_mix(shingles[:, None] ^ _SEEDS[None, :]).ravel()))


def estimate(a: np.ndarray, b: np.ndarray, per_bucket_a: np.ndarray, per_bucket_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for registers that agree by chance.

    ``per_bucket``: hashes inserted per bucket, on average. Two registers of
    unlike shingles agree if their leading zeros do and then their mantissas do.
    """
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    level = np.arange(1, 58)

    def zeros(rate):  # probabilities of 0, 1, .. leading zeros of the least of so many hashes
        above = np.exp(-np.multiply.outer(rate, 2.0**-level))
        return np.diff(above, axis=-1, prepend=0)

    chance = (zeros(per_bucket_a) * zeros(per_bucket_b)).sum(-1) * 2.0**-MANTISSA
    return np.clip((same - used * chance) / np.maximum(used * (1 - chance), 1e-9), 0, 1)


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - DEVIATIONS * (j * (1 - j) / BUCKETS) ** 0.5


def sketches(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, text_hash, chars, n, h1, h2, small, large)`` per row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("_data"))

    def run(batches):
        names = ["doc", "text_hash", "chars", "n", "h1", "h2", "small", "large"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for data in batch.column("_data").to_pylist():
                s = shingle_set(data, words)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                h1, h2 = np.frombuffer(digest, np.int64).tolist()
                small = small_registers(s).tobytes() if 0 < len(s) <= SMALL_MOST else None
                large = registers(s).tobytes() if len(s) >= LARGE_LEAST else None
                out.append((len(data or b""), len(s), h1, h2, small, large))
            columns = zip(*out) if out else ((),) * 6
            arrays = [batch.column("doc"), batch.column("text_hash"), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(
        run,
        f"doc {kind}, text_hash bigint, chars bigint, n bigint, h1 bigint, h2 bigint, small binary, large binary",
    )


def band_keys(classes: DataFrame) -> DataFrame:
    """``(key, class)`` for every band of registers that is not empty."""

    def run(batches):
        for batch in batches:
            keys, owners = [], []
            ids = batch.column("class").to_numpy()
            for kind, name in enumerate(("small", "large")):
                column = batch.column(name)
                at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                joined = np.frombuffer(b"".join(column.drop_null().to_pylist()), "<u8").reshape(len(at), -1)
                bands = np.arange(joined.shape[1], dtype=np.uint64) + np.uint64(1 + 1000 * kind)
                mixed = _mix(_mix(joined) + bands * np.uint64(0x9E3779B97F4A7C15))
                full = joined > 0
                keys.append(mixed[full].view(np.int64))
                owners.append(np.broadcast_to(ids[at][:, None], joined.shape)[full])
            if keys:
                arrays = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "class"])

    return classes.select("class", "small", "large").mapInArrow(run, "key bigint, class bigint")


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _registers_of(row_small, row_large, n):
    """Stacked registers and insertions per bucket for each kind; rows without that kind are empty."""
    out = []
    for column, repeats in ((row_small, REPEATS), (row_large, 1)):
        data = np.zeros((len(n), BUCKETS), "<u2")
        for i, x in enumerate(column):
            if x is not None:
                data[i] = np.frombuffer(x, "<u2")
        out.append((data, n * repeats / BUCKETS))
    return out


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` that sizes and estimates leave."""
    side = lambda s: classes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "small", "large")])
    both = (
        pairs.join(side("a"), F.col("a") == F.col("class_a"))
        .join(side("b"), F.col("b") == F.col("class_b"))
        .where(_sizes_allow("n_a", "n_b", percent))
        .select("a", "b", "n_a", "n_b", "small_a", "large_a", "small_b", "large_b")
    )
    least = least_estimate(percent)

    def run(batches):
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            a = _registers_of(c["small_a"].to_pylist(), c["large_a"].to_pylist(), c["n_a"].to_numpy())
            b = _registers_of(c["small_b"].to_pylist(), c["large_b"].to_pylist(), c["n_b"].to_numpy())
            kinds = [estimate(x, y, p, q) for (x, p), (y, q) in zip(a, b)]
            both_small = c["small_a"].is_valid().to_numpy(False) & c["small_b"].is_valid().to_numpy(False)
            keep = pa.array(np.where(both_small, *kinds) >= least)
            yield pa.RecordBatch.from_arrays([c["a"].filter(keep), c["b"].filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * 100 >= (len(a) + len(b) - shared) * percent


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    side = lambda s: texts.select(F.col("class").alias(f"class_{s}"), F.col("text").alias(f"text_{s}"))
    both = (
        pairs.join(side("a"), F.col("a") == F.col("class_a"))
        .join(side("b"), F.col("b") == F.col("class_b"))
        .select("a", "b", F.col("text_a").cast("binary").alias("x"), F.col("text_b").cast("binary").alias("y"))
    )

    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "x", "y"))):
                if a != last:
                    last, held = a, shingle_set(x, words)
                keep.append(_linked(held, shingle_set(y, words), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` of every linked node: the least node it reaches, by alternating stars.

    Large star: a node's larger neighbours move to its least neighbour; small star:
    its smaller ones do. The edges of a round are written and read back.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = stored(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _blocks(members: DataFrame) -> DataFrame:
    """Members of unresolved keys, dealt to the tasks ``(key, i, j)`` that compare them.

    Of two members in different components one is outside the key's largest
    component: a probe. Probe block ``j`` meets member block ``i``, so members are
    repeated for every probe block, mostly one, and probes for every member block.
    """
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    largest = by_root.groupBy("key").agg(
        F.max(F.struct("n", "root", "chars")).alias("top"), F.sum("n").alias("n"), F.sum("chars").alias("c")
    )
    needed = lambda n, chars: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(chars / BLOCK_CHARS), F.lit(1)).cast("int")
    sizes = largest.select(
        "key", F.col("top.root").alias("main"), needed(F.col("n"), F.col("c")).alias("blocks"),
        needed(F.col("n") - F.col("top.n"), F.col("c") - F.col("top.chars")).alias("probe_blocks"),
    )
    dealt = members.join(sizes, "key").withColumns(
        {
            "probe": F.col("root") != F.col("main"),
            "mine": F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"),
            "probe_mine": F.pmod(F.xxhash64("class", F.lit(1)), F.col("probe_blocks")).cast("int"),
        }
    )
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = F.transform(upto("probe_blocks"), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j")))
    as_probe = F.transform(upto("blocks"), lambda i: F.struct(i.alias("i"), F.col("probe_mine").alias("j")))
    both = F.when(F.col("probe"), F.array_union(as_member, as_probe)).otherwise(as_member)
    return dealt.select("key", "class", "root", "probe", "mine", "probe_mine", F.explode(both).alias("to")).select(
        "key", "class", "root", "probe", "mine", "probe_mine", "to.i", "to.j"
    )


def _block_links(members: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of a key that are in different components."""
    rows = (
        _blocks(members)
        .join(classes.select("class", "n", "small", "large"), "class")
        .join(texts.select("class", F.col("text").cast("binary").alias("text")), "class")
    )
    least = least_estimate(percent)

    def run(table: pa.Table) -> pa.Table:
        by_class = {r["class"]: r for r in table.to_pylist()}  # repeated rows have the text twice
        rows = [by_class[c] for c in sorted(by_class)]
        n = np.array([r["n"] for r in rows])
        kinds = _registers_of([r["small"] for r in rows], [r["large"] for r in rows], n)
        small = np.array([r["small"] is not None for r in rows])
        label = {r["root"]: r["root"] for r in rows}
        here = np.array([r["mine"] == r["i"] for r in rows])
        probes = [k for k, r in enumerate(rows) if r["probe"] and r["probe_mine"] == r["j"]]
        sets, out = {}, []

        def root(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        def shingles(k):
            if k not in sets:
                sets[k] = shingle_set(rows[k]["text"], words)
            return sets[k]

        for k in probes:
            rest = np.flatnonzero(here)
            rest = rest[rest != k]
            rest = rest[np.minimum(n[rest], n[k]) * 100 >= np.maximum(n[rest], n[k]) * percent]
            if not len(rest):
                continue
            guesses = [estimate(d[rest], d[k], p[rest], np.full(len(rest), p[k])) for d, p in kinds]
            for other in rest[np.where(small[rest] & small[k], *guesses) >= least]:
                x, y = root(rows[k]["root"]), root(rows[other]["root"])
                if x != y and _linked(shingles(k), shingles(other), percent):
                    label[x] = y
                    out.append((rows[k]["class"], rows[other]["class"]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def near_duplicate_groups(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_shingles, component_id, kept, text_hash, group_id)`` per row of ``docs``.

    Documents are linked when 100 * shared shingles >= ``percent`` * shingles of
    both; ``component_id`` is the least id of those reached through links, and
    ``kept`` marks the documents that have it. ``group_id`` numbers the groups (NULL for documents without
    shingles), so that groups of NULL ids differ; ``text_hash`` tells texts of one id apart. ``percent`` is 80 or more, for
    which the bands and kinds of sketches are chosen.
    """
    if percent < 80:
        raise ValueError("bands are chosen for 80 percent or more")
    every = stored(sketches(docs, words, key, text), "sketches")
    filled = every.where("n > 0")
    one = F.min(F.struct("doc", "text_hash"))
    classes = stored(
        filled.groupBy("h1", "h2")
        .agg(one.alias("one"), F.min("doc").alias("least"), *[F.first(c).alias(c) for c in ("n", "chars", "small", "large")])
        .select(F.monotonically_increasing_id().alias("class"), "h1", "h2", "one.doc", "one.text_hash", "least", "n", "chars", "small", "large"),
        "classes",
    )
    # Sets of up to three shingles differ by a quarter or more, so they have no near copies.
    bands = band_keys(classes.where("n > 3"))
    shared = stored(
        bands.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("a"), F.max("class").alias("b"))
        .where("size > 1"),
        "band-keys",
    )
    members = stored(bands.join(shared.where("size > 2").select("key", "size"), "key"), "band-members")
    central = members.groupBy("class").agg(F.sum("size").alias("weight"))
    hub = (
        members.join(central, "class")
        .groupBy("key")
        .agg(F.max(F.struct("weight", (-F.col("class")).alias("minus"))).alias("top"))
        .select("key", (-F.col("top.minus")).alias("hub"))
    )
    stars = members.join(hub, "key").where("class <> hub").select(
        F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")
    )
    pairs = shared.where("size = 2").select("a", "b").union(stars).distinct()
    likely = stored(_likely(pairs, classes, percent), "likely-pairs")

    needed = likely.select(F.col("a").alias("class")).union(likely.select("b")).union(members.select("class")).distinct()
    wanted = classes.select("class", "doc", "text_hash").join(needed, "class")
    texts = stored(
        docs.select(F.col(key).alias("_doc"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
        .join(wanted, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_hash") == F.col("text_hash")))
        .select("class", "text"),
        "candidate-texts",
    )
    links = stored(_verified(likely, texts, words, percent), "links")
    first = components(links)

    labelled = members.join(first, F.col("class") == F.col("node"), "left").select(
        "key", "class", F.coalesce("root", "class").alias("root")
    )
    split = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    open_members = stored(
        labelled.join(split, "key").join(classes.select("class", "chars"), "class"), "open-members"
    )
    more = _block_links(open_members, classes, texts, words, percent)
    final = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    rooted = classes.join(final, F.col("class") == F.col("node"), "left").select(
        "h1", "h2", "least", F.coalesce("root", "class").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("h1", "h2", "component_id", F.col("root").alias("group_id"))
    return (
        every.join(named, ["h1", "h2"], "left")
        .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")))
        .select(
            F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id",
            F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "group_id",
        )
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` of ``near_duplicate_groups``."""
    return near_duplicate_groups(docs, words, percent, key, text).select(key, "n_shingles", "component_id", "kept")
