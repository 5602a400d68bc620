"""Near-duplicate detection by MinHash, banding, verification and connected components.

1. Each text becomes the set of its distinct shingles of ``words`` words, hashed to 64 bits, and a signature of
   the set's minima under ``BANDS * ROWS`` universal hash functions (multiply, add, keep the high bits).
   Equal sets form a class; the class of the smallest id stands for its documents from here on.
2. The signature's bands are keys.  In each bucket of a key every class is a candidate of the bucket's
   smallest class, so a bucket of n classes gives n - 1 pairs and never n squared.
3. A candidate pair must agree in its signatures up to five standard deviations below the threshold, and
   is then confirmed on the full sets, derived anew from the whole texts.  Texts meet at their bucket's
   smallest class, which is dealt over several groups if it has many candidates.
4. Components of the confirmed links come from alternating large-star and small-star steps.
5. Where a bucket still holds several components, links that do not touch its smallest class may be missing.
   There the classes of different components are compared with one another inside tasks, in blocks of
   ``BLOCK``: by signature first, and the classes that are in some candidate pair once more with their texts,
   the likeliest first, on the full sets, until two components are found to be linked.  A pair is looked at in
   the first bucket that it shares only, which the buckets' full keys tell.  Tasks return classes and links,
   never pairs, and no candidate pair of different components stays unexamined.

With 32 bands of 5 rows a pair of similarity 0.8 shares no band with probability 3e-6.

Defined cases: a text without words is empty and linked with nothing; fewer words than a shingle has make one
shingle; rows of null ids never represent others and have a null component; rows of equal id are one
document for links; repeated rows repeat in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, discard, give_back, staged

BANDS, ROWS, BLOCK, PER_GROUP, BROADCAST_IDS = 32, 5, 512, 256, 500_000
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8))
_CHUNK = 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes by prefix sums, then mixed with its length."""
    data = np.frombuffer(raw.translate(_FOLD), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_BLANK[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def shingles(raw: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8."""
    hashed = word_hashes(raw)
    if not len(hashed):
        return hashed
    wide = min(words, len(hashed))
    n = len(hashed) - wide + 1
    out = np.full(n, wide, np.uint64)
    for i in range(wide):
        out = _mixed(out * np.uint64(_BASE) + hashed[i : i + n])
    return np.unique(out)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(7, 7 + 2 * BANDS * ROWS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return seeds[::2, None] | np.uint64(1), seeds[1::2, None]


def signature(found: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """uint32 minima of a non-empty set."""
    a, b = functions
    least = np.full(len(a), np.iinfo(np.uint64).max)
    values = found >> np.uint64(32)
    for at in range(0, len(values), _CHUNK):
        hashed = values[None, at : at + _CHUNK] * a
        hashed += b
        np.minimum(least, hashed.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _utf8(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set) and sig; the last two null for empty sets."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions, memo = _functions(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part, rows = batch.slice(at, 2000), []
                for text in part.column("text"):
                    found = shingles(_utf8(text.as_py()), words)
                    if not len(found):
                        rows.append((0, None, None))
                        continue
                    key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    if key not in memo:
                        if len(memo) > 20_000:
                            memo.clear()
                        memo[key] = signature(found, functions).tobytes()
                    rows.append((len(found), key, memo[key]))
                n, keys, sigs = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])
        memo.clear()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketched, "doc_id long, n_shingles long, set_key binary, sig binary")


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the low bytes of the signatures, which suffice to compare them."""
    for batch in batches:
        low = [np.frombuffer(s.as_py(), np.uint32).astype(np.uint8).tobytes() for s in batch.column("sig")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.binary())], ["set_key", "id", "sig", "low"])


def _bands(classes: DataFrame) -> DataFrame:
    """key, band, id: a row for each band of each class."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(salt, sig.shape[:2]).copy()
            for k in range(ROWS):
                key = _mixed(key * np.uint64(_BASE) + sig[:, :, k])
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(np.repeat(np.array(batch.column("id")), BANDS), pa.int64())], ["key", "band", "id"])

    return classes.select("id", "sig").mapInArrow(banded, "key long, band int, id long")


def _least_agreement(percent: int) -> float:
    share, n = percent / 100, BANDS * ROWS
    return share - 5 * math.sqrt(share * (1 - share) / n)


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough."""
    least = _least_agreement(percent)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    sides = [classes.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b").mapInArrow(compared, "a long, b long")


def _with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with the text of their id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    ids = rows.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:  # 8 bytes each: texts that nobody asks for are left out before they move
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    return rows.join(texts, "id")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    # Written first, as Spark splits a hot key of a join only where both sides come straight from a shuffle.
    n = staged(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PER_GROUP).alias("groups")), "groups")
    dealt = pairs.join(n, "b").select("a", "b", F.pmod(F.xxhash64("a"), "groups").alias("part"))
    wanted = staged(
        dealt.select(F.col("a").alias("id"), "b", "part", F.lit(1).alias("side"))
        .unionByName(dealt.select(F.col("b").alias("id"), "b", "part", F.lit(0).alias("side")).distinct()),
        "wanted",
    )
    rows = _with_texts(wanted, docs)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            found = []
            for id_, b, part, side, text in zip(*(batch.column(c) for c in ("id", "b", "part", "side", "text"))):
                if at != (b.as_py(), part.as_py()):
                    at, centres = (b.as_py(), part.as_py()), []
                own = shingles(_utf8(text.as_py()), words)
                if side.as_py() == 0:
                    centres.append(own)
                elif any(linked(own, c, percent) for c in centres):
                    found.append((id_.as_py(), at[0]))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "side").mapInArrow(verified, "a long, b long").distinct()


def _directed(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """No node has two parents, and no parent has one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """Of each node of links (a, b) but the smallest of its component: a, and that smallest as b.

    A large-star step hangs each node's larger neighbours on its smallest one, a small-star step its smaller
    neighbours and itself; they alternate until each component is a star.
    """
    edges, old = _directed(links), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _directed(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        edges = staged(_directed(small), "stars")
        if old is not None:
            discard(old)
        if _is_star_forest(edges):
            return edges
        old = edges


class _Block:
    """The rows of one block of a bucket: (id, component, own block, low bytes, keys of earlier open buckets, text)."""

    def __init__(self, i: int, j: int, least: float):
        self.i, self.j, self.least = i, j, least
        self.rows: list[tuple] = []

    def candidates(self) -> Iterator[tuple[tuple, list[tuple]]]:
        """Each row of the left block with its candidates in the right one, the likeliest first.

        A candidate is of another component, agrees in its signature, and shares no earlier bucket.  Low bytes
        agree by chance once in 256, which only adds candidates; whether a pair was met in an earlier bucket is
        decided by the buckets' full keys.
        """
        left, right = ([r for r in self.rows if r[2] == side] for side in (self.i, self.j))
        if not left or not right:
            return
        ids, parts = np.array([r[0] for r in right]), np.array([r[1] for r in right])
        low = np.stack([np.frombuffer(r[3], np.uint8) for r in right])
        having: dict[int, list[int]] = {}
        for k, r in enumerate(right):
            for key in r[4]:
                having.setdefault(key, []).append(k)
        for row in left:
            near = np.flatnonzero((parts != row[1]) & (ids < row[0]) if self.i == self.j else parts != row[1])
            if not len(near):
                continue
            share = (low[near] == np.frombuffer(row[3], np.uint8)).mean(1)
            likely = share >= self.least
            near, share = near[likely], share[likely]
            if not len(near):
                continue
            met = np.zeros(len(right), bool)
            for key in row[4]:
                met[having.get(key, [])] = True
            first = ~met[near]
            if first.any():
                yield row, [right[k] for k in near[first][np.argsort(-share[first], kind="stable")]]

    def with_candidates(self) -> list[tuple]:
        """The rows that are in a candidate pair; never more than the block has."""
        found: dict[int, tuple] = {}
        for row, others in self.candidates():
            found[row[0]] = row
            found.update((r[0], r) for r in others)
        return list(found.values())

    def links(self, words: int, percent: int) -> list[tuple[int, int]]:
        """A link for any two components of which two members are linked by their full sets."""
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        def set_of(row: tuple) -> np.ndarray:
            if row[0] not in sets:
                sets[row[0]] = shingles(_utf8(row[5]), words)
            return sets[row[0]]

        found = []
        for row, others in self.candidates():
            for r in others:
                mine, other = find(row[1]), find(r[1])
                if mine != other and linked(set_of(row), set_of(r), percent):
                    root[max(mine, other)] = min(mine, other)
                    found.append((max(row[0], r[0]), min(row[0], r[0])))
        return found


_ROW = ("id", "component", "own", "low", "earlier")


def _blocks(batches: Iterator[pa.RecordBatch], least: float, columns: tuple[str, ...]) -> Iterator[tuple[int, _Block]]:
    """The blocks of sorted rows, each with its bucket's key."""
    at, block = None, None
    for batch in batches:
        for key, i, j, *row in zip(*(batch.column(c) for c in ("key", "i", "j", *columns))):
            here = (key.as_py(), i.as_py(), j.as_py())
            if here != at:
                if block:
                    yield at[0], block
                at, block = here, _Block(here[1], here[2], least)
            block.rows.append(tuple(v.as_py() for v in row))
    if block:
        yield at[0], block


def _across(classes: DataFrame, shared: DataFrame, components: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different components whose members share a bucket.

    Signatures meet first, block by block; only the rows that are in some candidate pair fetch their texts.
    """
    least = _least_agreement(percent)
    named = shared.join(components, shared["id"] == components["a"], "left").select("key", "band", "id", F.coalesce(components["b"], "id").alias("component"))
    several = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    open_ = staged(several.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "several")
    members = named.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    # Two classes of different components that share a bucket have it among their open ones.
    before = Window.partitionBy("id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        members.withColumn("earlier", F.collect_list("key").over(before)).join(classes.select("id", "low"), "id")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *_ROW)
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block in _blocks(batches, least, _ROW):
            found = block.with_candidates()
            if found:
                yield pa.RecordBatch.from_pylist([{"key": key, "i": block.i, "j": block.j, **dict(zip(_ROW, r))} for r in found], schema)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, least, (*_ROW, "text")):
            found = block.links(words, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    schema = pa.schema([("key", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("id", pa.int64()), ("component", pa.int64()), ("own", pa.int64()), ("low", pa.binary()), ("earlier", pa.list_(pa.int64()))])
    met = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    likely = staged(met.mapInArrow(compared, "key long, i long, j long, id long, component long, own long, low binary, earlier array<long>"), "likely")
    return _with_texts(likely, docs).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(verified, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each document: doc_id, n_shingles, component_id and kept."""
    sketches = staged(sketch(docs, words), "sketches")
    classes = staged(
        sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")).mapInArrow(_low_bytes, "set_key binary, id long, sig binary, low binary"), "classes"
    )
    banded = staged(_bands(classes), "bands")
    buckets = staged(banded.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "b"), "buckets")
    shared = staged(banded.join(buckets, "key"), "shared")
    discard(banded, buckets)
    stars = shared.select(F.col("id").alias("a"), "b").filter("a <> b").distinct()
    agreeing = staged(_agreeing(stars, classes, percent), "stars")
    links = staged(_confirmed(agreeing, docs, words, percent), "links")
    discard(agreeing)
    components = connected_components(links)
    more = staged(_across(classes, shared, components, docs, words, percent), "more")
    discard(shared)
    if not more.isEmpty():
        first, components = components, connected_components(components.unionByName(more))
        discard(first, links)
    roots = classes.join(components.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("set_key", F.coalesce("root", "id").alias("root"))
    # Empty documents have no key to join by; together they would meet in one task.
    keyed = sketches.filter("set_key is not null").join(roots, "set_key", "left").select("doc_id", "n_shingles", "root")
    found = keyed.unionByName(sketches.filter("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("root")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with the columns of docs; rows of null ids stay."""
    gone = near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
