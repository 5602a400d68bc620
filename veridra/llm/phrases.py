"""Collocations by growing phrases of neighbouring words to the right, prefix by prefix.

Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words; both by language.  A task packs the words of
its texts into blocks: the distinct words with their counts, and the text as their numbers, 0 between pieces.
Summed counts tell the frequent words of each language.  A word that is not frequent stands in no frequent phrase,
so it ends a piece as a mark does.

From each block the occurrences of every frequent word are projected: a pointer's next three words, equal ones
counted once.  All that a word (the prefix) projects, from all blocks, meets in one task, which sorts the pointers by
their next word, keeps the words that follow often enough, and goes depth-first into each of these: the pointers of
the longer prefix are a slice of the sorted ones.  A prefix with more than ``PER_TASK`` occurrences is dealt to
several tasks by its next word, so that each still sees all of any longer phrase.  If a pair of words is that frequent too
(both of its words must be; such pairs are counted first), it is split by a hash of what follows: the tasks count all that they
see of it, and the sums of their counts are tested.  So no task gets more pointers than ``PER_TASK`` by expectation,
whatever the text repeats.

Phrases take the counts of their parts from joins with the phrases that are one word shorter, first without their
last and then without their first word; both carry the counts of their own parts along.  The same neighbours tell
what a longer phrase covers: of all longer phrases around one, the most frequent is one word longer.

Defined cases: null and empty texts have no words, a null language is ``und``; rows that repeat count each time; an
empty table gives no phrases; other columns do not matter.  Ranks are by score, then count (both descending), then the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged

#: A mark, or several in a row, between pieces; as marks are in no word, one of them stands for the cut.
MARKS, CUT = r"[.,;:!?\x0A-\x0D]+", "."
LONGEST = 4
BLOCK_WORDS, PER_TASK = 1 << 20, 500_000
#: A projected pointer: the next three words (0: none) and how often they follow.
POINTER = np.dtype([("w1", "<u4"), ("w2", "<u4"), ("w3", "<u4"), ("times", "<u4")])


# Blocks


def words_of(texts: pa.Array) -> pa.Array:
    """The words of all texts, with CUT between pieces and after each text."""
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    marked = pc.replace_substring_regex(low, pattern=MARKS, replacement=f" {CUT} ")
    flat = pc.ascii_split_whitespace(pc.binary_join_element_wise(marked, pa.scalar(CUT, pa.large_string()), pa.scalar(" ", pa.large_string()))).flatten()
    return flat.filter(pc.not_equal(flat, ""))


def blocks_of(words: pa.Array) -> Iterator[pa.Array]:
    """Words in blocks of about BLOCK_WORDS; a piece is never cut."""
    while len(words) > BLOCK_WORDS:
        cuts = np.flatnonzero(pc.equal(words, CUT).to_numpy(zero_copy_only=False))
        end = cuts[max(0, np.searchsorted(cuts, BLOCK_WORDS) - 1)] + 1
        yield words[:end]
        words = words[end:]
    if len(words):
        yield words


def packed(words: pa.Array) -> tuple[list[str], np.ndarray, bytes]:
    """The distinct words, their counts, and the text as their numbers from 1, 0 for a cut."""
    import zstandard

    coded = words.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy()
    is_word = pc.not_equal(names, CUT).to_numpy(zero_copy_only=False)
    number = np.where(is_word, np.cumsum(is_word), 0).astype("<u4")
    counts = np.bincount(codes, minlength=len(names))[is_word]
    return names.filter(pa.array(is_word)).to_pylist(), counts, zstandard.ZstdCompressor(level=1).compress(number[codes].tobytes())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[pa.Array]] = {}
    block = TaskContext.get().partitionId() << 32

    def flushed(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal block
        for part in blocks_of(pa.concat_arrays(held.pop(lang))):
            names, counts, text = packed(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([names], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([text], pa.binary())],
                ["block", "lang", "words", "counts", "text"],
            )
            block += 1

    size = lambda lang: sum(map(len, held[lang]))
    for batch in batches:
        langs = pc.fill_null(batch.column("lang"), "und")
        for lang in langs.unique().to_pylist():
            held.setdefault(lang, []).append(words_of(batch.column("text").filter(pc.equal(langs, lang))))
            if size(lang) >= BLOCK_WORDS:
                yield from flushed(lang)
        while sum(map(size, held)) >= 2 * BLOCK_WORDS:  # many languages
            yield from flushed(max(held, key=size))
    for lang in list(held):
        yield from flushed(lang)


# Projection


def follow(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text in numbers of frequent words (0 cuts): each pair of neighbours as one number, and the two words after it."""
    padded = np.concatenate([text, np.zeros(LONGEST - 1, np.int64)])
    w0, w1, w2, w3 = (padded[k : k + len(text)] for k in range(LONGEST))
    at = np.flatnonzero((w0 > 0) & (w1 > 0))
    third = w2[at]
    return w0[at] << 32 | w1[at], third << 32 | np.where(third > 0, w3[at], 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """31 bits of each number that look random."""
    x = (x.astype(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def project(text: np.ndarray, parts: np.ndarray, hot: np.ndarray, hot_parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes, their slices, whether these see a pair in part only, where their pointers begin, and the pointers.

    parts: of each place of the text, over how many tasks its word is dealt; hot: pairs that are split (sorted, as
    numbers), hot_parts: over how many tasks.  Slices of a split pair are numbered from 1 below 0.
    """
    first, second = follow(text)
    over = parts[np.flatnonzero((text[:-1] > 0) & (text[1:] > 0))] if len(text) else np.zeros(0, np.int64)
    which = np.where(over > 1, _mixed(first & 0xFFFFFFFF) % np.maximum(over, 1), 0)
    if len(hot) and len(first):
        at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
        split = np.flatnonzero(hot[at] == first)
        which[split] = -1 - (_mixed(first[split]) + _mixed(second[split])) % hot_parts[at[split]]
    order = np.lexsort((second, first, which))
    first, second, which = first[order], second[order], which[order]
    new = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (which[1:] != which[:-1])]) if len(first) else np.zeros(0, np.int64)
    pointers = np.empty(len(new), POINTER)
    first, second, which = first[new], second[new], which[new]
    pointers["w1"], pointers["w2"], pointers["w3"] = first & 0xFFFFFFFF, second >> 32, second & 0xFFFFFFFF
    pointers["times"] = np.diff(np.r_[new, len(order)])
    # A slice of a split pair holds that pair only; other slices hold a prefix.
    of = np.where(which < 0, first, first >> 32)
    starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (which[1:] != which[:-1])]) if len(of) else np.zeros(0, np.int64)
    return of[starts], which[starts], which[starts] < 0, starts, pointers


def _numbers(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's text in numbers of frequent words, and over how many tasks each place's word is dealt."""
    import zstandard

    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("text")[n].as_py()), "<u4")
    place, number, uses = (batch.column("known")[n].values.field(k).to_numpy() for k in range(3))
    numbers, parts = (np.zeros(batch.column("size")[n].as_py() + 1, np.int64) for _ in range(2))
    numbers[place + 1], parts[place + 1] = number, 1 + uses // PER_TASK
    return numbers[text], parts[text]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the pairs of words that are both dealt to several tasks, and how often they stand together."""
    for batch in batches:
        for n in range(batch.num_rows):
            numbers, parts = _numbers(batch, n)
            both = np.flatnonzero((parts[:-1] > 1) & (parts[1:] > 1))
            pairs, times = np.unique(numbers[both] << 32 | numbers[both + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), batch.column("block")[n].as_py()), pa.int64()), pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], ["block", "pair", "times"])


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            split = batch.column("split")[n].values
            hot, uses = (split.field(k).to_numpy() for k in (0, 1)) if split is not None else (np.zeros(0, np.int64),) * 2
            order = np.argsort(hot)
            prefix, which, partly, starts, pointers = project(*_numbers(batch, n), hot[order], 1 + uses[order] // PER_TASK)
            if len(prefix):
                cut = pa.Array.from_buffers(pa.binary(), len(prefix), [None, pa.py_buffer((np.r_[starts, len(pointers)] * POINTER.itemsize).astype(np.int32)), pa.py_buffer(pointers)])
                yield pa.RecordBatch.from_arrays([pa.array(prefix, pa.int64()), pa.array(which, pa.int32()), pa.array(partly, pa.bool_()), cut], ["prefix", "slice", "split", "pointers"])


# Growth


def _runs(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin, where they end, and how often they occur."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.r_[starts[1:], len(keys)], np.add.reduceat(times, starts)


def grow(prefix: tuple[int, ...], pointers: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Frequent phrases that begin with the prefix, depth first; the pointers are all of it."""
    field = f"w{len(prefix)}"
    pointers = pointers[pointers[field] > 0]
    if pointers["times"].sum() < least:
        return
    pointers = pointers[np.argsort(pointers[field], kind="stable")]
    starts, ends, times = _runs(pointers[field], pointers["times"].astype(np.int64))
    for n in np.flatnonzero(times >= least).tolist():
        longer = (*prefix, int(pointers[field][starts[n]]))
        yield longer, int(times[n])
        if len(longer) < LONGEST:
            yield from grow(longer, pointers[starts[n] : ends[n]], least)


def partial(prefix: int, pointers: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a part of a pair's pointers: phrases (rows of four words) and counts, which other parts may add to unless they are full-length."""
    pointers = pointers[np.lexsort((pointers["w3"], pointers["w2"], pointers["w1"]))]
    words = np.stack([np.full(len(pointers), prefix, np.int64), *(pointers[f"w{k}"].astype(np.int64) for k in (1, 2, 3))], 1)
    times = pointers["times"].astype(np.int64)
    for length in range(2, LONGEST + 1):
        full = words[:, length - 1] > 0
        some, n = words[full], times[full]
        if not len(some):
            return
        new = np.flatnonzero(np.r_[True, (some[1:, :length] != some[:-1, :length]).any(1)])
        counts, found = np.add.reduceat(n, new), some[new]
        found[:, length:] = 0
        yield (found[counts >= least], counts[counts >= least]) if length == LONGEST else (found, counts)


def _grow(least: int):
    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(words: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(words[:, k], pa.int64()) for k in range(LONGEST)), pa.array(times, pa.int64())], ["w0", "w1", "w2", "w3", "f"])

        rows: list[tuple] = []

        def finished(key, parts) -> Iterator[pa.RecordBatch]:
            pointers = np.frombuffer(b"".join(parts), POINTER)
            if key[2]:
                yield from (batch_of(words, times) for words, times in partial(key[0] >> 32, pointers, least) if len(times))
            else:
                rows.extend((*phrase, *[0] * (LONGEST - len(phrase)), times) for phrase, times in grow((key[0],), pointers, least))
            if len(rows) > 10_000:
                yield _emptied()

        def _emptied() -> pa.RecordBatch:
            table = np.array(rows, np.int64).reshape(-1, LONGEST + 1)
            rows.clear()
            return batch_of(table[:, :LONGEST], table[:, LONGEST])

        key, parts = None, []
        for batch in batches:
            for *now, cut in zip(*(batch.column(c).to_pylist() for c in ("prefix", "slice", "split")), batch.column("pointers")):
                if now != key and key is not None:
                    yield from finished(key, parts)
                    parts = []
                key = now
                parts.append(cut.as_py())
        if key is not None:
            yield from finished(key, parts)
        yield _emptied()

    return grown


# Phrases


def blocks(docs: DataFrame) -> DataFrame:
    return staged(docs.select("lang", "text").mapInArrow(_pack, "block long, lang string, words array<string>, counts array<long>, text binary"), "phrase-blocks")


def frequent_words(packed_: DataFrame, least: int) -> DataFrame:
    """lang, word, f and number (from 1, over all languages) of the words that occur often enough."""
    each = packed_.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")).filter(F.col("f") >= least)
    listed = staged(each.withColumn("at", F.monotonically_increasing_id()), "phrase-listed").withColumn("part", F.shiftright("at", 33))
    # One row a partition: how many words stand before it.
    sizes = listed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return listed.join(before, "part").select("lang", "word", "f", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("number"))


def phrase_counts(packed_: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """w0 to w3 (numbers of words, 0: none) and f of all frequent phrases of two to four words."""
    uses = packed_.select("block", "lang", F.posexplode("words").alias("place", "word")).join(words, ["lang", "word"])
    known = uses.groupBy("block").agg(F.collect_list(F.struct("place", "number", "f")).alias("known"))
    rows = staged(packed_.select("block", F.size("words").alias("size"), "text").join(known, "block"), "phrase-texts")
    pairs = staged(rows.mapInArrow(_pairs, "block long, pair long, times long"), "phrase-pairs")
    hot = pairs.groupBy("pair").agg(F.sum("times").alias("f")).filter(F.col("f") > PER_TASK)
    split = pairs.join(hot, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "f")).alias("split"))
    projected = rows.join(split, "block", "left").select("size", "text", "known", "split").mapInArrow(_project, "prefix long, slice int, split boolean, pointers binary")
    keys = ["prefix", "slice", "split"]
    found = projected.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_grow(least), "w0 long, w1 long, w2 long, w3 long, f long")
    counted = staged(found.groupBy("w0", "w1", "w2", "w3").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrase-counts")
    discard(rows, pairs)
    return counted


def with_parts(counts: DataFrame, words: DataFrame) -> list[DataFrame]:
    """Of the phrases of two, three and four words: lang, ids, phrase, last word, f, the counts of their first k words and of what follows these (k from 1)."""
    none = F.array().cast("array<long>")
    shorter = words.select(F.array("number").alias("ids"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("firsts"), none.alias("rests"))
    found = []
    for length in range(2, LONGEST + 1):
        # Phrases of this length: the last of their words is there and the next is not.
        exact = F.col(f"w{length - 1}") > 0
        if length < LONGEST:
            exact &= F.col(f"w{length}") == 0
        ids = F.array(*[F.col(f"w{k}") for k in range(length)])
        own = counts.filter(exact).select(ids.alias("ids"), "f")
        left = shorter.select(F.col("ids").alias("head"), "lang", "phrase", F.array_append("firsts", F.col("f")).alias("firsts"))
        right = shorter.select(F.col("ids").alias("tail"), "last", F.array_prepend("rests", F.col("f")).alias("rests"))
        joined = own.join(left, F.slice("ids", 1, length - 1) == F.col("head")).join(right, F.slice("ids", 2, length - 1) == F.col("tail"))
        shorter = staged(joined.select("ids", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f", "firsts", "rests"), f"phrases-of-{length}")
        found.append(shorter)
    return found


def best_cut(a: Column, firsts: Column, rests: Column) -> Column:
    """The cut of the lowest score, ties to the first: score, k, l and r; exact beyond 64 bits."""
    whole = lambda c: c.cast("decimal(19,0)")
    cuts = F.zip_with(firsts, rests, lambda first, rest: F.struct(first.alias("l"), rest.alias("r")))
    scored = F.transform(cuts, lambda x, k: F.struct(F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * whole(a), whole(x["l"]) + whole(x["r"])).alias("score"), k.alias("k"), x["l"].alias("l"), x["r"].alias("r")))
    return F.array_min(scored)


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    packed_ = blocks(docs)
    totals = staged(packed_.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    words = staged(frequent_words(packed_, least), "phrase-words")
    counts = phrase_counts(packed_, words, least)
    discard(packed_)
    of_length = with_parts(counts, words)
    kept = []
    for n, phrases in enumerate(of_length):
        rows = phrases.select("ids", "lang", "phrase", F.col("f").alias("a"), "firsts", "rests")
        if n + 1 < len(of_length):
            # What lies around a phrase: the longest-lived neighbour is one word longer.
            around = of_length[n + 1].select(F.explode(F.array(F.slice("ids", 1, n + 2), F.slice("ids", 2, n + 2))).alias("inner"), "f").groupBy("inner").agg(F.max("f").alias("around"))
            rows = rows.join(around, F.col("ids") == F.col("inner"), "left").filter(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))
        kept.append(rows.select("lang", "phrase", "a", best_cut(F.col("a"), F.col("firsts"), F.col("rests")).alias("cut")))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = staged(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top), "phrases-ranked")
    discard(words, counts, *of_length)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
