"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per partition.

Texts are cut by the tokenizer's pattern.  A piece that is a token itself has that id.  Any other is cut further
wherever no token of the vocabulary can lie across: no token is, or has inside, any of the bytes' n-grams around
the place.  No merge ever crosses such a place, so the parts are contracted on their own, each distinct part once in
a task.  In the task's DuckDB a part is rows of (part, position, token), at first one for each byte.  Each step of a
recursive query joins neighbouring tokens with the merge table, finds the part's pair of the least rank, and
contracts it at its leftmost place; a part without such a pair is done.  Decoding joins tokens with the
vocabulary and aggregates their bytes in order of position.

Parts of more than ``LONG`` bytes, such as runs of one sign, go through a second query that contracts all places of the
least pair in one step, those of overlapping pairs from the left.  It does so only for pairs whose product
takes part in no pair of a lower rank; for the others it contracts the leftmost alone.  Either way the order of
tiktoken's merges is kept.  The second query takes about 250 bytes of memory for each byte of a part and may
spill to a folder of the task.

Answers are remembered within a task, up to ``MEMO`` of them, then the memory starts anew.

Defined cases: null counts as the empty text, which has no tokens; strings of special tokens are
ordinary text; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back
from .token_files import read_ranks

LONG, GRAM, MEMO, AT_ONCE = 48, 5, 400_000, 250_000  # AT_ONCE: bytes of parts in one query

# place is 64 times the part's number plus the position, and k 64 times the pair's rank plus the position.
_SHORT_QUERY = """
with recursive step(w, place, tok, k, done) as (
  select w, place, tok, m.rank * 64 + (place & 63), false
  from (select w, place, tok, case when lead(w) over o = w then lead(tok) over o end as follower from pieces window o as (order by place))
  left join merges m on m.pair = tok::bigint * 1048576 + follower
  union all
  (with least as (select w, min(k) as best from step where not done group by w),
    marked as (select s.w, place, best, coalesce(k = best, false) as hit, case when k = best then k // 64 else tok end as tok from step s join least on s.w = least.w),
    joined as (select w, place, best, tok, lag(hit) over o as gone, lead(tok, case when hit then 2 else 1 end) over o as follower, lead(w, case when hit then 2 else 1 end) over o as other from marked window o as (order by place))
  select j.w, j.place, j.tok, m.rank * 64 + (j.place & 63), best is null
  from joined j left join merges m on m.pair = j.tok::bigint * 1048576 + case when other = j.w then j.follower end where not coalesce(gone, false))
)
select w, tok from step where done order by place
"""

_LONG_QUERY = """
with recursive step(w, pos, tok, done) using key (w, pos) as (
  select w, place, tok, 0 from pieces
  union
  (with pairs as (select w, pos, tok, lead(tok) over o as follower, lead(pos) over o as next_pos, row_number() over o as n from recurring.step where done = 0 window o as (partition by w order by pos)),
    ranked as (select p.*, m.rank, m.safe from pairs p left join merges m on m.pair = p.tok::bigint * 1048576 + p.follower),
    least as (select w, min(rank) as rank from ranked group by w having min(rank) is not null),
    hits as (select r.w, r.pos, r.next_pos, r.n, r.rank, r.safe, r.n - row_number() over (partition by r.w order by r.n) as run from ranked r join least using (w, rank)),
    chosen as (select *, (row_number() over (partition by w, run order by n)) % 2 = 1 as odd, row_number() over (partition by w order by n) = 1 as first from hits),
    taken as (select * from chosen where case when safe then odd else first end)
  select w, pos, rank, 0 from taken union all select w, next_pos, -1, 1 from taken)
)
select w, tok from step where done = 0 order by w, pos
"""

_DECODE_QUERY = """
select w, string_agg(hex, '' order by pos) as hex from (select w, pos, hex from tokens join vocabulary using (tok)) group by w
"""


class Merger:
    """A task's DuckDB with the merge table and the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], memory: int = 200):
        import duckdb

        self.ranks, self.memory = ranks, memory
        first, second, rank = [], [], []
        for token, number in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    first.append(a), second.append(b), rank.append(number)
        a, b, r = (np.array(x, np.int64) for x in (first, second, rank))
        least = np.full(max(ranks.values(), default=0) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, a, r)
        np.minimum.at(least, b, r)
        # Tokens of two to four bytes, and what longer ones have inside: each token across a place has one of these.
        self.grams = []
        for n in range(2, GRAM + 1):
            inside = [t[i : i + n] for t in ranks for i in range(len(t) - n + 1) if len(t) == n or n == GRAM]
            table = np.zeros(1 << 22, bool)
            if inside:
                table[self.hashed(np.frombuffer(b"".join(inside), np.uint8), n)[::n]] = True
            self.grams.append((n, table))
        self.spilled = tempfile.TemporaryDirectory(prefix="veridra-bpe-")  # gone with the task
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory}MB", "temp_directory": self.spilled.name})
        self.load("merge_rows", pair=a * 1048576 + b, rank=r.astype(np.int32), safe=least[r] > r)
        self.db.execute("create table merges as select * from merge_rows")
        self.db.register("vocabulary_rows", pa.table({"tok": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.db.execute("create table vocabulary as select * from vocabulary_rows")
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def load(self, name: str, **columns) -> None:
        self.db.register(name, pa.table(columns))

    @staticmethod
    def hashed(data: np.ndarray, n: int) -> np.ndarray:
        """A hash of 22 bits of each n-gram; n-grams that agree by chance only prevent a cut."""
        code = np.zeros(max(0, len(data) - n + 1), np.uint64)
        for i in range(n):
            code = code << np.uint64(8) | data[i : len(data) - n + 1 + i]
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def parts(self, pieces: list[bytes]) -> list[list[bytes]]:
        """Each piece cut at the places that no token of the vocabulary can lie across."""
        raw = b"".join(pieces)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces])
        crossed = np.zeros(len(data) + 1, bool)
        for n, table in self.grams:
            if len(data) >= n:
                at = np.flatnonzero(table[self.hashed(data, n)] & (owner[: len(data) - n + 1] == owner[n - 1 :]))
                for i in range(1, n):
                    crossed[at + i] = True
        places = np.flatnonzero(~crossed).tolist()  # the ends of pieces among them
        cut = [raw[i:j] for i, j in zip(places, places[1:])]
        number = np.searchsorted(places, ends).tolist()
        return [cut[i:j] for i, j in zip([0, *number], number)]

    def contracted(self, parts: list[bytes]) -> list[list[int]]:
        """The tokens of each part."""
        found: list = [[] for _ in parts]
        for query, rows in ((_SHORT_QUERY, [i for i, p in enumerate(parts) if len(p) <= LONG]), (_LONG_QUERY, [i for i, p in enumerate(parts) if len(p) > LONG])):
            runs = np.cumsum([len(parts[i]) for i in rows]) // AT_ONCE if rows else np.empty(0)
            for some in np.split(np.array(rows, np.int64), np.flatnonzero(np.diff(runs)) + 1):
                if not len(some):
                    continue
                sizes = np.array([len(parts[i]) for i in some])
                ends = np.cumsum(sizes)
                need = 0 if query is _SHORT_QUERY else int(ends[-1]) * 250 >> 20
                self.db.execute(f"set memory_limit = '{max(self.memory, need)}MB'")
                w, pos = np.repeat(np.arange(len(some), dtype=np.int32), sizes), np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
                place = (w * 64 + pos).astype(np.int32) if query is _SHORT_QUERY else pos
                self.load("pieces", w=w, place=place, tok=self.bytes[np.frombuffer(b"".join(parts[i] for i in some), np.uint8)])
                answer = self.db.execute(query).fetchnumpy()
                tokens, starts = answer["tok"].tolist(), np.searchsorted(answer["w"], np.arange(len(some) + 1)).tolist()
                for i, begin, end in zip(some.tolist(), starts, starts[1:]):
                    found[i] = tokens[begin:end]
        return found

    def decode(self, tokens: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of tokens."""
        found = [b""] * len(tokens)
        sizes = np.array([len(x) for x in tokens], np.int64)
        if sizes.sum():
            ends = np.cumsum(sizes)
            flat = np.fromiter((t for x in tokens for t in x), np.int32, int(ends[-1]))
            self.load("tokens", w=np.repeat(np.arange(len(tokens)), sizes), pos=np.arange(ends[-1]) - np.repeat(ends - sizes, sizes), tok=flat)
            for w, hex_ in self.db.execute(_DECODE_QUERY).fetchall():
                found[w] = bytes.fromhex(hex_)
        return found


class Codec:
    """Encodes and decodes batches of texts; remembers the ids, as text, and their decoded bytes of each distinct piece and part."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.cut, self.merger = regex.compile(pattern).findall, Merger(ranks)
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.parts: dict[bytes, tuple[str, bytes]] = {}

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of which are remembered from here on."""
        cut = [self.cut(t) for t in texts]
        new = set().union(*cut)
        new.difference_update(self.ids)
        if len(self.ids) + len(new) > MEMO:
            self.ids, self.decoded, self.parts, new = {}, {}, {}, set().union(*cut)
        tokens, fresh = [], []
        for piece in new:
            raw = piece.encode("utf-8", "surrogatepass")
            (tokens if raw in self.merger.ranks else fresh).append((piece, raw))
        whole = [[self.merger.ranks[raw]] for _, raw in tokens]
        self.ids.update(zip((p for p, _ in tokens), (str(x) for x, in whole)))
        self.decoded.update(zip((p for p, _ in tokens), self.merger.decode(whole)))
        parts = self.merger.parts([raw for _, raw in fresh])
        unknown = list(set().union(*parts) - self.parts.keys())
        ids = self.merger.contracted(unknown)
        self.parts.update(zip(unknown, zip((" ".join(map(str, x)) for x in ids), self.merger.decode(ids))))
        for (piece, _), its in zip(fresh, parts):
            if len(its) == 1:
                self.ids[piece], self.decoded[piece] = self.parts[its[0]]
            else:
                known = [self.parts[x] for x in its]
                self.ids[piece], self.decoded[piece] = " ".join([x for x, _ in known]), b"".join([x for _, x in known])
        return cut

    def encoded(self, pieces: list[str]) -> str:
        """The ids of a text's pieces, joined by one space."""
        return " ".join(map(self.ids.__getitem__, pieces))

    def bytes_of(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.decoded.__getitem__, pieces))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Of each document: doc_id, ids (array of int) and decoded (the bytes that the ids stand for)."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(vocabulary), pattern))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(*shared.value)
            cut = codec.pieces([t.as_py() or "" for t in batch.column("text")])
            ids = [[int(i) for i in codec.encoded(x).split()] for x in cut]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(codec.bytes_of, cut), pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Of each document: doc_id, n_tokens, ids_sha256 and decoded_sha256, without sending ids out of the task."""
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(vocabulary), pattern))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(*shared.value)
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                rows = []
                for pieces in codec.pieces([t.as_py() or "" for t in part.column("text")]):
                    ids = codec.encoded(pieces)
                    rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(codec.bytes_of(pieces)).hexdigest()))
                n, ids, decoded = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec = None
        give_back()

    return docs.select("doc_id", "text").mapInArrow(digested, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
