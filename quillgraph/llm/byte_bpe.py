"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of many texts are encoded together. Their symbols stand in
one linked array; an inverted index holds, for each merge rank, the positions
of the token pairs that this merge joins. Merges are replayed in rank order
over the whole set of pieces, and only the neighbours of a joined pair get a
new index entry. Each text is then the sequence of its pieces' ids.

Defined results: a null text counts as empty and gives no ids. An empty text
gives no ids. Repeated rows and ties give repeated equal results; other columns
are kept as they are, except those named like an output, which are replaced.
Ids that the vocabulary lacks raise an error when decoded.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct pieces whose ids a task remembers; beyond it the memory is emptied and refilled.
REMEMBERED = 150_000
#: Characters of text whose pieces are encoded together.
TOGETHER = 4 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """Vocabulary as arrays: single bytes, and every pair of tokens whose join is a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's join, -1 where it is no token."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.joined[at], -1)

    def one(self, piece: bytes) -> list[int]:
        """Ids of one piece, the lowest rank first and the leftmost of equal ones."""
        ids = [int(x) for x in self.single[np.frombuffer(piece, np.uint8)]]
        while len(ids) > 1:
            found = self.rank_of(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
            usable = np.flatnonzero(found >= 0)
            if not len(usable):
                break
            at = int(usable[np.argmin(found[usable])])
            ids[at : at + 2] = [int(found[at])]
        return ids

    def replay(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; all merges of all pieces in rank order."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is None and piece:
                rest.append(k)
            else:
                out[k] = np.array([] if rank is None else [rank], np.uint32)
        if not rest:
            return out
        lengths = np.array([len(pieces[k]) for k in rest])
        starts = np.concatenate(([0], np.cumsum(lengths)))
        symbols = np.frombuffer(b"".join(pieces[k] for k in rest), np.uint8)
        token = self.single[symbols].copy()
        if (token < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts[1:] - 1] = -1
        before[starts[:-1]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, -1, np.int64)
        left = np.flatnonzero(after >= 0)
        pair[left] = self.rank_of(token[left], token[after[left]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            ranks = pair[positions]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-2))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ranks)], strict=True):
                rank = int(ranks[a])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(positions[a:b])

        if len(usable := left[pair[left] >= 0]):
            enter(usable)
        marked = np.zeros(n + 1, bool)
        odd: set[int] = set()
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[pair[at] == rank]
            if not len(at):
                continue
            marked[at] = True
            if marked[after[at]].any():  # overlapping pairs: the leftmost takes the shared symbol
                kept, taken = [], set()
                for p in at.tolist():
                    if p not in taken:
                        kept.append(p)
                        taken.add(int(after[p]))
                marked[at] = False
                at = np.array(kept)
            else:
                marked[at] = False
            right = after[at]
            beyond = after[right]
            token[at] = rank
            alive[right] = False
            pair[right] = -1
            pair[at] = -1
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            near = before[at]
            near = near[near >= 0]
            touched = np.concatenate((near, at[has]))
            if not len(touched):
                continue
            if len(near):
                touched = np.unique(touched)
            pair[touched] = fresh = self.rank_of(token[touched], token[after[touched]])
            if len(early := touched[(fresh >= 0) & (fresh < rank)]):
                # a join that ranks below its own parts: such pieces are encoded alone, where order within the piece is exact
                odd.update((np.searchsorted(starts, early, side="right") - 1).tolist())
            touched = touched[fresh >= 0]
            if len(touched):
                enter(touched)
        kept = np.flatnonzero(alive)
        ids = token[kept].astype(np.uint32)
        cuts = np.searchsorted(kept, starts)
        for k, piece in enumerate(rest):
            out[piece] = np.array(self.one(pieces[piece]), np.uint32) if k in odd else ids[cuts[k] : cuts[k + 1]]
        return out


_MERGES: dict[int, Merges] = {}


def _merges(shared) -> Merges:
    """The vocabulary's arrays, built once in a worker."""
    if shared.id not in _MERGES:
        _MERGES[shared.id] = Merges(shared.value)
    return _MERGES[shared.id]


class _Shared:
    """A broadcast with an id that stays the same in every worker."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        self.held = spark.sparkContext.broadcast(ranks)
        self.id = hash(frozenset(ranks.items()))

    @property
    def value(self) -> dict[bytes, int]:
        return self.held.value


class Memory:
    """Numbers of distinct pieces and, once filled, their ids."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.new: list[str] = []
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        if len(self.index) > REMEMBERED:
            self.clear()

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """A number for each piece; pieces not met before are noted for fill()."""
        index, new = self.index, self.new
        for p in pieces:
            if p not in index:
                index[p] = len(index)
                new.append(p)
        return np.fromiter(map(index.__getitem__, pieces), np.int32, len(pieces))

    def fill(self) -> None:
        """Encodes the noted pieces together."""
        if self.new:
            found = self.merges.replay([p.encode() for p in self.new])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, *found))
            self.new.clear()

    def ids(self, numbers: np.ndarray) -> bytes:
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.flat[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(ends[-1])].astype("<u4").tobytes()


def _with(schema: T.StructType, drop: set[str], *more: T.StructField) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in drop] + list(more))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """docs with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of the whole text.

    ranks go to the executors by broadcast: a vocabulary is of fixed size and does not follow the data.
    """
    shared = _Shared(docs.sparkSession, ranks)
    docs = docs.drop("n_tokens", "ids")
    schema = _with(docs.schema, set(), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()))
    at = docs.columns.index(text)

    def run(batches):
        import regex

        memory = Memory(_merges(shared))
        split = regex.compile(pattern).findall
        for batch in batches:
            column, encoded = batch.column(at), []
            first = 0
            while first < len(column):
                memory.trim()
                last, chars, pieces = first, 0, []
                while last < len(column) and (last == first or chars < TOGETHER):
                    text_ = column[last].as_py() or ""
                    chars += len(text_)
                    pieces.append(memory.numbers(split(text_)))
                    last += 1
                memory.fill()
                encoded += [memory.ids(many) for many in pieces]
                first = last
            columns = [*batch.columns, pa.array([len(x) // 4 for x in encoded], pa.int64()), pa.array(encoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """encoded with ``decoded``: the bytes that its ids stand for."""
    shared = _Shared(encoded.sparkSession, ranks)
    encoded = encoded.drop("decoded")
    schema = _with(encoded.schema, set(), T.StructField("decoded", T.BinaryType()))
    at = encoded.columns.index(ids)

    def run(batches):
        tokens = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x, "<u4").tolist())) if x else b"" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded by the 50k byte-level vocabulary and decoded again."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode(encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
