"""Suffix-array dedup: repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of MIN bytes that covers it also starts in a document
with a smaller doc_id. Whole texts are compared, all of them with each other.

1. Each text is cut into blocks of documents. Every MIN-byte window has an
   anchor, the minimal hash of its SEED-byte strings; equal windows have equal
   anchors. Blocks send their distinct anchors to buckets.
2. A bucket tells each block which of its anchors other documents have too,
   and their leader: one of the blocks that have it, chosen by the set of
   these, so that neighbouring anchors of copies have the same one; anchors of
   more than FEW blocks are led by a number drawn from their own hash.
3. Blocks cut out the runs of windows whose anchors have one leader, and send
   each distinct run, with its smallest doc_id, to the group of that leader.
   Equal windows meet in one group; copies within a block are sent once, so a
   string that a third of all documents have costs a group one run a block.
4. A group builds the transform of its runs and extends intervals backwards,
   breadth first: level by level this derives the common prefixes of adjacent
   suffixes by increasing value, and it stops at MIN. Suffixes between two
   derived borders start with the same MIN bytes; the smallest doc_id of each
   such interval goes back to the blocks that sent the runs.
5. Blocks mark the windows that a smaller doc_id has and cut them out.

Defined results: a null text counts as empty. Texts under MIN bytes are kept
whole. Rows of one doc_id are one document: they do not remove each other's
bytes. A null doc_id counts as larger than any other and equal to itself; such
rows are dealt to blocks by their texts. Equal texts (ties) are kept with the
smallest doc_id. A very long text is read whole, in a block of its own size.
Other columns are kept; those named like an output are replaced. An empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import buffers, in_blocks, mix, partitions, text_bytes

MIN, SEED = 50, 24
BLOCK = 4 << 20
#: Blocks up to which an anchor is led by a block.
FEW = 8
#: Bytes of text whose windows are hashed together.
STEP = 1 << 20
_SPAN = MIN - SEED + 1
_NO_ID = (1 << 63) - 1
_VALUE = (1 << 40) - 1


def anchors(raw: np.ndarray) -> np.ndarray:
    """The anchor of the window at each position; len(raw) - MIN + 1 values."""
    n = len(raw) - MIN + 1
    out = np.zeros(max(n, 0), np.uint64)
    for a in range(0, n, STEP):
        b = min(a + STEP, n)
        x = raw[a : b + MIN - 1].astype(np.uint64)
        for step in (1, 2, 4):
            x = x[:-step] | x[step:] << np.uint64(8 * step)
        count = b - a + _SPAN - 1
        h = mix(x[:count] * np.uint64(0x9E3779B97F4A7C15) + x[8 : count + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + x[16 : count + 16] * np.uint64(0x165667B19E3779F9))
        width = 1
        while width * 2 <= _SPAN:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        rest = _SPAN - width
        out[a:b] = np.minimum(h[: b - a], h[rest : rest + b - a])
    return out


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, whether the window lies within a document) for each position."""
    values = anchors(raw)
    inside = np.ones(len(raw), bool)
    for end in offsets[1:].tolist():
        inside[max(0, end - MIN + 1) : end] = False
    # short documents before others: the last MIN - 1 starts of each document are void
    return values, inside[: len(values)]


def _block(table: pa.Table, text: int):
    raw, offsets = buffers(table.column(text))
    ids = table.column("doc_id")
    ids = ids.combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    return raw, offsets, ids


def _ask(n_buckets: int):
    """1. A block's distinct anchors, packed by bucket; the low bit says whether two documents of the block have it."""
    names = ["bucket", "block", "values"]

    def run(table: pa.Table) -> pa.Table:
        raw, offsets, ids = _block(table, table.column_names.index("text"))
        values, inside = windows(raw, offsets)
        at = np.flatnonzero(inside)
        v = values[at]
        owner = np.searchsorted(offsets, at, side="right") - 1
        keep = np.ones(len(v), bool)
        keep[1:] = (v[1:] != v[:-1]) | (owner[1:] != owner[:-1])
        v, d = v[keep], ids[owner[keep]]
        order = np.argsort(v)
        v, d = v[order], d[order]
        heads = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
        out = []
        if len(heads):
            many = np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)
            v = v[heads]
            bucket = ((v >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            packed = ((v[order] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(25)) << np.uint64(1) | many[order]).view(np.uint8).reshape(-1, 8)[:, :5]
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            block = table.column("block")[0].as_py()
            out = [(k, block, packed[cuts[k] : cuts[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist()]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, (pa.int32(), pa.int32(), pa.binary()), strict=True))})

    return run


def _name(v: np.ndarray, n_buckets: int) -> np.ndarray:
    """Anchors as buckets and blocks name them: bucket and 39 bits."""
    return ((v >> np.uint64(20)) % np.uint64(n_buckets)) << np.uint64(40) | (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(25))


def _wide(blob: pa.Scalar) -> np.ndarray:
    wide = np.zeros((len(blob.as_buffer()) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def _answer(n_blocks: int):
    """2. For each block of a bucket: its anchors that more than one document has, and their leaders."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [_wide(b) for b in table.column("values")]
        blocks = table.column("block").to_numpy()
        v = np.concatenate(parts)
        b = np.repeat(blocks, [len(p) for p in parts])
        order = np.lexsort((b, v >> np.uint64(1)))
        v, b = v[order], b[order]
        key = v >> np.uint64(1)
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(v)))
        shared = (sizes > 1) | (np.maximum.reduceat(v & np.uint64(1), heads) > 0)
        keep = np.repeat(shared, sizes)
        chosen = b[heads + np.add.reduceat(b.astype(np.int64), heads) % sizes]
        chosen = np.where(sizes > FEW, n_blocks + (key[heads] % np.uint64(n_blocks)).astype(np.int64), chosen)
        leader = np.repeat(chosen, sizes)[keep]
        key, b = key[keep] | np.uint64(bucket << 40), b[keep]
        order = np.argsort(b, kind="stable")
        key, leader, b = key[order], leader[order], b[order]
        names, cuts = np.unique(b, return_index=True)
        cuts = np.append(cuts, len(b))
        return pa.table(
            {
                "block": pa.array(names.astype(np.int32)),
                "leader": pa.array(np.full(len(names), -1, np.int32)),
                "one": pa.array([key[cuts[i] : cuts[i + 1]].tobytes() for i in range(len(names))], pa.binary()),
                "two": pa.array([leader[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(len(names))], pa.binary()),
            }
        )

    return run


class Runs:
    """The candidate runs of a block, by leader; found alike wherever they are cut out."""

    def __init__(self, table: pa.Table, answers: list[tuple[bytes, bytes]], n_buckets: int):
        self.raw, self.offsets, self.ids = _block(table, table.column_names.index("text"))
        keys = np.frombuffer(b"".join(a for a, _ in answers), np.uint64)
        leaders = np.frombuffer(b"".join(b for _, b in answers), np.int32)
        self.start = self.end = self.leader = np.zeros(0, np.int64)
        self.doc = self.start
        if not len(keys):
            return
        order = np.argsort(keys)
        keys, leaders = keys[order], leaders[order]
        values, inside = windows(self.raw, self.offsets)
        edge = np.ones(len(values), bool)
        edge[1:] = values[1:] != values[:-1]
        heads = np.flatnonzero(edge)
        names = _name(values[heads], n_buckets)
        at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
        found = np.where(keys[at] == names, leaders[at], -1)
        lead = np.repeat(found, np.diff(np.append(heads, len(values))))
        lead = np.where(inside, lead, -1)
        edge[1:] = lead[1:] != lead[:-1]
        inner = self.offsets[1:-1]
        edge[inner[inner < len(edge)]] = True
        heads = np.flatnonzero(edge)
        ends = np.append(heads[1:], len(lead))
        good = lead[heads] >= 0
        self.start, self.end, self.leader = heads[good], ends[good] + MIN - 1, lead[heads[good]].astype(np.int64)
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1

    def by_leader(self) -> dict[int, dict[bytes, list[int]]]:
        """leader -> text of a run -> the runs with that text."""
        out: dict[int, dict[bytes, list[int]]] = {}
        whole = self.raw.tobytes()
        for k, (a, b, lead) in enumerate(zip(self.start.tolist(), self.end.tolist(), self.leader.tolist(), strict=True)):
            out.setdefault(lead, {}).setdefault(whole[a:b], []).append(k)
        return out


def _send(n_buckets: int):
    """3. A block's distinct runs for each leader, in the order of their bytes."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if len(table) and len(answers):
            runs = Runs(table, list(zip(answers.column("one").to_pylist(), answers.column("two").to_pylist(), strict=True)), n_buckets)
            block = table.column("block")[0].as_py()
            for lead, texts in runs.by_leader().items():
                line = sorted(texts)
                least = np.array([min(int(runs.ids[runs.doc[k]]) for k in texts[t]) for t in line], np.int64)
                out.append((lead, block, b"".join(line), np.array([len(t) for t in line], np.int32).tobytes(), least.tobytes()))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(("leader", "block", "text", "lengths", "least"), types, strict=True))})

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text in the order of their first ``depth`` symbols, equal ones by position; beyond the end stands nothing."""
    n = len(text)
    bits = max(1, int(n).bit_length())
    if 3 * bits <= 63 and 24 + bits <= 63:
        known = min(depth, (64 - bits) // 9)
        key = np.zeros(n, np.uint64)
        for i in range(known):
            key <<= np.uint64(9)
            if i < n:
                key[: n - i] |= text[i:].astype(np.uint64) + np.uint64(1)
        shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        index = np.arange(n, dtype=np.uint64)
        line = np.sort(key << shift | index)
        while True:
            order, group = (line & mask).astype(np.int64), line >> shift
            if known >= depth:
                return order
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.append(1, group[1:] != group[:-1]).astype(np.uint64))
            step = min(known, depth - known)
            after = np.zeros(n, np.uint64)
            after[: max(0, n - step)] = rank[step:]
            line = np.sort((rank << shift | after) << shift | index)
            known += step
    rank, known = text.astype(np.int64) + 1, 1
    while True:
        if known >= depth:
            return np.argsort(rank, kind="stable")
        step = min(known, depth - known)
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 300) + after
        order = np.argsort(key, kind="stable")
        line = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(1, line[1:] != line[:-1]))
        known += step


def borders(bwt: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares fewer than ``depth`` symbols with the one before, from the transform alone.

    The interval of the empty string is extended backwards by every symbol in
    it, then the intervals so found, level by level. The right border of an
    interval of length l + 1 that no shorter string has set is where l symbols
    are shared; only such intervals go on. Nothing of ``depth`` or more is set.
    """
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[order] = np.arange(n)
    symbol = bwt[order]
    same = symbol[1:] == symbol[:-1]
    after, before = np.full(n, n), np.full(n, -1)
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(depth):
        size = hi - lo
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(lo - ends + size, size)
        right = np.sort(lf[at[after[at] >= np.repeat(hi, size)]]) + 1
        left = np.sort(lf[at[before[at] < np.repeat(lo, size)]])
        new = ~found[right]
        if not _:
            new |= True  # the intervals of single symbols all go on, the last one too
        lo, hi = left[new], right[new]
        if not len(lo):
            break
        found[hi] = True
    return found[:n]


def repeated(texts: list[bytes], least: list[int]) -> list[np.ndarray]:
    """For each text the smallest of ``least`` among texts with the MIN bytes that start at each position."""
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(lengths) - lengths
    text = np.zeros(int(lengths.sum()), np.int16)
    ends = starts + lengths - 1
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    order = suffix_order(text, MIN)
    bwt = text[order - 1].astype(np.uint16)
    name = np.empty(len(text), np.int64)
    name[order] = np.cumsum(borders(bwt, MIN)) - 1
    valid = np.ones(len(text), bool)
    for e in ends.tolist():
        valid[max(0, e - MIN + 1) : e + 1] = False
    owner = np.repeat(np.array(least, np.int64), lengths)
    at = np.flatnonzero(valid)
    best = np.full(int(name.max()) + 1, _NO_ID, np.int64)
    np.minimum.at(best, name[at], owner[at])
    values = best[name]
    return [values[s : s + n - MIN] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _compare(table: pa.Table) -> pa.Table:
    """4. A leader's runs: where each run's windows start first, as (position, doc_id) of each change."""
    leader = table.column("leader")[0].as_py()
    index: dict[bytes, int] = {}
    least: list[int] = []
    sent = []
    for text, lengths, ids in zip(table.column("text").to_pylist(), table.column("lengths").to_pylist(), table.column("least").to_pylist(), strict=True):
        cuts = np.cumsum(np.frombuffer(lengths, np.int32).astype(np.int64)).tolist()
        own = []
        for a, b, d in zip([0, *cuts[:-1]], cuts, np.frombuffer(ids, np.int64).tolist(), strict=True):
            k = index.setdefault(text[a:b], len(index))
            if k == len(least):
                least.append(d)
            elif d < least[k]:
                least[k] = d
            own.append(k)
        sent.append(own)
    found = []
    for values in repeated(list(index), least):
        change = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        found.append((change.astype(np.int32), values[change]))
    one, two = [], []
    for own in sent:
        counts = np.array([len(found[k][0]) for k in own], np.int32)
        one.append(np.concatenate([[len(own)], counts, *(found[k][0] for k in own)]).astype(np.int32).tobytes())
        two.append(np.concatenate([found[k][1] for k in own]).tobytes())
    return pa.table({"block": table.column("block"), "leader": pa.array(np.full(len(table), leader, np.int32)), "one": pa.array(one, pa.binary()), "two": pa.array(two, pa.binary())})


def _cut(n_buckets: int, names: list[str], texts: bool):
    """5. Removes from each document what a smaller doc_id has."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = list(zip(answers.column("leader").to_pylist(), answers.column("one").to_pylist(), answers.column("two").to_pylist(), strict=True))
        runs = Runs(table, [(a, b) for lead, a, b in rows if lead < 0], n_buckets)
        raw, offsets = runs.raw, runs.offsets
        cover = np.zeros(len(raw) + 1, np.int32)
        groups = runs.by_leader()
        for lead, one, two in rows:
            if lead < 0:
                continue
            one, two = np.frombuffer(one, np.int32), np.frombuffer(two, np.int64)
            counts = one[1 : one[0] + 1]
            ends = np.cumsum(counts)
            at = one[one[0] + 1 :]
            for text, n, e in zip(sorted(groups[lead]), counts.tolist(), ends.tolist(), strict=True):
                first = at[e - n : e]
                last = np.append(first[1:], len(text) - MIN + 1)
                least = two[e - n : e]
                for k in groups[lead][text]:
                    gone = least < runs.ids[runs.doc[k]]
                    if gone.any():
                        np.add.at(cover, runs.start[k] + first[gone], 1)
                        np.add.at(cover, runs.start[k] + last[gone] + MIN - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.append(0, np.cumsum(gone))
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        edge = offsets[1:-1]
        edge = edge[edge < len(gone)]
        rise[edge] = gone[edge]
        spans = np.append(0, np.cumsum(rise))
        removed = total[offsets[1:]] - total[offsets[:-1]]
        kept_bytes, kept_at = raw[~gone].tobytes(), (offsets - total[offsets]).tolist()
        kept = [kept_bytes[a:b] for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]
        if texts:
            kept = [k.decode("utf-8", "ignore") for k in kept]
        out = {n: table.column(n) for n in names}
        out |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array((spans[offsets[1:]] - spans[offsets[:-1]]).astype(np.int64)), "kept": pa.array(kept, pa.string() if texts else pa.binary())}
        return pa.table(out)

    return run


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and ``kept``, the bytes that stay.

    texts: ``kept`` is a string; bytes of a character that was cut are left out.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    total = text_bytes(docs)
    n_blocks = max(1, total // BLOCK)
    n_buckets = max(1, partitions(spark), total // (16 << 20))
    blocks = in_blocks(docs, docs.columns, n_blocks)
    asked = blocks.groupBy("block").applyInArrow(_ask(n_buckets), "bucket int, block int, values binary")
    shape = "block int, leader int, one binary, two binary"
    answers = asked.groupBy("bucket").applyInArrow(_answer(n_blocks), shape)
    sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send(n_buckets), "leader int, block int, text binary, lengths binary, least binary")
    results = sent.groupBy("leader").applyInArrow(_compare, shape)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if texts else T.BinaryType())])
    return blocks.groupBy("block").cogroup(answers.unionByName(results).groupBy("block")).applyInArrow(_cut(n_buckets, names, texts), schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each whole text of ``documents`` without strings of 50 bytes that a smaller doc_id has."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
