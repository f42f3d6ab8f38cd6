r"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document's set holds its distinct 5-word shingles. Two sets r, s with
Jaccard similarity >= 0.8 differ in at most H = floor((|r| + |s|) / 9) shingles.
Shingles are dealt to m segments by hash, m depending on the size band. Give
segment i a tolerance v_i of -1 (skipped), 0 (equal) or 1 (one deletion on
either side): if the v_i + 1 add up to H + 1, similar sets agree within
tolerance in a segment at least. Each set is indexed in its own size band, and
in the next one if that band's sets can be similar to it; the larger set of a
pair probes in its own band. Costs decide the allocation: small bands use few
segments with their one-deletion neighbourhoods, large bands more segments
without, and a quarter more segments than a probe needs. Once the signatures
are counted, each set probes its rarest ones: those that no other set has cost
nothing, so sets that share but a common passage hardly ever meet.

Sets that meet in a signature are candidates. Equal sets form one class first.
Signatures are gathered under their most popular member (the one that meets most
others in all its signatures); a centre most of whose signatures another one has
hands over to it. Groups of GROUP sets or fewer are compared among
themselves. A larger group has a centre Z: the shingles that most of a sample of
it have (any Z is right, a good one is fast). Every member x is compared with
the centre: it differs in D(x) = x \ Z (added) and Z \ x (removed). Similar x, y
without a common difference have |D(x)| + |D(y)| <= (|x| + |y|) / 9. So with
f(x) = 9 |D(x)| - |x| they are linked if f(x) + f(y) <= 0, and the member with
the least f, linked with all that it can be, joins them. Members that are left
meet again in groups of a common difference (group, shingle, added or removed),
which are the next round's groups; those of the same members count once. A
difference is what few members have, so groups shrink fast. Near copies of one
text hardly ever share an edit: K of them cost about K comparisons.

Bounds keep the differences few. At least |added| - |x| / 5 added shingles are
common to similar sets, so the first |x| / 5 + 1 in any order of the group are
enough; those that the sample has least often come first.
Removed ones matter only where no added one is common. Then h = (|x| + |y|) / 9
is at least the added ones of both and the difference of the removed ones'
numbers, and what h leaves says how many removed ones must be common. So the
numbers of added and removed shingles that occur in a group (no more than sizes
allow) tell how many removed ones each member sends: mostly none.

Comparisons run on shingle hashes, and what they find similar is confirmed on
the words. No link that joins components is lost, and copies are not expanded
into all pairs.

A signature that many documents share costs its bucket one entry a slice of
the input: further members go to the next stage by way of other buckets.

Defined results: a null or empty text has no shingles and its own component. A
text of fewer than five words is one shingle. Rows of a null doc_id get their
count and a null component. Rows of one doc_id count as one node. An empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import bound_batches, buffers, discard, doc_slices, lower_words, mix, partitions, span_hashes, text_bytes, written
from quillgraph.llm.components import components
from quillgraph.operators.containment import bloom, passing

#: Words of a shingle; similarity as a ratio of integers.
N, NUM, DEN = 5, 80, 100
#: Ratio of a size band's ends; sizes up to it use one-deletion neighbourhoods.
BAND, SMALL = 1.5, 45
#: Text that is signed together, and text whose signatures make a bucket.
SLICE, BUCKET = 4 << 20, 16 << 20
#: Text whose words are hashed together.
HASHED = 1 << 19
#: Sets of a group that are compared among themselves (and expected size of the sample that makes a larger group's centre).
GROUP = 256
#: Members of a large group that are compared with its centre in one part.
SPREAD = 512

_COEFFICIENTS = [np.uint64(pow(0x9E3779B97F4A7C15, i + 3, 1 << 64) | 1) for i in range(N)]
_VALUE = (1 << 39) - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    if offsets[-1] > HASHED and len(offsets) > 2:
        return [s for a, b in doc_slices(offsets, HASHED) for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
    low, starts, ends, owner = lower_words(raw, offsets)
    words = span_hashes(low, starts, ends)
    first = np.searchsorted(owner, np.arange(len(offsets)))
    if len(words) >= N:
        grams = words[: len(words) - N + 1] * _COEFFICIENTS[0]
        for i in range(1, N):
            grams = grams + words[i : len(words) - N + 1 + i] * _COEFFICIENTS[i]
        grams = mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= N:
            out.append(np.unique(grams[a : b - N + 1]))
        elif b > a:
            whole = words[a:b] * np.array(_COEFFICIENTS[: b - a], np.uint64)
            out.append(mix(np.array([int(whole.sum()) ^ (b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def differ(r: int, s: int) -> int:
    """Most shingles in which similar sets of these sizes differ."""
    return ((DEN - NUM) * (r + s)) // (DEN + NUM)


def _bands() -> list[tuple[int, int]]:
    found, low = [], 1
    while low < 1 << 40:
        high = max(low, int(low * BAND))
        found.append((low, high))
        low = high + 1
    return found


BANDS = _bands()
_LOWS = np.array([low for low, _ in BANDS])


def segments(band: int) -> tuple[int, bool]:
    """(segments of a band, whether it uses one-deletion neighbourhoods)."""
    most = differ(BANDS[band][1], BANDS[band][1])
    if BANDS[band][1] <= SMALL:
        return (most + 2) // 2 + (most > 1), True
    return most + 1 + max(4, most // 4), False


def signatures(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, whether it can be probed) of one set; equal sets have equal ones.

    In bands with deletions those that can be are probed; elsewhere the counts decide later.
    """
    n = len(shingles)
    own = int(np.searchsorted(_LOWS, n, side="right")) - 1
    values, probed = [], []
    place = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(20)
    for band in (own, own + 1):
        if band > own and DEN * n < NUM * BANDS[band][0]:
            continue
        m, deletions = segments(band)
        at = (place % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, at, shingles)
        size = np.bincount(at, minlength=m)
        salt = np.arange(m, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64((band + 1) * 0xDA942042E4DD58B5 % (1 << 64))
        tolerance = np.full(m, -1)
        if band == own:
            need = differ(n, n) + 1
            best = np.argsort(-size, kind="stable")
            if deletions:
                double = min(need // 2, m)
                tolerance[best[:double]] = 1
                if need > 2 * double:
                    tolerance[best[double]] = 0
            else:
                tolerance[:] = 0
        values.append(mix(total + salt))
        probed.append(tolerance >= 0)
        if deletions:
            values.append(mix(total[at] - shingles + salt[at]))
            probed.append(tolerance[at] == 1)
    return np.concatenate(values), np.concatenate(probed)


def set_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2): equal keys for equal sets, null for empty ones."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long"

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            rows = []
            for a, b in doc_slices(offsets, SLICE):
                for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    if len(s):
                        x = s * np.uint64(0x9FB21C651E98DF25)
                        rows.append((len(s), int(s.sum()), int(mix(x ^ (x >> np.uint64(29))).sum())))
                    else:
                        rows.append((0, None, None))
            signed = lambda v: None if v is None else v - (1 << 64) if v >> 63 else v
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([signed(r[1]) for r in rows], pa.int64()), pa.array([signed(r[2]) for r in rows], pa.int64())],
                names=["doc_id", "n_shingles", "k1", "k2"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _sign(n_buckets: int):
    """Texts to blobs: kind 0 holds a slice's signatures of a bucket, kind 1 further members of signatures; members are set keys, so copies are one."""
    names = ["bucket", "kind", "values", "sets"]

    def run(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for turn, (a, b) in enumerate(doc_slices(offsets, SLICE)):
                seen, values, members = set(), [], []
                for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    if not differ(len(s), len(s) + 1) or (key := s.tobytes()) in seen:
                        continue  # sets of under 4 are similar to equal ones only, which are one class
                    seen.add(key)
                    v, p = signatures(s)
                    values.append(((v >> np.uint64(24)) % np.uint64(n_buckets)) << np.uint64(40) | (v & np.uint64(_VALUE)) << np.uint64(1) | p)
                    members.append(np.full(len(v), s.sum(), np.uint64))
                if not values:
                    continue
                v, d = np.concatenate(values), np.concatenate(members).view(np.int64)
                # of a set's equal entries the probed one comes first; a head says of its own set alone whether it is probed
                order = np.lexsort((~v, d, v >> np.uint64(1)))
                v, d = v[order], d[order]
                new = np.ones(len(v), bool)
                new[1:] = (v[1:] >> np.uint64(1)) != (v[:-1] >> np.uint64(1))
                heads = np.flatnonzero(new)
                head = v[heads]
                out = []
                bucket = (head >> np.uint64(40)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[k], cuts[k + 1])
                    packed = (head[part] & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    out.append((k, 0, packed, d[heads][part].tobytes()))
                sizes = np.diff(np.append(heads, len(v)))
                member = np.repeat(sizes > 1, sizes)
                if member.any():
                    out.append((int((ids[a] + turn) % n_buckets), 1, v[member].tobytes(), d[member].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=names)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """A bucket's blobs to (gid, key, probe) of the signatures that more than one set has."""
    kinds, bucket = table.column("kind").to_pylist(), table.column("bucket")[0].as_py()
    values, docs, more_v, more_d = [], [], [], []
    for kind, v, d in zip(kinds, table.column("values"), table.column("sets"), strict=True):
        ids = np.frombuffer(d.as_buffer(), np.int64)
        if kind:
            more_v.append(np.frombuffer(v.as_buffer(), np.uint64))
            more_d.append(ids)
        else:
            wide = np.zeros((len(ids), 8), np.uint8)
            wide[:, :5] = np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, 5)
            values.append(wide.view(np.uint64).ravel())
            docs.append(ids)
    if values:
        v, d = np.concatenate(values), np.concatenate(docs)
        order = np.lexsort((v, d, v >> np.uint64(1)))
        v, d = v[order], d[order]
        # of a set's entries the last one says whether it is probed
        last = np.append((v[1:] >> np.uint64(1) != v[:-1] >> np.uint64(1)) | (d[1:] != d[:-1]), True)
        v, d = v[last], d[last]
        key = v >> np.uint64(1)
        same = key[1:] == key[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        more_v.append(v[shared] | np.uint64(bucket << 40))
        more_d.append(d[shared])
    v, d = np.concatenate(more_v), np.concatenate(more_d)
    return pa.table({"gid": pa.array((v >> np.uint64(1)).astype(np.int64)), "key": pa.array(d), "probe": pa.array((v & np.uint64(1)).astype(np.int32))})


def _grams(text: str) -> frozenset:
    words = text.encode().translate(_ASCII_LOWER).split()
    return frozenset(zip(*(words[i:] for i in range(N)), strict=False)) if len(words) >= N else frozenset([tuple(words)] if words else ())


def _alike(both: int, r: int, s: int) -> bool:
    return both > 0 and DEN * both >= NUM * (r + s - both)


def _runs(batches):
    """(label, rows) of each run of equal labels in batches(label, rep, c, text); a row is (rep, c, text, set)."""
    label, rows = None, []
    for batch in batches:
        sets = shingle_sets(*buffers(batch.column(3)))
        for now, rep, c, text, s in zip(*(batch.column(i).to_pylist() for i in range(4)), sets, strict=True):
            if now != label:
                if rows:
                    yield label, rows
                label, rows = now, []
            rows.append((rep, c, text or "", s))
    if rows:
        yield label, rows


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of a few sets."""
    shared, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = np.bincount(at, minlength=len(shared))[at] > 1
    owner, at = owner[many], np.unique(at[many], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(at.max()) + 1 if len(at) else 0, 1 << 14):
        here = (at >= first) & (at < first + (1 << 14))
        table = np.zeros((len(sets), min(1 << 14, int(at.max()) + 1 - first)), np.float32)
        table[owner[here], at[here] - first] = 1
        out += table @ table.T
    return out.astype(np.int64)


def _linked(batches):
    """Links (a, b) that join the components of each small group."""
    out = []
    for _, rows in _runs(batches):
        both, n = _common([r[3] for r in rows]), np.array([len(r[3]) for r in rows])
        c, up = np.unique([r[1] for r in rows], return_inverse=True)[1], {}
        alike = (both > 0) & (DEN * both >= NUM * (n[:, None] + n - both)) & (c[:, None] < c)

        def root(x):
            while x in up:  # noqa: B023
                x = up[x]  # noqa: B023
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True):
            one, two = root(int(c[i])), root(int(c[j]))
            if one != two:
                x, y = _grams(rows[i][2]), _grams(rows[j][2])
                if _alike(len(x & y), len(x), len(y)):
                    out.append((rows[i][0], rows[j][0]))
                    up[two] = one
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])


def _centres(batches):
    """What several of each group's sampled rows have: shingles, how many rows have each, and the number of rows."""
    for label, rows in _runs(batches):
        shingles, n = np.unique(np.concatenate([r[3] for r in rows]), return_counts=True)
        often = n > min(1, len(rows) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label], pa.int64()), pa.array([shingles[often].tobytes()], pa.binary()), pa.array([n[often].astype(np.int32).tobytes()], pa.binary()), pa.array([len(rows)], pa.int32())],
            names=["label", "often", "times", "sampled"],
        )


_COMPARED = "label long, rep long, c long, n int, n_z int, more int, less int, added binary, removed binary"


def _compare(batches):
    """What each text of (label, part, rep, c, text, often, times, sampled) differs in from the centre: its counts, and the rarest differences.

    A row without a rep is the centre of those after it.
    """
    types = (*[pa.int64()] * 3, *[pa.int32()] * 4, pa.binary(), pa.binary())
    names = [x.split()[0] for x in _COMPARED.split(", ")]
    none = np.zeros(0, np.uint64)
    centre, often, times, z = None, none, np.zeros(0, np.int32), none
    for batch in batches:
        rows, keep = [], []
        sets = shingle_sets(*buffers(batch.column(4)))
        for i, (label, part, rep) in enumerate(zip(*(batch.column(x).to_pylist() for x in (0, 1, 2)), strict=True)):
            if centre != (label, part):
                centre, often, times, z = (label, part), none, np.zeros(0, np.int32), none
            if rep is None:
                if batch.column(5)[i].is_valid:
                    often, times = (np.frombuffer(batch.column(x)[i].as_py(), t) for x, t in ((5, np.uint64), (6, np.int32)))
                    z = often[2 * times > batch.column(7)[i].as_py()]
                continue
            s = sets[i]
            added, removed = np.setdiff1d(s, z, assume_unique=True), np.setdiff1d(z, s, assume_unique=True)
            if len(often):
                at = np.minimum(np.searchsorted(often, added), len(often) - 1)
                added = added[np.lexsort((added, np.where(often[at] == added, times[at], 0)))]
                removed = removed[np.lexsort((removed, -times[np.searchsorted(often, removed)]))]
            keep.append(i)
            rows.append((len(s), len(z), len(added), len(removed), added[: len(s) * (DEN - NUM) // DEN + 1].tobytes(), removed[: len(s) * (DEN - NUM) // NUM + 1].tobytes()))
        if rows:
            columns = [*(batch.column(i).take(pa.array(keep)) for i in (0, 2, 3)), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types[3:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _removed(table: pa.Table) -> pa.Table:
    """How many removed shingles members send, by their shape: (label, more, less, linked) with n_z gets ``keep``."""
    more, less, linked, n_z = (table.column(c).to_numpy().astype(np.int64) for c in ("more", "less", "linked", "n_z"))
    n, keep = n_z + more - less, np.zeros(len(more), np.int32)
    for first in range(0, len(more), 1024):
        x = np.s_[first : first + 1024, None]
        spare = (DEN - NUM) * (n[x] + n) // (DEN + NUM) - more[x] - more
        common = np.maximum((less[x] + less - spare + 1) // 2, 1)
        able = (spare >= abs(less[x] - less)) & (common <= np.minimum(less[x], less)) & ~((linked[x] > 0) & (linked > 0))
        keep[first : first + 1024] = np.where(able, less[x] - common + 1, 0).max(1)
    return table.select(["label", "more", "less", "linked"]).append_column("keep", pa.array(keep))


def _differences(n_buckets: int):
    """Blobs of the differences of (label, rep, added, removed), a new label made of the old one, shingle and kind.

    Bucket -1 holds the (label, rep) of labels that a batch has twice or more; the
    others hold one of each label of a batch, for the bucket to tell which
    other batches have too.
    """

    def run(batches):
        for batch in batches:
            labels, sizes = [], np.zeros(len(batch), np.int64)
            old = mix(batch.column(0).to_numpy().view(np.uint64) ^ np.uint64(0x94D049BB133111EB))
            for i, blobs in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                for kind, blob in enumerate(blobs):
                    x = np.frombuffer(blob.as_buffer(), np.uint64)
                    labels.append(mix((x ^ old[i]) + np.uint64(kind)))
                    sizes[i] += len(x)
            if not sizes.any():
                continue
            label, rep = np.concatenate(labels), np.repeat(batch.column(1).to_numpy(), sizes)
            order = np.argsort(label)
            label, rep = label[order], rep[order]
            new = np.append(True, label[1:] != label[:-1])
            twice = ~new | ~np.append(new[1:], True)
            out = [(-1, label[twice].tobytes(), rep[twice].tobytes())] if twice.any() else []
            bucket = (label[new] >> np.uint64(40)).astype(np.int64) % n_buckets
            order = np.argsort(bucket, kind="stable")
            one, its = label[new][order], rep[new][order]
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            out += [(k, one[cuts[k] : cuts[k + 1]].tobytes(), its[cuts[k] : cuts[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "labels", "reps"])

    return run


def _pairs_of(labels: np.ndarray, reps: np.ndarray) -> pa.Table:
    return pa.table({"label": pa.array(labels.view(np.int64)), "rep": pa.array(reps)})


def _shared(table: pa.Table) -> pa.Table:
    """(label, rep) of the labels that a bucket has from more than one batch."""
    label = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("labels")])
    rep = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("reps")])
    order = np.argsort(label)
    label, rep = label[order], rep[order]
    same = label[1:] == label[:-1]
    both = np.append(same, False) | np.append(False, same)
    return _pairs_of(label[both], rep[both])


def _unpacked(batches):
    for batch in batches:
        for labels, reps in zip(batch.column(1), batch.column(2), strict=True):
            yield from _pairs_of(np.frombuffer(labels.as_buffer(), np.uint64), np.frombuffer(reps.as_buffer(), np.int64)).to_batches()


def _in_runs(rows: DataFrame) -> DataFrame:
    return rows.select("label", "rep", "c", "text").repartition("label").sortWithinPartitions("label")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, text) of the members' documents. A filter of their ids is asked where texts are read, so hardly any other text is shuffled; the join decides."""
    reps = members.select("rep").distinct()
    wanted = bloom(reps.select(F.xxhash64("rep").alias("gram")))

    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(passing(batch.column(0).to_numpy(), wanted))).drop_columns(["h"])

    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("doc_id").cast("long").alias("rep"), "text")
    return texts.mapInArrow(run, "rep long, text string").join(reps, "rep", "left_semi")


def _round(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, differences) of the groups of members(label, rep, c, k) that have members of two components, with their texts(rep, text).

    links: a, b. differences: members of large groups with what they send on.
    """
    few = F.col("k") <= GROUP
    near = written(_in_runs(members.filter(few).join(texts, "rep")).mapInArrow(_linked, "a long, b long"), "jaccard-links")
    if members.filter(~few).isEmpty():
        return near, None
    large = members.filter(~few)
    sample = large.filter(F.pmod(F.xxhash64("label", "rep"), "k") < GROUP)
    centres = written(_in_runs(sample.join(texts, "rep")).mapInArrow(_centres, "label long, often binary, times binary, sampled int"), "jaccard-centres")
    # the members of a hot group are spread; its centre is repeated for each part of them
    parts = F.ceil(F.col("k") / SPREAD).cast("int")
    sizes = large.groupBy("label").agg(F.max("k").alias("k")).join(centres, "label", "left")
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("rep", "long"), ("c", "long"), ("text", "string"), ("often", "binary"), ("times", "binary"), ("sampled", "int"))}
    heads = sizes.select("label", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), none["rep"], none["c"], none["text"], "often", "times", "sampled")
    rows = large.join(texts, "rep").select("label", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), "rep", "c", "text", none["often"], none["times"], none["sampled"])
    both = rows.unionByName(heads).repartition("label", "part").sortWithinPartitions("label", "part", F.col("rep").asc_nulls_first())
    done = both.mapInArrow(_compare, _COMPARED)
    odds = (DEN + NUM) // (DEN - NUM)
    done = done.withColumn("f", odds * (F.col("more") + F.col("less")) - F.col("n"))
    done = written(done, "jaccard-compared")
    rank = F.struct("f", "rep")
    best = done.groupBy("label").agg(F.min_by("rep", rank).alias("a"), F.min_by("c", rank).alias("c_a"), F.min("f").alias("f_a"))
    done = done.join(best, "label").withColumn("linked", F.col("f") + F.col("f_a") <= 0)
    return near.unionByName(done.filter("linked AND c <> c_a").select("a", F.col("rep").alias("b"))), done


def _left(done: DataFrame, placed: DataFrame) -> DataFrame:
    """The next round's members(label, rep, c): the differences of groups that still have members of two components."""
    found = done.drop("c").join(placed, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")
    open_ = found.groupBy("label").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("label")
    found = found.join(open_, "label", "left_semi")
    shape = ["label", "more", "less", "linked"]
    shapes = found.filter(f"{DEN - NUM} * n >= {NUM} * more").groupBy(*shape).agg(F.first("n_z").alias("n_z"))
    shapes = shapes.groupBy("label").applyInArrow(_removed, "label long, more int, less int, linked boolean, keep int")
    sent = found.join(shapes, shape, "left").withColumn("removed", F.expr("substring(removed, 1, 8 * coalesce(keep, 0))"))
    n_buckets = max(partitions(done.sparkSession), done.count() >> 14)
    blobs = written(sent.select("label", "rep", "added", "removed").mapInArrow(_differences(n_buckets), "bucket int, labels binary, reps binary"), "jaccard-differences")
    far = blobs.filter("bucket >= 0").groupBy("bucket").applyInArrow(_shared, "label long, rep long")
    pairs = blobs.filter("bucket < 0").mapInArrow(_unpacked, "label long, rep long").unionByName(far).distinct()
    return pairs.join(placed, F.col("rep") == F.col("node"), "left").select("label", "rep", F.coalesce("component", "rep").alias("c"))


def _open(members: DataFrame) -> DataFrame:
    """members(label, rep, c) with k, the size of their group; only groups of two components, one of those with the same members."""
    mark = F.xxhash64("rep")
    groups = members.groupBy("label").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("y"))
    groups = groups.filter("lo <> hi").groupBy("k", "x", "y").agg(F.min("label").alias("label")).select("label", "k")
    return members.join(groups, "label")


def _merged(placed: DataFrame, more: DataFrame, name: str) -> DataFrame:
    """placed(node, component) after the links more(a, b)."""
    ends = [placed.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"]
    edges = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    step = components(edges, name)
    moved = placed.join(step.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    fresh = step.join(placed, "node", "left_anti")
    return written(moved.select("node", F.coalesce("_to", "component").alias("component")).unionByName(fresh), name)


def _allocated(members: DataFrame) -> DataFrame:
    """members(gid, rep, probe, n) of shared signatures, ``probe`` left where the set's cheapest allocation needs it.

    A set of n shingles must probe differ(n, n) + 1 of its m segments. Those
    that are not shared come first and cost nothing; then the smallest groups.
    """
    some = [(low, *segments(k), differ(high, high)) for k, (low, high) in enumerate(BANDS) if low < 1 << 31]
    band = F.expr(f"size(filter(array({', '.join(f'{x[0]}L' for x in some)}), l -> l <= n))")
    exact = F.element_at(F.array(*[F.lit(0 if x[2] else x[1]) for x in some]), band)
    counted = members.join(members.groupBy("gid").agg(F.count("*").alias("k")), "gid").filter("k > 1").withColumn("m", exact)
    own = counted.filter("probe = 1 AND m > 0")
    line = Window.partitionBy("rep").orderBy("k", "gid")
    shared = F.count("*").over(Window.partitionBy("rep"))
    need = F.expr(f"({DEN - NUM} * 2 * n) div {DEN + NUM} + 1")
    chosen = own.withColumn("_r", F.row_number().over(line)).withColumn("probe", (F.col("_r") <= need - F.col("m") + shared).cast("int"))
    kept = chosen.select("gid", "rep", "probe", "n").unionByName(counted.filter("probe = 0 OR m = 0").select("gid", "rep", "probe", "n"))
    useful = kept.filter("probe = 1").select("gid").distinct()
    return kept.join(useful, "gid", "left_semi")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, placed): each document's class, and the component of each class that is linked with another.

    classes: doc_id, n_shingles, rep (smallest doc_id of an equal set, null for
    an empty one). placed: node (a rep), component (its smallest rep).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keys = written(set_keys(docs), "jaccard-keys")
    reps = keys.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = written(keys.join(reps, ["k1", "k2"], "left").select("doc_id", "n_shingles", "rep"), "jaccard-classes")

    n_buckets = max(partitions(spark), text_bytes(docs) // BUCKET)
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blobs = texts.mapInArrow(_sign(n_buckets), "bucket int, kind int, values binary, sets binary")
    met = written(blobs.groupBy("bucket").applyInArrow(_meet, "gid long, key long, probe int"), "jaccard-met")

    sized = keys.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(F.col("k1").alias("key")).agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    grouped = written(met.join(sized, "key").groupBy("gid", "rep").agg(F.max("probe").alias("probe"), F.max("n").alias("n")), "jaccard-members")
    discard(met, keys)
    members = written(_allocated(grouped), "jaccard-allocated")
    discard(grouped)
    met = members.join(members.groupBy("gid").agg(F.count("*").alias("k")), "gid")
    pops = met.groupBy("rep").agg(F.sum("k").alias("pop"))
    rank = F.struct("pop", (-F.col("rep")).alias("r"))
    leaders = members.join(pops, "rep").groupBy("gid").agg(F.max_by("rep", rank).alias("label"), F.max("pop").alias("pop"))
    led = written(members.select("gid", "rep").join(leaders, "gid"), "jaccard-led")
    discard(members)
    # a leader most of whose groups another one leads hands over its own: the groups of one text's copies become one
    shares = led.groupBy("rep", "label").agg(F.count("*").alias("n"), F.first("pop").alias("pop"))
    best = shares.groupBy("rep").agg(F.max_by("label", F.struct("n", "pop", (-F.col("label")).alias("r"))).alias("up"), F.max("n").alias("n"), F.sum("n").alias("all"))
    up = best.select("rep", F.when(2 * F.col("n") >= F.col("all"), F.col("up")).otherwise(F.col("rep")).alias("up"))
    for _ in range(3):
        up = written(up, "jaccard-up")
        up = up.alias("x").join(up.alias("y"), F.col("x.up") == F.col("y.rep")).select(F.col("x.rep").alias("rep"), F.col("y.up").alias("up"))
    members = led.join(up.withColumnRenamed("rep", "label"), "label").select(F.col("up").alias("label"), "rep", F.col("rep").alias("c")).distinct()
    placed = spark.createDataFrame([], "node long, component long")
    old, own = [led], None
    while True:
        members = written(members, "jaccard-met")
        discard(*old)
        now = written(_open(members), "jaccard-open")
        discard(members)
        if own is None:  # later rounds have members of the first one only
            own = written(_texts(texts, now), "jaccard-texts")
        found, done = _round(now, own)
        old = [now]
        if not found.isEmpty():
            placed = _merged(placed, found, "jaccard-placed")
        if done is None:
            discard(now, own)
            return classes, placed
        members = _left(done, placed)


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    classes, group = links(docs)
    # rows of one doc_id are one node even if their texts differ
    shared = classes.filter("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
    extra = shared.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(shared.select(F.col("doc_id").alias("a"), F.col("lo").alias("b")))
    if not extra.isEmpty():
        group = _merged(group, extra, "jaccard-all")
    done = classes.join(group, classes["rep"] == group["node"], "left").drop("node")
    return done.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` whose 5-word shingle sets are similar to 0.8."""
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
    flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach AS (SELECT a AS x, a AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id FROM sets"""
