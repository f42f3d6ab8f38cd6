"""Language-model scoring with a probabilistic suffix tree.

The tree's symbols are tokens (words, and an end after each text) and, behind
tokens that are not known, the bytes that spell them. Its states are contexts:

* two tokens before the next one, and one (marks stand before a text's first token);
* the empty context of tokens;
* within a token, up to DEPTH bytes of it before the next byte or its end.

A state is retained only if it passes a divergence test: its count times the
Kullback-Leibler divergence of its next symbols from what the shorter state
says must reach MARGIN nats for each next symbol it has seen. A retained
state's distribution discounts its counts by DISCOUNT and gives what that saves
to the shorter state's distribution. A symbol is scored in the longest retained
suffix of what stands before it.

The empty context of tokens gives a token its discounted share of the training
tokens, and of what the discounts save the share that the byte states give to
its spelling: with N training tokens, a count of c and discounts D(c) that sum
to S over the distinct tokens, (c - D(c)) / N + S / N * spelling. D follows from
how many tokens were met once, twice, three and four times (modified Kneser-Ney
estimates). The byte states learn from each distinct training token once, for
a token not met before is a new one. Each distribution sums to one over all
tokens, so a text's score is a true log-probability.

The corpus is cut into blocks, each written once: its distinct words with their
bytes and training counts, and its texts as numbers of these words. Words meet
in buckets, which count them, spell them and answer the blocks; contexts of one
token, with what follows them, meet in other buckets, which test them and
answer with counts, and then those of two, tested against these. A block sends a word or a (context, token) pair once
however often it has it, so what is frequent costs its bucket one entry a block.
Contexts of two frequent words (1/256 of all tokens or more each) are dealt to
buckets by the next token too, as are contexts of one word that is 1/4096 of all
tokens or more; there are 65,536 and 4,096 of these at most, so their totals go
to every block. No task ever holds the whole model.

Defined results: a null or empty text is one end token. A null doc_id counts as
an empty text for the split. Without training documents every count is 0 and
all states are empty. Repeated rows and texts (ties) get equal results. A very
long text is a block of its own, scored whole. Rows with columns of clashing
names are read by doc_id and text only. An empty table gives an empty table.
Words are told apart by 63-bit hashes, contexts by 40 bits and their bucket, the
tokens after a context by 24 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import bound_batches, buffers, discard, doc_slices, lower_words, mix, partitions, span_hashes, text_bytes, written

DEPTH, BITS, ALPHABET = 5, 10, 257
DISCOUNT, MARGIN = 0.75, 1.0
BLOCK, SLICE, BUCKET = 8 << 20, 1 << 20, 16 << 20
#: A word is frequent if it is this share of all tokens or more.
FREQUENT = 256
#: Alone before the next token it is so at this one.
FREQUENT_ALONE = 4096
_END = 257
_END_WORD, _BEGIN = np.uint64(0x5DEECE66D1CE4E5B >> 1), np.uint64(0x2545F4914F6CDD1D)
_LOW32 = np.uint64((1 << 32) - 1)
#: Bits by which a context's next tokens are told apart; the others of a key, and its bucket, tell contexts apart.
_SYMBOL = np.uint64(24)


def squeeze(a: np.ndarray, rising: bool = False) -> bytes:
    """An array as compressed byte planes; rising: of sorted integers, by their differences."""
    if rising and len(a):
        a = np.concatenate((a[:1], a[1:] - a[:-1]))
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unsqueeze(blob: bytes, n: int, kind, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    a = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if rising else a


def _within(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, one after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths)


def _distinct(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each stands in training."""
    order = np.sort(values << np.uint64(1) | train) if not (values >> np.uint64(63)).any() else None
    if order is not None:
        v, t = order >> np.uint64(1), (order & np.uint64(1)).astype(np.int64)
    else:
        at = np.argsort(values)
        v, t = values[at], train[at].astype(np.int64)
    heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return v[heads], np.add.reduceat(t, heads)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    v, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(v)
    v, n = v[order], n[order]
    heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return v[heads], np.add.reduceat(n, heads)


def spelled(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the symbols of words (bytes one after the other), and how many symbols each has; a word of no bytes is the end."""
    n = lengths + 1
    begin = np.cumsum(n + DEPTH) - n
    symbols = np.zeros(int((n + DEPTH).sum()), np.uint64)
    symbols[begin + lengths] = np.where(lengths > 0, 33, _END)
    symbols[np.repeat(begin, lengths) + _within(lengths)] = raw.astype(np.uint64) + np.uint64(1)
    grams = symbols.copy()
    for k in range(1, DEPTH + 1):
        grams[k:] |= symbols[:-k] << np.uint64(BITS * k)
    return grams[symbols > 0], n


def _picked(raw: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes of some of the words."""
    starts = np.cumsum(lengths) - lengths
    return raw[np.repeat(starts[at], lengths[at]) + _within(lengths[at])]


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct tokens, their lengths, their bytes, each token's number among them, tokens of each text) of texts."""
    names, sizes, kinds, lengths, texts = [], [], [np.array([_END_WORD])], [np.zeros(1, np.int64)], [np.zeros(0, np.uint8)]
    for a, b in doc_slices(offsets, SLICE):
        low, starts, ends, owner = lower_words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        words = np.bincount(owner, minlength=b - a)
        name = np.full(len(starts) + b - a, _END_WORD)
        hashes = span_hashes(low, starts, ends) >> np.uint64(1)
        name[np.arange(len(starts)) + owner] = hashes
        names.append(name)
        sizes.append(words + 1)
        own, first = np.unique(hashes, return_index=True)
        span = (ends - starts)[first]
        kinds.append(own)
        lengths.append(span)
        texts.append(low[np.repeat(starts[first], span) + _within(span)])
    kind, length, text = np.concatenate(kinds), np.concatenate(lengths), np.concatenate(texts)
    known, first = np.unique(kind, return_index=True)
    at = [np.searchsorted(known, n).astype(np.uint32) for n in names]
    return known, length[first], _picked(text, length, first), np.concatenate(at), np.concatenate(sizes)


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return (mix(values + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(33)).astype(np.int64) % n


def _table(rows: list[tuple], schema: str) -> pa.Table | pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*((x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")), strict=True)
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})


_BLOCKS = "bucket int, block long, n long, keys binary, counts binary, lengths binary, text binary"


def _zip(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def _unzip(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)


def _blocks(n_buckets: int):
    """Texts to blocks: a row a bucket with the block's words of it; and one row (bucket -1) with the texts as numbers of words."""

    def run(batches):
        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            ids, none = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in doc_slices(offsets, BLOCK):
                known, lengths, text, at, sizes = _tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts = np.bincount(at, weights=np.repeat(train[a:b], sizes), minlength=len(known)).astype(np.uint32)
                block, turn = part << 32 | turn, turn + 1
                bucket = _bucket(known, n_buckets)
                # words are numbered by bucket, in it by their hash: as the answers come
                order = np.argsort(bucket, kind="stable")
                number = np.empty(len(order), np.uint32)
                number[order] = np.arange(len(order))
                at = number[at]
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                rows = [(k, order[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist()]
                out = [(k, block, len(w), squeeze(known[w], True), squeeze(counts[w]), squeeze(lengths[w].astype(np.uint32)), _zip(_picked(text, lengths, w))) for k, w in rows]
                marks = (train[a:b] * 1 + none[a:b] * 2).astype(np.uint8)
                out.append((-1, block, b - a, squeeze(at), squeeze(sizes.astype(np.uint32)), squeeze(ids[a:b].astype(np.int64)), marks.tobytes()))
                yield from _table(out, _BLOCKS).to_batches()

    return run


_LEXICON = "bucket int, n long, distinct long, total long, met1 long, met2 long, met3 long, met4 long, keys binary, counts binary, lengths binary, text binary"


def _lexicon(table: pa.Table) -> pa.Table:
    """A bucket's distinct words with their training counts and bytes, and how many were met how often."""
    keys, counts, lengths, texts = [], [], [], []
    for n, k, c, size, text in zip(*(table.column(x).to_pylist() for x in ("n", "keys", "counts", "lengths", "text")), strict=True):
        keys.append(unsqueeze(k, n, np.uint64, True))
        counts.append(unsqueeze(c, n, np.uint32).astype(np.int64))
        lengths.append(unsqueeze(size, n, np.uint32).astype(np.int64))
        texts.append(_unzip(text, int(lengths[-1].sum())))
    key, length = np.concatenate(keys), np.concatenate(lengths)
    known, first, at = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64)
    text = _picked(np.concatenate(texts), length, first)
    met = [int((total == k).sum()) for k in (1, 2, 3, 4)]
    row = (table.column("bucket")[0].as_py(), len(known), int((total > 0).sum()), int(total.sum()), *met, squeeze(known, True), squeeze(total), squeeze(length[first].astype(np.uint32)), _zip(text))
    return _table([row], _LEXICON)


def _opened_lexicon(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    lengths = unsqueeze(row["lengths"], n, np.uint32).astype(np.int64)
    return unsqueeze(row["keys"], n, np.uint64, True), unsqueeze(row["counts"], n, np.int64), lengths, _unzip(row["text"], int(lengths.sum()))


def _grams_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, in how many training words each stands, all grams, symbols of each word) of a bucket's words."""
    _, counts, lengths, text = _opened_lexicon(row)
    grams, n = spelled(text, lengths)
    return *_distinct(grams, np.repeat(counts > 0, n).astype(np.uint64)), grams, n


_ASKED = "bucket int, asker int, n long, keys binary, counts binary"


def _ask_grams(n_buckets: int):
    """A word bucket's distinct grams, by the bucket that counts them."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                grams, counts, _, _ = _grams_of(row)
                bucket = _bucket(grams, n_buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                parts = [(k, order[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist()]
                yield from _table([(k, row["bucket"], len(x), squeeze(grams[x], True), squeeze(counts[x].astype(np.uint32))) for k, x in parts], _ASKED).to_batches()

    return run


def _opened(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    rows = zip(*(table.column(c).to_pylist() for c in ("asker", "n", "keys", "counts")), strict=True)
    return [(asker, unsqueeze(k, n, np.uint64, True), unsqueeze(c, n, np.uint32)) for asker, n, k, c in rows]


def _count_grams(table: pa.Table) -> pa.Table:
    grams, counts = _merged([(k, c.astype(np.int64)) for _, k, c in _opened(table)])
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"bucket": pa.array(np.full(len(grams), bucket, np.int32)), "g": pa.array(grams.astype(np.int64)), "n": pa.array(counts)})


def tree(grams: DataFrame) -> DataFrame:
    """grams(bucket, g, n) with ``p``: the probability of the symbol after its context."""

    def cut(depth: int) -> Column:
        return F.col("g").bitwiseAND(F.lit((1 << BITS * (depth + 1)) - 1))

    levels = [grams]
    for depth in range(DEPTH - 1, -1, -1):
        levels.append(written(levels[-1].select(cut(depth).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n")), f"tree-counts{depth}"))
    levels.reverse()
    total = levels[0].agg(F.sum("n")).first()[0] or 0
    known = levels[0].withColumn("p", (F.col("n") + 1) / F.lit(float(total + ALPHABET)))
    for depth in range(1, DEPTH + 1):
        parent = known.select(F.col("g").alias("up"), F.col("p").alias("q"))
        now = levels[depth].withColumn("up", cut(depth - 1)).join(parent, "up").drop("up")
        context = Window.partitionBy(F.shiftright("g", BITS))
        now = now.withColumn("_n", F.sum("n").over(context)).withColumn("_u", F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(context))
        gain = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("_n") / F.col("q"))).otherwise(0.0)
        now = now.withColumn("_kl", F.sum(gain).over(context))
        own = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("_u") * F.col("q")) / F.col("_n")
        p = F.when((F.col("_n") > 0) & (F.col("_kl") >= MARGIN * F.col("_u")), own).otherwise(F.col("q"))
        known = now.withColumn("p", p).drop("q", "_n", "_u", "_kl")
        shorter, known = known, written(known.drop("up"), f"tree-depth{depth}")
        discard(levels[depth], *([shorter] if depth > 1 else [levels[0]]))
    return known


_ANSWER = "asker int, bucket int, n long, reply binary"


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Logarithms of the probabilities of each asker's grams, in the order it asked."""
    rows = []
    if len(asked):
        g, p = model.column("g").to_numpy().astype(np.uint64), np.log(model.column("p").to_numpy())
        order = np.argsort(g)
        g, p = g[order], p[order].astype(np.float32)
        bucket = asked.column("bucket")[0].as_py()
        rows = [(asker, bucket, len(k), squeeze(p[np.searchsorted(g, k)])) for asker, k, _ in _opened(asked)]
    return _table(rows, _ANSWER)


_ROOT = "bucket int, n long, keys binary, counts binary, logs binary"


def _root(n_buckets: int, total: int, saved: float, less: list[float]):
    """The words of a bucket with counts and the logarithms of their probability in the empty context."""

    def run(lexicon: pa.Table, replies: pa.Table) -> pa.Table:
        row = lexicon.to_pylist()[0]
        keys, counts, _, _ = _opened_lexicon(row)
        grams, _, every, n = _grams_of(row)
        own = np.empty(len(grams))
        found = sorted((b, m, blob) for b, m, blob in zip(*(replies.column(c).to_pylist() for c in ("bucket", "n", "reply")), strict=True))
        own[np.argsort(_bucket(grams, n_buckets), kind="stable")] = np.concatenate([unsqueeze(blob, m, np.float32) for _, m, blob in found])
        logs = np.add.reduceat(own[np.searchsorted(grams, every)], np.cumsum(n) - n)
        if total:
            with np.errstate(divide="ignore"):
                seen = np.log((counts - np.array(less)[np.minimum(counts, 3)]) / total)
            logs = np.logaddexp(seen, np.log(saved / total) + logs)
        return _table([(row["bucket"], len(keys), squeeze(keys, True), squeeze(counts), squeeze(logs))], _ROOT)

    return run


_REPLY = "block long, kind int, bucket int, n long, counts binary, logs binary, at binary"


def _reply(asked: pa.Table, root: pa.Table) -> pa.Table:
    """Counts, logarithms and numbers (places in the bucket) for each block's words of a bucket."""
    row = root.to_pylist()[0]
    keys, counts, logs = unsqueeze(row["keys"], row["n"], np.uint64, True), unsqueeze(row["counts"], row["n"], np.int64), unsqueeze(row["logs"], row["n"], np.float64)
    rows = []
    for block, n, k in zip(*(asked.column(c).to_pylist() for c in ("block", "n", "keys")), strict=True):
        at = np.searchsorted(keys, unsqueeze(k, n, np.uint64, True))
        rows.append((block, 0, row["bucket"], n, squeeze(counts[at].astype(np.uint32)), squeeze(logs[at].astype(np.float32)), squeeze(at.astype(np.uint32), True)))
    return _table(rows, _REPLY)


def _body(blocks: pa.Table, replies: pa.Table, n_buckets: int, total: int, totals: list[dict[int, tuple[int, int]]]):
    """A block's texts from its rows and the answers for its words: what `_contexts` and `_score` both need.

    Contexts of one token and then of two, as far as ``totals`` (their wide
    contexts) go, have their say in the logarithms; the places of the next
    longer ones come with them.
    """
    body = blocks.to_pylist()[0]
    replies = replies.to_pylist()
    sizes = unsqueeze(body["counts"], body["n"], np.uint32).astype(np.int64)
    at = unsqueeze(body["keys"], int(sizes.sum()), np.uint32).astype(np.int64)
    found = sorted((r for r in replies if r["kind"] == 0), key=lambda r: r["bucket"])
    counts = np.concatenate([unsqueeze(r["counts"], r["n"], np.uint32).astype(np.int64) for r in found])
    logs = np.concatenate([unsqueeze(r["logs"], r["n"], np.float32).astype(np.float64) for r in found])[at]
    # a word's bucket and its place in it name it
    names = np.concatenate([unsqueeze(r["at"], r["n"], np.uint32, True).astype(np.uint64) | np.uint64(r["bucket"] << 32) for r in found])
    name = mix(names)[at]
    place = _within(sizes)
    symbol = mix(name ^ np.uint64(0x94D049BB133111EB)) >> (np.uint64(64) - _SYMBOL)

    def places(order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before = lambda k: np.where(place >= k, np.roll(name, k), _BEGIN)
        often = counts * (FREQUENT if order == 2 else FREQUENT_ALONE) >= max(total, 1)
        spread = lambda k: np.where(place >= k, often[np.roll(at, k)], False)
        if order == 1:
            context, wide = mix(before(1) * np.uint64(0x9E3779B97F4A7C15)), spread(1)
        else:
            context, wide = mix(before(1) * np.uint64(0x9E3779B97F4A7C15) + mix(before(2) * np.uint64(0xC2B2AE3D27D4EB4F))), spread(1) & spread(2)
        bucket = (np.where(wide, mix(context ^ symbol), context) & _LOW32).astype(np.int64) % n_buckets
        return wide, bucket, (context >> _SYMBOL << _SYMBOL) | symbol

    for order, some in enumerate(totals, 1):
        logs = _inside([r for r in replies if r["kind"] == order], *places(order), some, logs)
    marks = np.frombuffer(body["text"], np.uint8)
    return body, sizes, counts[at], logs, (marks & 1) > 0, (marks & 2) > 0, places


def _inside(found: list[dict], wide: np.ndarray, bucket: np.ndarray, key: np.ndarray, totals: dict[int, tuple[int, int]], logs: np.ndarray) -> np.ndarray:
    """Logarithms of the tokens' probabilities in contexts that are retained, by those in the shorter ones; totals: size and distinct next tokens of the wide contexts that are retained."""
    some = np.array(sorted(totals), np.uint64)
    figures = np.array([totals[int(k)] for k in some], np.int64).reshape(-1, 2)
    first, number = _pairs(bucket, key)
    found = sorted(found, key=lambda r: r["bucket"])
    pairs = np.concatenate([unsqueeze(r["counts"], r["n"], np.int64) for r in found])
    b, context = bucket[first], key[first] >> _SYMBOL
    new = np.append(True, (b[1:] != b[:-1]) | (context[1:] != context[:-1]))[: len(b)]
    group = np.cumsum(new) - 1
    cuts = np.searchsorted(b, [r["bucket"] for r in found] + [1 << 40])
    both = [unsqueeze(r["logs"], 2 * int(new[x:y].sum()), np.int64).reshape(2, -1) for r, x, y in zip(found, cuts[:-1], cuts[1:], strict=True)]
    size, seen = np.concatenate(both, 1)[:, group]
    if len(some):
        of = np.minimum(np.searchsorted(some, context), len(some) - 1)
        known = wide[first] & (some[of] == context)
        size, seen = np.where(known, figures[of, 0], size), np.where(known, figures[of, 1], seen)
        size = np.where(wide[first] & ~known, 0, size)
    else:
        size = np.where(wide[first], 0, size)
    size, seen, own = size[number], seen[number], pairs[number]
    inside = (np.maximum(own - DISCOUNT, 0) + DISCOUNT * seen * np.exp(logs)) / np.maximum(size, 1)
    with np.errstate(divide="ignore"):
        return np.where(size > 0, np.log(inside), logs)


def _pairs(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct (bucket, key) stands first, the number of each one among them), in order."""
    order = np.lexsort((key, bucket))
    b, k = bucket[order], key[order]
    new = np.append(True, (b[1:] != b[:-1]) | (k[1:] != k[:-1]))[: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


_PAIRS = "bucket int, block long, n long, contexts long, keys binary, counts binary, sums binary, wide binary"


def _contexts(n_buckets: int, total: int, totals: list[dict[int, tuple[int, int]]]):
    """A block's (context, token) pairs with training counts, by bucket, and for each context the sum of what the shorter one says of its next tokens."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        body, sizes, _, logs, train, _, places = _body(blocks, replies, n_buckets, total, totals)
        wide, bucket, key = places(len(totals) + 1)
        learn = np.repeat(train, sizes)
        first, number = _pairs(bucket, key)
        counts = np.bincount(number, weights=learn, minlength=len(first)).astype(np.uint32)
        b, k, w = bucket[first], key[first], wide[first]
        context = k >> _SYMBOL
        new = np.append(True, (b[1:] != b[:-1]) | (context[1:] != context[:-1]))[: len(b)]
        group = np.cumsum(new) - 1
        sums = np.bincount(group[number], weights=np.where(learn, logs, 0.0), minlength=int(new.sum()))
        cuts, heads = np.searchsorted(b, np.arange(n_buckets + 1)), np.flatnonzero(new)
        rows = []
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            x = slice(cuts[i], cuts[i + 1])
            g = slice(*np.searchsorted(heads, [cuts[i], cuts[i + 1]]))
            rows.append((i, body["block"], cuts[i + 1] - cuts[i], g.stop - g.start, squeeze(k[x], True), squeeze(counts[x]), squeeze(np.round(sums[g] * -1024).astype(np.int64)), np.packbits(w[heads[g]]).tobytes()))
        return _table(rows, _PAIRS)

    return run


_TESTED = "block long, kind int, bucket int, n long, counts binary, logs binary, context long, seen long, size long, gain double"


def _test(order: int):
    """Counts of each block's pairs of a bucket (kind ``order``, the tokens of a context), with the size of the context and how many tokens it has seen where it is retained; parts of wide contexts (kind -1)."""

    def run(table: pa.Table) -> pa.Table:
        asked = []
        for block, n, m, k, c, s, w in zip(*(table.column(x).to_pylist() for x in ("block", "n", "contexts", "keys", "counts", "sums", "wide")), strict=True):
            asked.append((block, unsqueeze(k, n, np.uint64, True), unsqueeze(c, n, np.uint32).astype(np.int64), unsqueeze(s, m, np.int64) / -1024, np.unpackbits(np.frombuffer(w, np.uint8), count=m) > 0))
        bucket = table.column("bucket")[0].as_py()
        keys, counts = _merged([(k, c) for _, k, c, _, _ in asked])
        context = keys >> _SYMBOL
        heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        names = context[heads]
        seen, size = np.add.reduceat((counts > 0).astype(np.int64), heads), np.add.reduceat(counts, heads)
        sums, wide = np.zeros(len(names)), np.zeros(len(names), bool)
        for _, k, _, s, w in asked:
            own = np.unique(k >> _SYMBOL)
            at = np.searchsorted(names, own)
            sums[at] += s
            wide[at] |= w
        own = np.add.reduceat(np.where(counts > 0, counts * np.log(np.maximum(counts, 1)), 0.0), heads)
        gain = own - sums
        kept = (gain - size * np.log(np.maximum(size, 1)) >= MARGIN * seen) & (size > 0)
        kinds = "block long, kind int, bucket int, n long, counts binary, logs binary".split(", ")
        types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in kinds]
        rows = []
        for block, k, _, _, _ in asked:
            at = np.searchsorted(keys, k)
            group = np.searchsorted(names, np.unique(k >> _SYMBOL))
            both = np.stack((np.where(kept[group], size[group], 0), np.where(kept[group], seen[group], 0)))
            rows.append((block, order, bucket, len(k), squeeze(counts[at]), squeeze(both.ravel()), None, None, None, None))
        rows += [(None, -1, bucket, 0, None, None, int(names[i].astype(np.int64)), int(seen[i]), int(size[i]), float(gain[i])) for i in np.flatnonzero(wide).tolist()]
        names_ = [x.split()[0] for x in _TESTED.split(", ")]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names_, [*types, *[pa.int64()] * 3, pa.float64()], strict=True))})

    return run


def discounts(met: list[int]) -> list[float]:
    """Discounts of counts 0, 1, 2, 3 and more, from the numbers of tokens met 1, 2, 3 and 4 times."""
    out = [0.0]
    y = met[0] / (met[0] + 2 * met[1]) if met[0] else 0.5
    for c in (1, 2, 3):
        d = c - (c + 1) * y * met[c] / met[c - 1] if met[c - 1] else 0.5 * c
        out.append(min(max(d, 0.1), c - 0.05))
    return out


def _score(n_buckets: int, total: int, totals: list[dict[int, tuple[int, int]]]):
    """Sums of a block's documents."""
    names = ("doc_id", "train", "n_tokens", "n_known", "log_counts", "score")

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        body, sizes, counts, logs, train, none, _ = _body(blocks, replies, n_buckets, total, totals)
        starts = np.cumsum(sizes) - sizes
        by = lambda x: np.add.reduceat(x, starts)
        ids = pa.array(unsqueeze(body["lengths"], body["n"], np.int64), mask=none)
        return pa.table(dict(zip(names, (ids, pa.array(train), pa.array(sizes), pa.array(by((counts > 0).astype(np.int64))), pa.array(by(np.log10(counts + 1.0))), pa.array(by(logs) / np.log(10))), strict=True)))

    return run


def _wide(tested: DataFrame) -> dict[int, tuple[int, int]]:
    """Size and distinct next tokens of the wide contexts that are retained: of two of at most FREQUENT words each, or of one of FREQUENT_ALONE."""
    rows = tested.filter("kind = -1").groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("size").alias("size"), F.sum("gain").alias("gain")).filter("size > 0")
    rows = rows.filter(F.col("gain") - F.col("size") * F.log("size") >= MARGIN * F.col("seen")).collect()
    return {r["context"]: (r["size"], r["seen"]) for r in rows}


def scored(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document; ``train`` picks those to learn from."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(True)).alias("train"))
    n_buckets = max(1, partitions(spark), text_bytes(docs) // BUCKET)
    blocks = written(docs.mapInArrow(_blocks(n_buckets), _BLOCKS), "lm-blocks")
    words = blocks.filter("bucket >= 0")
    lexicon = written(words.groupBy("bucket").applyInArrow(_lexicon, _LEXICON), "lm-lexicon")
    sums = lexicon.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "total", "met1", "met2", "met3", "met4")]).first()
    distinct, tokens, met = sums["distinct"], sums["total"], [sums[f"met{k}"] for k in (1, 2, 3, 4)]
    less = discounts(met)
    saved = less[1] * met[0] + less[2] * met[1] + less[3] * (distinct - met[0] - met[1])
    asked = written(lexicon.mapInArrow(_ask_grams(n_buckets), _ASKED), "lm-asked")
    model = tree(written(asked.groupBy("bucket").applyInArrow(_count_grams, "bucket int, g long, n long"), "lm-grams"))
    answers = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(_answer, _ANSWER)
    answers = answers.withColumnRenamed("bucket", "from").select("asker", F.col("from").alias("bucket"), "n", "reply")
    root = lexicon.groupBy("bucket").cogroup(answers.groupBy("asker")).applyInArrow(_root(n_buckets, tokens, saved, less), _ROOT)
    replies = written(words.select("bucket", "block", "n", "keys").groupBy("bucket").cogroup(root.groupBy("bucket")).applyInArrow(_reply, _REPLY), "lm-replies")
    discard(lexicon, asked, model)
    parts, found, totals = blocks.filter("bucket < 0"), replies, []
    for order in (1, 2):
        pairs = parts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_contexts(n_buckets, tokens, list(totals)), _PAIRS)
        tested = written(pairs.groupBy("bucket").applyInArrow(_test(order), _TESTED), "lm-tested")
        totals.append(_wide(tested))
        found = found.unionByName(tested.filter("kind > 0").select(*replies.columns[:-1]), allowMissingColumns=True)
    done = parts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_score(n_buckets, tokens, totals), "doc_id long, train boolean, n_tokens long, n_known long, log_counts double, score double")
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))
    return done.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole ``documents``, learnt from those whose crc32(doc_id) mod 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2)
