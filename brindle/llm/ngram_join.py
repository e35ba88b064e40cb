"""N-gram Jaccard join of documents with themselves, and its classes.

Two documents link when the Jaccard similarity of their sets of word
shingles reaches percent / 100.

1. One pass counts words and shingles into two sketches of fixed size
   (2**SKETCH_BITS counters each). Shingles are ordered by how far their counter
   is above the usual one, then by their rarest word: rare first. Any
   fixed order gives equal results; this one puts what a text has for itself
   before what many share, so that texts just below the threshold, which differ
   in many shingles, have none of the common ones in their prefixes.
2. One pass makes each document's set (64-bit hashes), a 128-bit digest of
   it, and its prefix, the first n - ceil(t n) + 1 shingles in that order.
   Equal digests become one class, so copies meet no join.
   The suffix filter is a bound on the sets' Hamming distance: members fall
   into CELLS cells by hash, and cells of unlike parity differ at least once.
   Pairs that pass meet the same bound with cells by the size of their sets.
   What passes that is compared once, by the words themselves.
3. Prefix entries are dealt once by shingle, and those whose shingle occurs in
   one class only go. In each group of a shingle, all others are paired with
   the member that has it first in its prefix, filtered by length and position,
   verified once per pair, and joined into components.
4. What remains are shingles in several components: there pairs of
   different components that pass the length and position filters (what follows
   the first common shingle must reach the overlap) are verified once, and the components are joined. A pair within one component
   can change nothing, so no link is lost.

Null and empty texts have an empty set: n_shingles 0, linked with nothing.
Rows of one doc_id are one node with several sets. Rows with a null doc_id
link with nothing and have a null component_id. An empty table gives an empty
result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import dropped, written

SKETCH_BITS = 20
SLICES = 64
CELLS = 1024
_PARITY = [f"s{k}" for k in range(CELLS // 64)]
BLOCK = 1 << 19

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits depend on all of the input's."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32  # A-Z count as a-z
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], _U)  # the low k bytes
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in data (UTF-8), and the number of words before each start of a text.

    Eight bytes at a time go through a bijection; words longer than LONG_WORD bytes are hashed by BLAKE2.
    """
    n = len(data)
    inside = _WORD[data]
    fresh = np.zeros(n + 1, bool)
    fresh[starts[starts < n]] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    first = np.flatnonzero(inside & (~before | fresh[:n]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    size = np.flatnonzero(inside & (~after | fresh[1:])) + 1 - first
    small = np.zeros(n + 8, np.uint8)
    small[:n] = _SMALL[data]
    eight = np.ndarray((n + 1,), "<u8", small, strides=(1,))  # the eight bytes from each place on
    h = _mix(size.astype(_U) + _U(0x9E3779B97F4A7C15))
    own = np.flatnonzero(size <= LONG_WORD)
    at, left = first[own], size[own]
    while len(own):
        h[own] = _mix(h[own] * _U(0xD6E8FEB86659FD93) ^ (eight[at] & _KEPT[np.minimum(left, 8)]))
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(blake2b(small[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(first, starts)


def text_words(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text, null as empty. Memory follows the longest text's words, not its bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        a, b = offsets[at], offsets[to]
        if b - a <= 2 * BLOCK:
            h, cut = word_hashes(data[a:b], offsets[at : to + 1] - a)
            yield from (h[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        else:  # one long text: in blocks that end at white space
            parts = []
            while a < b:
                e = min(a + BLOCK, b)
                while e < b and _WORD[data[e]]:
                    step = np.flatnonzero(~_WORD[data[e : e + BLOCK]])
                    e = min(b, e + (int(step[0]) if len(step) else BLOCK))
                parts.append(word_hashes(data[a:e], np.zeros(1, np.int64))[0])
                a = e
            yield np.concatenate(parts)
        at = to


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size words; fewer words, but not none, are one."""
    n = len(words)
    k = min(size, n)
    if not k:
        return words
    out = np.zeros(n - k + 1, _U)
    for j in range(k):
        out = _mix(out + words[j : n - k + 1 + j] * _U(2 * j + 1))
    return out if k == size else _mix(out + _U(k))


def _needed(n: np.ndarray | int, percent: int):
    return -(-percent * n // 100)


def sketch(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels of words and of shingles by the low bits of their hashes: how far a counter is above the median one, in its spread, by eighths of a power of two."""
    m, width = 1 << SKETCH_BITS, (2 << SKETCH_BITS) // SLICES

    def total(pairs: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sums: dict[int, np.ndarray] = {}
        for k, x in pairs:
            sums[k] = sums[k] + x if k in sums else x
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * m, np.int64)
        held: list[np.ndarray] = []
        size_ = 0

        def flush() -> None:
            nonlocal size_
            if held:
                np.add(counts, np.bincount(np.concatenate(held), minlength=2 * m), out=counts)
            held.clear()
            size_ = 0

        for batch in batches:
            for w in text_words(batch.column(0)):
                low = _U(m - 1)
                held.append((w & low).astype(np.int64))
                held.append((np.unique(shingles(w, size)) & low).astype(np.int64) + m)
                size_ += 2 * len(w)
                if size_ > 2_000_000:
                    flush()
        flush()
        yield total((k, counts[k * width : (k + 1) * width]) for k in range(SLICES))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield total((k, np.frombuffer(x, "<u4").astype(np.int64)) for batch in batches for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    schema = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(merge, schema).collect()  # SLICES rows, 8 MB in all
    counts = np.zeros(2 * m, np.int64)
    for k, x in rows:
        counts[k * width : (k + 1) * width] = np.frombuffer(x, "<u4")

    def levels(c: np.ndarray) -> np.ndarray:
        usual = float(np.median(c))
        return np.minimum(255, 8 * np.log2(np.maximum(1.0, (c - usual) / (2 * max(1.0, usual) ** 0.5)))).astype(np.uint8)

    return levels(counts[:m]), levels(counts[m:])


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, f1 and f2 (digest of the set), prefix and parities of each row, written."""
    common = docs.sparkSession.sparkContext.broadcast(sketch(docs, size))
    least = min(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 62  # smaller sets link with equal ones only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (word_level, level), low = common.value, _U((1 << SKETCH_BITS) - 1)
        for batch in batches:
            n, f1, f2, prefixes, parity = [], [], [], [], []
            for words in text_words(batch.column(1)):
                own, at = np.unique(shingles(words, size), return_index=True)
                n.append(len(own))
                f1.append(int(np.sum(_mix(own), dtype=_U)))
                f2.append(int(np.sum(_mix(own * _U(0xC2B2AE3D27D4EB4F)), dtype=_U)))
                odd = np.bincount((own & _U(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
                parity.append(np.packbits(odd.astype(bool)).view("<i8"))
                if len(own) < least:
                    prefixes.append(own[:0].view(np.int64))
                    continue
                word = word_level[(words & low).astype(np.int64)]
                k = min(size, len(words))
                rank = word[at]
                for j in range(1, k):
                    rank = np.minimum(rank, word[at + j])
                p = len(own) - _needed(len(own), percent) + 1
                prefixes.append(own[np.lexsort((own, rank, level[(own & low).astype(np.int64)]))[:p]].view(np.int64))
            sizes = np.cumsum([0, *map(len, prefixes)])
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64), pa.int64())
            signed = lambda x: pa.array(np.array(x, _U).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), signed(f1), signed(f2), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat), *[pa.array(c, pa.int64()) for c in np.array(parity, np.int64).reshape(-1, len(_PARITY)).T]], ["doc_id", "n", "f1", "f2", "prefix", *_PARITY])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, prefix array<bigint>, " + ", ".join(f"{c} bigint" for c in _PARITY)), "signatures")


def fine_cells(own: np.ndarray) -> bytes:
    """The parities of cells by hash, four to eight cells for each member."""
    m = max(64, 1 << (4 * len(own) - 1).bit_length())
    odd = np.bincount((own & _U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def unlike(a: bytes, b: bytes) -> int:
    """How many members are in one of two sets only, at least; the finer cells are folded to the coarser."""
    x, y = (np.frombuffer(c, np.uint8) for c in (a, b))
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def _most_apart(both: int, percent: int) -> int:
    """The most members that may be in one set only, of sets that have so many in all."""
    return both - 2 * -(-percent * both // (100 + percent))


def _own(docs: DataFrame, nodes: DataFrame, most_broadcast: int) -> DataFrame:
    """doc_id and text of the documents among nodes (_node)."""
    if nodes.count() <= most_broadcast:
        nodes = F.broadcast(nodes)
    return docs.select("doc_id", "text").join(nodes, F.col("doc_id") == F.col("_node"), "left_semi")


def _fine(texts: DataFrame, size: int) -> DataFrame:
    """node, its set's size and fine_cells()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(w, size)) for w in text_words(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, own)), pa.int64()), pa.array(list(map(fine_cells, own)), pa.binary())], ["node", "m", "fine"])

    return texts.mapInArrow(run, "node bigint, m bigint, fine binary")


def similar(a: bytes, b: bytes, size: int, percent: int) -> bool:
    """Whether the sets of word shingles of two texts (UTF-8) reach percent. Words and shingles are numbered, never hashed."""
    x, y = a.lower().split(), b.lower().split()  # of bytes: A-Z, and ASCII white space
    k = min(size, len(x))
    if not k or k != min(size, len(y)):
        return False
    word = pa.array(x + y, pa.large_binary()).dictionary_encode()
    v, own = len(word.dictionary), word.indices.to_numpy().astype(np.int64)
    p, q = own[: len(x)], own[len(x) :]
    left, right = p, q
    for j in range(1, k):
        both = np.concatenate([left[:-1] * v + p[j:], right[:-1] * v + q[j:]])
        both = np.unique(both, return_inverse=True)[1]
        left, right = both[: len(left) - 1], both[len(left) - 1 :]
    left, right = np.unique(left), np.unique(right)
    same = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * same >= percent * (len(left) + len(right) - same)


def _apart(x: list[str], y: list[str], n: str, percent: int) -> str:
    """Whether unlike parities in these columns are few enough for sets of n members in all."""
    return f"({' + '.join(f'bit_count({a} ^ {b})' for a, b in zip(x, y, strict=True))}) * {100 + percent} <= {100 - percent} * ({n})"


def verified(docs: DataFrame, pairs: DataFrame, cells: DataFrame, size: int, percent: int, most_broadcast: int) -> DataFrame:
    """The pairs (a, b) that reach percent, written. Each pair passes the suffix filter, coarse and fine, and is then compared once.

    The a of many pairs may have one b: texts of a travel to b's, not the other way round.
    """
    side = lambda s: cells.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), *[F.col(c).alias(f"{c}{s}") for c in _PARITY])
    near = _apart([f"{c}a" for c in _PARITY], [f"{c}b" for c in _PARITY], "na + nb", percent)
    once = pairs.withColumns({"_l": F.least("a", "b"), "_g": F.greatest("a", "b")}).dropDuplicates(["_l", "_g"]).select("a", "b")
    pairs = written(once.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b"), "near")
    nodes = lambda of: written(of.select(F.col("a").alias("_node")).union(of.select("b")).distinct(), "nodes")
    met = nodes(pairs)
    sets = written(_fine(_own(docs, met, most_broadcast), size), "sets")
    own = lambda s: sets.select(F.col("node").alias(s), F.col("m").alias(f"m{s}"), F.col("fine").alias(f"fine{s}"))

    def pass_fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True)
            keep = pa.array([unlike(x, y) <= _most_apart(m + n, percent) for m, n, x, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    with_cells = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "ma", "mb", "finea", "fineb")
    fine = written(with_cells.mapInArrow(pass_fine, "a bigint, b bigint").distinct(), "fine")
    left = nodes(fine)
    texts = lambda s: _own(docs, left, most_broadcast).select(F.col("doc_id").alias(s), F.coalesce("text", F.lit("")).cast("binary").alias(f"t{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([similar(x.as_py(), y.as_py(), size, percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    compared = fine.join(texts("a"), "a").join(texts("b"), "b").select("a", "b", "ta", "tb")
    links = written(compared.mapInArrow(run, "a bigint, b bigint").distinct(), "links")
    dropped(pairs, met, sets, fine, left)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node reachable, for the nodes of edges (a, b); written.

    Each round takes the least label of the neighbours and then the label of
    one's label; a round's labels are a table, so lineage stays short.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    spent = [labels]
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "comp": "c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        moved = written(step.join(jump, F.col("comp") == F.col("_n"), "left").select("node", "was", F.least("comp", "_c").alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if moved.where("was <> comp").isEmpty():
            dropped(both, *spent)
            return labels
        spent.append(moved)


def classes(docs: DataFrame, size: int = 3, percent: int = 90, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, and component_id for each row of docs (doc_id bigint, text)."""
    whole = signatures(docs, size, percent)
    reps = written(whole.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), *[F.first(c).alias(c) for c in _PARITY]), "classes")
    signed = written(whole.select("doc_id", "n", "f1", "f2"), "digests")
    dropped(whole)

    entries = reps.select("node", "n", F.posexplode("prefix").alias("pos", "shingle")).repartition("shingle")  # one exchange for both uses
    several = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("pos", "node", "n")).alias("_p")).where("_c > 1").select("shingle", *[F.col(f"_p.{c}").alias(f"pivot_{c}") for c in ("node", "n", "pos")])
    shared = written(entries.join(several, "shingle"), "entries")
    cells = written(reps.select("node", "n", "f1", "f2", "copies", *_PARITY), "cells")
    dropped(reps)

    # At the first common shingle, what the sets can still share must reach the overlap that percent asks of their sizes.
    reach = "least({x}n, {y}n) * 100 >= {p} * greatest({x}n, {y}n) AND least({x}n - {x}pos, {y}n - {y}pos) * (100 + {p}) >= {p} * ({x}n + {y}n)"
    first = shared.where("node <> pivot_node").where(reach.format(x="", y="pivot_", p=percent)).select(F.col("node").alias("a"), F.col("pivot_node").alias("b"))
    links = verified(docs, first, cells, size, percent, most_broadcast)
    parts = components(links)

    placed = written(shared.join(parts, "node", "left").select("shingle", "node", "n", "pos", F.coalesce("comp", "node").alias("comp")), "placed")
    dropped(shared)
    mixed = placed.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(F.col("shingle").alias("_s"))
    open_ = written(placed.join(mixed, F.col("shingle") == F.col("_s"), "left_semi"), "open")
    dropped(placed)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))) if percent < 100 else F.col("n")
    x = open_.withColumn("band", F.explode(F.array(band, band + 1))).alias("x")
    y = open_.withColumn("band", band).alias("y")
    second = x.join(y, F.expr("x.shingle = y.shingle AND x.band = y.band AND x.comp <> y.comp AND (x.n < y.n OR x.n = y.n AND x.node < y.node)")).where(reach.format(x="x.", y="y.", p=percent))
    more = verified(docs, second.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), cells, size, percent, most_broadcast)
    dropped(open_)
    if not more.isEmpty():
        parts = components(links.union(more))

    grouped = cells.select("f1", "f2", "node", "copies").join(parts, "node", "left").where("copies > 1 OR comp IS NOT NULL")
    named = written(grouped.select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.coalesce("comp", "node").alias("comp")), "named")
    dropped(cells, links, more)
    out = signed.join(named, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are not the least of their component; rows of one doc_id are one document. Rows with a null doc_id stay."""
    kept = classes(docs, size, percent)
    gone = written(kept.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    if gone.count() <= 2_000_000:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
