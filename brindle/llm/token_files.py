"""Token ids as flat binary files.

Each range of doc_ids becomes one part of three files: NAME.bin, all ids as
little-endian unsigned integers (16 bits while the vocabulary allows, else
32); NAME.idx, document offsets as 64-bit integers, one more than documents;
NAME.doc, the doc_ids as 64-bit integers. A table lists the parts that
successful tasks wrote; the first token of a part follows by a prefix sum
over it, and manifest.json holds all. Attempts write under names of their
own, so a repeated task never touches another's files. Readers memory-map the
parts (files that are not local are read by block).

Null text counts as empty: only the end id. Rows of one doc_id follow each
other by text; null doc_ids come first. An empty table gives no part. Extra
columns are left out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import shared_path, written
from brindle.llm.pieces import Memo, kept, merge_one, runs, tokenizer

CHUNK_BYTES = 8 << 20
MOST_WORDS = 600_000
PART = "part int, file string, n_docs bigint, n_null bigint, n_tokens bigint, width int"


def pack_format(kind: str) -> str:
    return "<H" if kind == "<u2" else "<I"


def encoder(path: str, kind: str):
    """A function from texts to (ids of each text as counts, ids of all as an array of kind).

    Byte-level tokens hold a space only in front, so a text falls apart before
    each single space between two other characters, and around each single
    line end between two. The texts' words are numbered by Arrow, and each
    distinct one is looked up once. A text with more white space side by side
    is encoded whole.
    """
    t = tokenizer(path)
    one, tokenize = merge_one(t), t.model.tokenize
    form = pack_format(kind)
    spelled = [pack(form, i) for i in range(t.get_vocab_size(with_added_tokens=True))]
    packed = lambda ids: b"".join([spelled[i] for i in ids])
    marks = {m: packed(one(m)) for m in map(chr, range(0x21, 0x7F)) if not m.isalnum() and m != "'"}

    def maker(space: str, letters: str):
        def made(w: str) -> bytes | None:
            """The ids of a word; None for one with white space at an end, or none at all."""
            if w.isascii():
                if w.isalpha():
                    return b"".join([spelled[x.id] for x in tokenize(letters + w)])
                if w[-1:] in marks and w[:-1].isalpha():
                    return memo[w[:-1]] + marks[w[-1]]
            return packed(one(space + w)) if w and not w[0].isspace() and not w[-1].isspace() else None

        memo = Memo(made, MOST_WORDS)
        return memo

    later, first = maker(" ", "\u0120"), maker("", "")  # words after a space, words at the start of a line
    end = packed(one("\n"))

    def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        later.rest()
        first.rest()
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        line_at = words.offsets.to_numpy().astype(np.int64)  # the first word of each line, and one more
        text_at = line_at[lines.offsets.to_numpy()]
        coded = words.flatten().dictionary_encode()
        # A word and its place: 0 after a space, 1 first of a text, 2 first of another line.
        code = coded.indices.to_numpy().astype(np.int64) * 3
        code[line_at[:-1]] += 2
        code[text_at[:-1]] -= 1
        seen = np.zeros(3 * len(coded.dictionary), bool)
        seen[code] = True
        used = np.flatnonzero(seen)
        known = np.zeros(len(seen), np.int32)
        known[used] = np.arange(len(used))
        values = coded.dictionary.to_numpy(zero_copy_only=False)[used // 3].tolist()
        made, odd = [], np.zeros(len(used), bool)
        for i, (w, place) in enumerate(zip(values, (used % 3).tolist(), strict=True)):
            m = first[w] if place else later[w]
            if m is None:
                odd[i], m = True, b""
            made.append(end + m if place == 2 else m)
        # Counts and places stay below 2^31, as an Arrow text does.
        size = np.fromiter(map(len, made), np.int32, len(made)) // np.dtype(kind).itemsize
        ids = np.frombuffer(b"".join(made), kind)
        start = np.cumsum(size, dtype=np.int32) - size
        word = known[code]
        n = size[word]
        at = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=at[1:])
        out = ids[np.arange(at[-1], dtype=np.int32) + np.repeat(start[word] - at[:-1], n)]
        bounds = at[text_at]
        whole = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(odd[word])])[text_at])).tolist()
        if not whole:
            return np.diff(bounds).astype(np.int64), out
        parts = [out[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        for i in whole:
            parts[i] = np.array(t.encode(texts[i].as_py(), add_special_tokens=False).ids, kind)
        return np.array([len(p) for p in parts], np.int64), np.concatenate(parts)

    return of


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2) -> DataFrame:
    """Writes the parts under folder (a URI that executors reach); returns the table of parts with each part's first token."""
    spark = docs.sparkSession
    kind = "<u2" if max(tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, of, out = context.partitionId(), None, None
        file = f"{folder}/part-{part:06d}-{context.taskAttemptId()}"
        n_null, sizes, ids = 0, [], []
        for batch in batches:
            if out is None:
                where, root = fs.FileSystem.from_uri(folder)
                where.create_dir(root, recursive=True)
                name = f"{root}/{file.rpartition('/')[2]}"
                of, out = kept(("files", path, kind), lambda: encoder(path, kind)), where.open_output_stream(f"{name}.bin")
            n_null += batch.column(0).null_count
            ids.append(batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for texts in runs(batch.column(1), CHUNK_BYTES):
                n, made = of(texts)
                sizes.append(n + 1)
                out.write(np.insert(made, np.cumsum(n), end_id).astype(kind).tobytes())
        if out is not None:
            out.close()
            size = np.concatenate([np.zeros(1, "<i8"), *sizes])
            for tail, values in (("idx", np.cumsum(size)), ("doc", np.concatenate(ids))):
                with where.open_output_stream(f"{name}.{tail}") as f:
                    f.write(values.astype("<i8").tobytes())
            row = [[part], [file], [len(size) - 1], [n_null], [int(size.sum())], [np.dtype(kind).itemsize]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["part", "file", "n_docs", "n_null", "n_tokens", "width"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(written(ordered.mapInArrow(store, PART), "parts").collect())  # one row for each file
    base = np.concatenate([[0], np.cumsum([p.n_tokens for p in parts])]).astype(int).tolist()
    rows = [(*p, b) for p, b in zip(parts, base, strict=False)]
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"dtype": kind, "end_id": end_id, "n_tokens": base[-1], "parts": [dict(p.asDict(), base=b) for p, b in zip(parts, base, strict=False)]}).encode())
    return spark.createDataFrame(rows, f"{PART}, base bigint")


class _Numbers:
    """A file of numbers: memory-mapped where it is local, else read by the stretch that is asked for."""

    def __init__(self, uri: str, kind: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.kind, self.map = np.dtype(kind), None
        if isinstance(where, fs.LocalFileSystem):
            self.map = np.memmap(path, kind, "r") if where.get_file_info(path).size else np.zeros(0, kind)
        else:
            self.file = where.open_input_file(path)

    def __getitem__(self, s: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[s]
        w = self.kind.itemsize
        return np.frombuffer(self.file.read_at((s.stop - s.start) * w, s.start * w), self.kind)


def _crc32(ids: _Numbers, start: int, stop: int) -> int:
    """Of ids as 32-bit integers, a bounded stretch at a time."""
    crc = 0
    for a in range(start, stop, CHUNK_BYTES):
        crc = zlib.crc32(ids[a : min(a + CHUNK_BYTES, stop)].astype("<u4").tobytes(), crc)
    return crc


def read(parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (with the end id) and ids_crc32 of every document in the parts."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                ids = _Numbers(f"{p['file']}.bin", f"<u{p['width']}")
                at, doc = _Numbers(f"{p['file']}.idx", "<i8"), _Numbers(f"{p['file']}.doc", "<i8")
                for k in range(0, p["n_docs"], 10_000):
                    cut = at[k : min(k + 10_000, p["n_docs"]) + 1].tolist()
                    crc = [_crc32(ids, a, b) for a, b in zip(cut, cut[1:], strict=False)]
                    own = np.arange(k, k + len(crc)) < p["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[k : k + len(crc)], pa.int64(), mask=own), pa.array([p["base"] + a for a in cut[:-1]], pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return parts.repartition(max(1, min(parts.count(), 100_000))).mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    return read(write(docs, shared_path(spark, "tokens"), path, end_id))
