"""BPE encoding and decoding by a transducer lexicon.

Words (runs without white space, which no token of the vocabulary crosses)
of at most 64 characters are counted over all texts, each task sending the
sums of all its words; the most_words most frequent ones are encoded by
their exact merges and compiled into the memory-mapped automaton of
lexicon.py, which the driver writes to the shared folder and hands to the
executors as a Spark file. A
batch's distinct words are looked up together; words that the lexicon lacks
are merged exactly by the vocabulary's own merge rules. Words met fewer than
least_count times in all texts stay out of the lexicon; that decides only how
a word's ids are found, never what they are.

Null counts as empty: no ids, and the decoded text is empty. Rows are
independent; repeated rows and empty tables need nothing special; extra
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import shared_path, written
from brindle.llm.lexicon import Lexicon, build, packed
from brindle.llm.pieces import Pieces, chunks, kept, merger, runs, spaced, tokenizer

COUNT_BYTES = 4 << 20
MERGED = 32
_MAPPED: dict[str, Lexicon] = {}
_ADDED: set[tuple[str, str]] = set()


def frequent_words(docs: DataFrame, most_words: int, least_count: int) -> list[str]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if len(w) <= 64]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for texts in runs(batch.column(0), COUNT_BYTES):
                # Arrow's white space may differ in rare characters from the vocabulary's: that can only leave a word out of the lexicon.
                counts = pc.value_counts(pc.utf8_split_whitespace(texts).flatten())
                words, n = (counts.field(k).to_numpy(zero_copy_only=False).tolist() for k in (0, 1))
                for w, k in zip(words, n, strict=True):
                    seen[w] += k
                if len(seen) > 1_000_000:
                    yield out()
        yield out()

    counted = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # One task merges the first words of MERGED others, and the driver reads most_words rows, whatever the input.
    few = written(counted.where(F.col("n") >= least_count).repartition(MERGED).orderBy(F.desc("n"), "word").limit(most_words), "words")
    return [r.word for r in sorted(few.collect(), key=lambda r: (-r.n, r.word))]


def compiled(docs: DataFrame, path: str, most_words: int = 60_000, least_count: int = 8) -> str:
    """The name of the Spark file with the lexicon for docs."""
    words = frequent_words(docs, most_words, least_count)
    ids = [e.ids for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)] if words else []
    content = packed(build({w.encode(): i for w, i in zip(words, ids, strict=True)}))
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:24]}"
    context = docs.sparkSession.sparkContext
    if (context.applicationId, name) not in _ADDED:  # a name stands for its content, and can be added once
        folder = shared_path(docs.sparkSession, "lexicon")
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{name}") as f:
            f.write(content)
        context.addFile(f"{folder}/{name}")
        _ADDED.add((context.applicationId, name))
    return name


def encoder(path: str, name: str):
    """A function from texts to arrays of ids."""
    file = SparkFiles.get(name)
    if file not in _MAPPED:
        _MAPPED[file] = Lexicon(file)
    lexicon, merged = _MAPPED[file], merger(tokenizer(path))

    flat = lexicon.ids.data.cast("B")

    def make(batch: list[str]) -> list[bytes]:
        places = lexicon.places([w.encode() for w in batch])
        out: list = [None] * len(batch)
        seen = np.flatnonzero(places >= 0)
        at = places[seen]
        for i, a, b in zip(seen.tolist(), (4 * lexicon.start[at]).tolist(), (4 * lexicon.start[at + 1]).tolist(), strict=True):
            out[i] = flat[a:b]
        unseen = np.flatnonzero(places < 0).tolist()
        for i, ids in zip(unseen, merged([batch[i] for i in unseen]), strict=True):
            out[i] = pack(f"<{len(ids)}I", *ids)
        return out

    pieces = Pieces(make, 100_000)

    def of(texts: list[str]) -> list[bytes]:
        cut = [spaced(x) for x in texts]
        known = pieces.learn(set().union(*cut))
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    return of


def decoder(path: str):
    """A function from ids to the text that the vocabulary's decode() gives: it names no decoder, so tokens are joined by spaces."""
    t = tokenizer(path)
    if t.decoder is not None:
        return lambda ids: t.decode(ids.tolist(), skip_special_tokens=False)
    token = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
    return lambda ids: " ".join(map(token.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, path: str, most_words: int = 60_000, digests: bool = True) -> DataFrame:
    """For each row of docs doc_id and n_tokens, with digests of the ids and of the decoded text or, without digests, both themselves (ids, decoded)."""
    name = compiled(docs, path, most_words)
    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = decode = None
        for batch in batches:
            encode, decode = encode or encoder(path, name), decode or kept(("text", path), lambda: decoder(path))
            texts = batch.column(1).to_pylist()
            for at, part in chunks(texts):
                ids = encode(part)
                n = [len(x) // 4 for x in ids]
                back = [decode(np.frombuffer(x, "<u4")) for x in ids]
                if digests:
                    more = [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())]
                else:
                    more = [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), *more], ["doc_id", "n_tokens", *[c.split()[0] for c in kind.split(", ")]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, {kind}")
