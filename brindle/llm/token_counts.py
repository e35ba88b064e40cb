"""Token counts: texts are encoded in batches inside an Arrow function, and only lengths come back.

Texts of more than PIECE_BYTES are split at safe boundaries: before a single
space between two letters or digits, where every vocabulary of the kinds
served here begins a token of its own. Texts and stretches of them in a row form
batches of about BATCH_BYTES bytes of UTF-8, so what is held at once does not
depend on how long texts are; a stretch without such a boundary stays whole.
A batch is split at all its safe boundaries, and its distinct pieces are encoded
together, by the vocabulary's library, without those whose lengths earlier batches
have shown: short ones are kept, up to a bound. The rows' counts are the sums over their pieces.

.json files are read by the tokenizers library, .model files by
sentencepiece. A vocabulary whose tokens may hold a space inside or take white
space beside them has no safe boundary, nor has a sentencepiece model that puts
no space in front of a text: texts stay whole.

Null counts as empty: no bytes, no tokens. Rows are independent; repeated
rows and empty tables need nothing special; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from brindle.llm.pieces import Pieces, kept, tokenizer

BATCH_BYTES = 512 << 10
PIECE_BYTES = 256 << 10
KEPT_CHARS = 64
BOUNDARY = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
BEFORE_SPACE = re.compile(r"(?= [^\W_])(?<=[^\W_])")
SPACE_INSIDE = re.compile(r"[A-Za-z0-9][ \u0120\u2581]")


def split(text: str, most: int = PIECE_BYTES, keep_space: bool = True) -> Iterator[str]:
    """The text, cut at the first boundary after every most bytes (counted as characters, of at most four bytes); a space that is cut at begins the next piece or goes."""
    at = 0
    while len(text) - at > most and (m := BOUNDARY.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start() if keep_space else m.end()
    yield text[at:] if at else text


class Counter:
    """Counts the tokens of texts with the library of a vocabulary file."""

    def __init__(self, path: str):
        self.keep_space = not path.endswith(".model")
        if self.keep_space:
            t = tokenizer(path)
            self.encode: Callable[[list[str]], list] = lambda batch: t.encode_batch_fast(batch, add_special_tokens=False)
            apart = t.encode_batch_fast(["a b", "a", " b"], add_special_tokens=False)
            added = t.get_added_tokens_decoder().values()
            inner = any(SPACE_INSIDE.search(x) for x in t.get_vocab()) or any(x.lstrip or x.rstrip for x in added)
            self.safe = not inner and apart[0].ids == apart[1].ids + apart[2].ids
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda batch: model.encode(batch, num_threads=1)
            inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            self.safe = not inner and model.encode("a b") == model.encode("a") + model.encode("b")

        self.known = Pieces(lambda batch: [len(x) for x in self.encode(batch)])

    def batches(self, texts: pa.Array, sizes: np.ndarray) -> Iterator[tuple[list[int], list[str]]]:
        """Rows and texts, or pieces of them, of about BATCH_BYTES in all."""
        rows, batch, size = [], [], 0
        for row, (text, n) in enumerate(zip(texts, sizes.tolist(), strict=True)):
            text = text.as_py()
            for piece in split(text, PIECE_BYTES, self.keep_space) if self.safe and n > PIECE_BYTES else (text,):
                n = len(piece) if piece.isascii() else len(piece.encode())
                if batch and size + n > BATCH_BYTES:
                    yield rows, batch
                    rows, batch, size = [], [], 0
                rows.append(row)
                batch.append(piece)
                size += n
        if batch:
            yield rows, batch

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text, null as empty."""
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.zeros(len(texts), np.int64)
        cut = (BEFORE_SPACE if self.keep_space else BOUNDARY).split if self.safe else lambda text: [text]
        for rows, batch in self.batches(texts, sizes):
            pieces = [cut(text) for text in batch]
            distinct = set().union(*pieces)
            known = self.known.learn(distinct)
            np.add.at(n, rows, [sum(map(known.__getitem__, own)) for own in pieces])
            for p in distinct:
                if len(p) > KEPT_CHARS:
                    del known[p]
        return sizes, n


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs; path is a vocabulary file that workers can open."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_tokens = kept(("counts", path), lambda: Counter(path))(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
