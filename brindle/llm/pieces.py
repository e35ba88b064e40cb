"""Encoding by pieces: a text is cut where no token can cross, and each distinct piece is encoded once.

Batches of pieces are balanced by bytes, so memory does not depend on how
long a text is; the memory of known pieces has a bound, beyond which
those go that were not met again.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 20
CHUNK_CHARS = 2 << 20
MOST_PIECES = 400_000

_LOADED: dict[object, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, once for each worker process. Without truncation and padding."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].no_truncation()
        _LOADED[path].no_padding()
    return _LOADED[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def by_bytes(pieces: Iterable[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    batch, size = [], 0
    for p in pieces:
        batch.append(p)
        size += len(p) + 16
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about most characters. Null counts as empty."""
    at, batch, size = 0, [], 0
    for i, t in enumerate(texts):
        batch.append(t or "")
        size += len(batch[-1]) + 64
        if size >= most:
            yield at, batch
            at, batch, size = i + 1, [], 0
    if batch:
        yield at, batch


def runs(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of texts of about most bytes; a longer text is a slice of its own. Null counts as empty."""
    texts = texts.fill_null("")
    group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for start, stop in zip(cuts, cuts[1:], strict=False):
        if stop > start:
            yield texts.slice(start, stop - start)


def spaced(text: str) -> list[str]:
    """Words between white space, as the word vocabulary's normaliser and splitter see it."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # split() takes these for white space, the vocabulary does not
        return [w for w in re.split(r"[\t-\r \x85\xa0  -     　]+", text) if w]
    return text.split()


class Pieces:
    """What a function makes of pieces, kept by piece in two generations of at most about most each."""

    def __init__(self, make: Callable[[list[str]], list], most: int = MOST_PIECES):
        self.make, self.most, self.known, self.old = make, most, {}, {}

    def learn(self, pieces: set[str]) -> dict:
        """A dict that has all of pieces."""
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        new = pieces.difference(self.known)  # "pieces - keys()" would go through all known ones
        for p in new & self.old.keys():
            self.known[p] = self.old[p]
        for batch in by_bytes(new.difference(self.old)):
            self.known.update(zip(batch, self.make(batch), strict=True))
        return self.known


def kept(key: tuple, make: Callable[[], object]):
    """What make() gives, once for each worker process and key: known pieces stay from task to task."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


#: A word of Latin-1 letters, with a space in front or a run of ASCII marks but ' behind: pieces whose split is plain.
PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
MOST_MARKS = 10_000


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo(dict):
    """What a function makes of a piece, made when first asked for; one generation of at most about most pieces is kept besides the present one."""

    def __init__(self, make: Callable[[str], object], most: int = MOST_PIECES):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str):
        made = self[piece] = self.old[piece] if piece in self.old else self.make(piece)
        return made

    def rest(self) -> None:
        """Called between batches: starts a new generation when the present one is full."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def merge_one(t) -> Callable[[str], list[int]]:
    """A function from a piece to its ids by the merge rules of tokenizer t.

    Plain words go straight to the merges; other pieces take the whole way
    through normaliser, splitter and merges.
    """
    gc.disable()  # nothing here is circular, and the many small lists would set it off again and again
    tokenize, letters = t.model.tokenize, byte_letters()
    small = t.normalizer is not None  # the word vocabulary's puts letters in lower case, and its splitter drops spaces
    marks = Memo(lambda mark: t.encode(mark, add_special_tokens=False).ids, MOST_MARKS)
    match = PLAIN.fullmatch

    def one(piece: str) -> list[int]:
        if not (m := match(piece)):
            return t.encode_batch_fast([piece], add_special_tokens=False)[0].ids
        space, word, mark = m.groups()
        if small:
            word, space = word.lower(), ""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(letters)
        ids = [x.id for x in tokenize("\u0120" + word if space else word)]
        if mark:
            marks.rest()
            ids += marks[mark]
        return ids

    return one


def merger(t) -> Callable[[list[str]], list[list[int]]]:
    """merge_one() for many pieces at once."""
    one, match = merge_one(t), PLAIN.fullmatch

    def of(batch: list[str]) -> list[list[int]]:
        out: list = [one(p) if match(p) else None for p in batch]
        other = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(other, t.encode_batch_fast([batch[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    return of
