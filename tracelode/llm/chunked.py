"""Whole texts to token ids, through a bounded cache of the chunks between blanks.

A text is cut where no pre-token can reach across the cut, each distinct chunk is encoded once for as long as
the cache holds it, and the ids of a text are gathered from the store. The ids are those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT, ragged

_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space other than one blank or line feed between two other characters: such texts are cut by _SAFE_CUT.
#: The control and Unicode separators stand here as Python's str.isspace() has them.
_ODD_SPACE = "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x00]|[ \\n][ \\n]|^[ \\n]|[ \\n]$"


def byte_level_chunks(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks and their number by text, for patterns whose pre-tokens hold a blank only in front.

    A text where each white space stands alone between other characters is cut before each blank and around
    each line feed; any other text only before a lone blank between two other characters.
    """
    odd = pc.match_substring_regex(text, _ODD_SPACE).to_numpy(zero_copy_only=False)
    plain = text.filter(pa.array(~odd)) if odd.any() else text
    cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
    counts = np.zeros(len(text), np.int64)
    counts[~odd] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    if not odd.any():
        return cut.flatten(), counts
    hard = [_SAFE_CUT.split(x) for x in text.filter(pa.array(odd)).to_pylist()]
    counts[odd] = [len(x) for x in hard]
    both = pa.concat_arrays([cut.flatten(), pa.array([y for x in hard for y in x], text.type)])
    first = np.zeros(len(text), np.int64)
    first[~odd] = np.cumsum(counts[~odd]) - counts[~odd]
    first[odd] = len(cut.flatten()) + np.cumsum(counts[odd]) - counts[odd]
    return both.take(pa.array(ragged(first, counts))), counts


#: Outside these characters composition and case can depend on neighbours.
_NOT_LATIN = "[^ -~\\n\\x{a1}-\\x{ff}]"
#: Marks between a letter and a blank. An apostrophe can belong to what follows.
_MARKS_AFTER = "([a-z\\x{df}-\\x{f6}\\x{f8}-\\x{ff}])([!-&(-/:-@\\[-`{-~]+ )"


def blank_chunks(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks between blanks and line feeds, for tokenizers that drop white space; a chunk may be empty."""
    cut = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
    return cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)


def lower_chunks(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As blank_chunks, for tokenizers that lower-case words and keep letters and marks apart: texts of Latin letters give lower-case chunks, without the marks behind them, which are chunks of their own."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.replace_substring(text, "\n", " ")), _MARKS_AFTER, "\\1 \\2")
    return blank_chunks(pc.if_else(pc.match_substring_regex(text, _NOT_LATIN), text, plain))


#: Unseen chunks that are Python strings, and their ids Python numbers, at a time.
ENCODE_CHUNKS = 20_000


class ChunkCache:
    """encode: chunks to their ids, one after the other, and the number of each; cut: a string array to chunks and counts; most: chunks that are kept."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut: Callable, most: int = 600_000):
        self.encode, self.cut, self.most = encode, cut, most
        self._clear()

    def _clear(self) -> None:
        self.known: list[pa.Array] = []
        self.known_n = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _add(self, chunks: pa.Array) -> None:
        parts = [self.encode(chunks.slice(i, ENCODE_CHUNKS).to_pylist()) for i in range(0, len(chunks), ENCODE_CHUNKS)]
        found, lengths = (np.concatenate([np.zeros(0, np.int64), *p]) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        total = len(found)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while self.known_n + len(lengths) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
            self.length = np.concatenate([self.length, np.zeros(len(self.length), np.int64)])
        self.ids[self.used : self.used + total] = found
        here = slice(self.known_n, self.known_n + len(lengths))
        self.start[here] = self.used + np.cumsum(lengths) - lengths
        self.length[here] = lengths
        self.used += total
        self.known = [pa.concat_arrays([*self.known, chunks])]
        self.known_n += len(lengths)

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        chunks, counts = self.cut(text)
        coded = chunks.dictionary_encode()
        if self.known_n > self.most:
            self._clear()
        at = pc.index_in(coded.dictionary, value_set=self.known[0]) if self.known else None
        if at is None or at.null_count:
            self._add(coded.dictionary if at is None else coded.dictionary.filter(pc.is_null(at)))
            at = pc.index_in(coded.dictionary, value_set=self.known[0])
        code = at.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.length[code]
        ids = self.ids[ragged(self.start[code], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)


_CACHES: dict[tuple, ChunkCache] = {}
KEPT.append(_CACHES)


def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def largest_id(path: str) -> int:
    """The largest id of a file of the tokenizers library."""
    return max(_tokenizer(path).get_vocab(with_added_tokens=True).values(), default=0)


def whole_where(marks: list[str], cut: Callable) -> Callable:
    """As cut, but a text that holds one of some strings (in any case) is one chunk."""
    if not marks:
        return cut
    pattern = "(?i)" + "|".join(re.escape(m) for m in sorted(marks))

    def run(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
        marked = pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False).astype(bool)
        if not marked.any():
            return cut(text)
        chunks, counts = cut(text.filter(pa.array(~marked)))
        every = np.ones(len(text), np.int64)
        every[~marked] = counts
        first = np.zeros(len(text), np.int64)
        first[~marked] = np.cumsum(counts) - counts
        first[marked] = len(chunks) + np.arange(int(marked.sum()))
        both = pa.concat_arrays([chunks, text.filter(pa.array(marked)).cast(chunks.type)])
        return both.take(pa.array(ragged(first, every))), every

    return run


#: Stands between chunks that are encoded as one text, with a blank on both sides.
MARK = "\1"


def joined(ids_of: Callable[[str], list[int]], one_by_one: Callable, alone: list[str]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of chunks and their number by chunk, for tokenizers that drop white space: many chunks are one text, with MARK as a word between them.

    The library's cost is that of a call and a text more than that of a word. Chunks that hold MARK or one of the strings `alone` are encoded by themselves, as
    all are where MARK is not one id, which no other character then has a part in.
    """
    mark = ids_of(MARK)
    apart = re.compile("|".join(re.escape(m) for m in sorted([MARK, *alone])), re.IGNORECASE)

    def run(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(mark) != 1 or any(map(apart.search, chunks)):
            return one_by_one(chunks)
        parts = [np.array(ids_of(f" {MARK} ".join([*chunks[i : i + 1000], ""])), np.uint32) for i in range(0, len(chunks), 1000)]
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])
        ends = np.flatnonzero(ids == mark[0])
        if len(ends) != len(chunks):
            raise ValueError(f"{len(chunks)} chunks became {len(ends)}")
        return ids[ids != mark[0]], np.diff(ends, prepend=-1) - 1

    return run


def library_cache(path: str, byte_level: bool, special: bool = True) -> ChunkCache:
    """The cache of this Python worker for a file of the tokenizers library.

    special: strings of special tokens in a text become their ids, which is the library's default; else they are ordinary text. Texts that hold
    an added token are given to the library whole.
    """
    if (path, byte_level, special) not in _CACHES:
        tokenizer = _tokenizer(path)
        tokenizer.encode_special_tokens = not special
        marks = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content and (special or not t.special)]

        def one_by_one(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [x.ids for i in range(0, len(chunks), 1000) for x in tokenizer.encode_batch_fast(chunks[i : i + 1000], add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths

        def ids_of(text: str) -> list[int]:
            return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

        folds = not byte_level and ids_of("Ab, \xc9!") == ids_of("ab , \xe9 !")
        cut = byte_level_chunks if byte_level else lower_chunks if folds else blank_chunks
        encode = one_by_one if byte_level else joined(ids_of, one_by_one, marks)
        _CACHES[path, byte_level, special] = ChunkCache(encode, whole_where(marks, cut))
    return _CACHES[path, byte_level, special]


#: Text bytes of one call: the cache's table of chunks is built anew for each.
CHUNK_SLICE = 4 << 20
