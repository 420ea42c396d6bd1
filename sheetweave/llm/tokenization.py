"""Encoding of whole Arrow batches with a public tokenizer, each distinct piece of text once per batch."""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded at a time, pieces given to the tokenizer at a time, pieces remembered from slice to slice.
SLICE_BYTES, SUB_BATCH, REMEMBERED = 4_000_000, 5_000, 300_000
#: Where a byte-level text may be cut without changing its ids: before a lone space between two non-blank characters.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
# How vocabularies write a space before a word, and a word's end.
SPACE, WORD_END = "Ġ", "</w>"
#: A piece whose ends are blank, but for one space before it, in any script.
OTHER = r"\t\n\f\r\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
AWKWARD = f"^ ?$|^ [ {OTHER}]|^[{OTHER}]|[ {OTHER}]$"
#: Words encoded as one text.
WORDS = 500
#: What stands between pieces while a text is cut; texts that hold it themselves are cut by SAFE_CUT. Letters after
#: which a full stop or comma begins a new piece.
MARK, LETTER = "\x1f", "[A-Za-zÀ-ÖØ-öø-ÿ]"


@lru_cache(maxsize=4)
def load(path: str, spaced: bool):
    """(tokenizer, whether each id begins (`spaced`) or ends a word), once for each worker process, on its own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    edge = np.zeros(max(vocabulary.values()) + 1, bool)
    edge[[i for t, i in vocabulary.items() if (t.startswith(SPACE) if spaced else t.endswith(WORD_END))]] = True
    return tokenizer, edge


def release() -> None:
    """Give memory that a task no longer needs back to the system: worker processes stay for the tasks after it."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def own_rows(texts: pa.Array, start: int, end: int) -> pa.Array:
    """Rows as an array of its own buffers, nulls as empty: string functions of Arrow misread offsets that do not begin at 0."""
    return pc.fill_null(texts.take(pa.array(range(start, end), pa.int64())).cast(pa.large_string()), "")


class BatchEncoder:
    """ids of texts as one flat array and a count per text.

    Both kinds of tokenizer never join a word with a space, a line feed, a full stop or a comma on its other side, so
    texts are cut there and equal pieces are encoded once while they are remembered. With `spaced` (byte-level
    vocabularies) a piece keeps the space before it, and texts whose blanks meet other blanks take the slower regular
    expression SAFE_CUT, which leaves these places whole.
    """

    def __init__(self, path: str, spaced: bool):
        (self.tokenizer, self.edge), self.spaced = load(path, spaced), spaced
        self.plain = ("^ " if spaced else "^") + LETTER + "+$"
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _encode_each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(counts.sum())), counts

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words as few texts, told apart again by the ids that end (or, with `spaced`, begin) a word."""
        groups = [words[a : a + WORDS] for a in range(0, len(words), WORDS)]
        flat, counts = self._encode_each([("" if self.spaced else " ").join(g) for g in groups])
        edge = np.flatnonzero(self.edge[flat])
        if len(edge) != len(words):
            return self._encode_each(words)
        return flat, np.diff(np.append(edge, len(flat)) if self.spaced else np.append(-1, edge))

    def _ids(self, pieces: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces that are remembered, where each given piece's ids start, how many they are); `plain` marks
        pieces that are words of LETTERs."""
        if len(self.places) > REMEMBERED:
            self._forget()
        known, new = self.places, ([], [])
        for piece, word in zip(pieces, plain.tolist(), strict=True):
            if piece not in known:
                new[word].append(piece)
        rest, words = list(dict.fromkeys(new[False])), new[True]
        flats, counts = [self.flat], [self.lengths]
        for encode, some in ((self._encode_words, words), (self._encode_each, rest)):
            for a in range(0, len(some), SUB_BATCH):
                flat, own = encode(some[a : a + SUB_BATCH])
                flats.append(flat)
                counts.append(own)
        known.update(zip(chain(words, rest), range(len(self.lengths), len(self.lengths) + len(words) + len(rest)), strict=True))
        self.flat, self.lengths = np.concatenate(flats), np.concatenate(counts)
        at = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        return self.flat, (np.cumsum(self.lengths) - self.lengths)[at], self.lengths[at]

    def slices(self, texts: pa.Array):
        """(first, last, ids, counts) for consecutive runs of the texts, nulls as empty."""
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
            yield at, end, *self._encode(own_rows(texts, at, end))
            at = end

    def close(self) -> None:
        self._forget()
        release()

    def _pieces(self, texts: pa.Array):
        """(list array of pieces, whether each text must be cut by SAFE_CUT instead)."""
        if not self.spaced:
            # blanks are dropped and case is folded anyway, but not where names of special tokens may stand
            lower = texts if pc.any(pc.match_substring(texts, "<|")).as_py() else pc.ascii_lower(texts)
            return pc.split_pattern_regex(pc.replace_substring_regex(lower, f"({LETTER})([.,])", r"\1 \2"), "[ \n]"), None
        marked = pc.replace_substring_regex(texts, f"({LETTER})([.,])", rf"\1{MARK}\2")
        marked = pc.replace_substring(pc.replace_substring(marked, " ", f"{MARK} "), "\n", f"{MARK}\n{MARK}")
        return pc.split_pattern(marked, MARK), np.asarray(pc.match_substring(texts, MARK))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, slow = self._pieces(texts)
        bounds = np.asarray(parts.offsets) - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        index, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
        plain = np.asarray(pc.match_substring_regex(coded.dictionary, self.plain))
        spans = {}
        if slow is not None:
            awkward = np.asarray(pc.match_substring_regex(coded.dictionary, AWKWARD)) & ~np.asarray(pc.equal(coded.dictionary, "\n"))
            slow = np.flatnonzero(slow | (np.add.reduceat(awkward[index], bounds[:-1]) > 0)) if len(index) else np.zeros(0, np.int64)
            for k in slow.tolist():
                cut = SAFE_CUT.split(texts[k].as_py())
                spans[k] = (len(words), len(cut))
                words += cut
            plain = np.concatenate([plain, np.zeros(len(words) - len(plain), bool)])
        flat, starts, lengths = self._ids(words, plain)
        if spans:
            runs, counts, last = [], np.diff(bounds), 0
            for k, (a, n) in spans.items():
                runs += [index[bounds[last] : bounds[k]], np.arange(a, a + n)]
                counts[k], last = n, k + 1
            index = np.concatenate([*runs, index[bounds[last] :]])
            bounds = np.concatenate([[0], np.cumsum(counts)])
        each = lengths.astype(np.int32)[index]
        ends = np.cumsum(each, dtype=np.int32 if len(index) < 1 << 24 else np.int64)
        ids = flat[np.repeat(starts.astype(ends.dtype)[index] - (ends - each), each) + np.arange(int(each.sum()), dtype=ends.dtype)]
        total = np.concatenate([[0], ends])
        return ids, total[bounds[1:]] - total[bounds[:-1]]
