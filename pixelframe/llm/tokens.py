"""Token ids of whole texts, with the ids of recurring words kept for reuse."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from pixelframe.llm.arrow_text import pieces, text_bytes

#: White space beyond ASCII, first by bytes that are quick to look for.
_WIDE_HINTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_PLAIN = re.compile("([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")
#: The letters that stand for bytes that aren't printable ASCII or Latin-1 in byte-level vocabularies, by their rule: in order, from 256 on.
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


def default_path(name: str) -> str:
    """A public vocabulary file's place on this machine; each task asks its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache:
    """Encodes texts piecewise where that gives the same ids as whole.

    Both kinds of tokenizer here end a pre-token wherever white space begins after other characters, so a text falls
    into segments (white space, then a word) that don't influence each other. Segments recur; their ids are kept, a
    bounded number of them. Byte-level texts with white space beyond ASCII are one segment, since a run of it could be
    cut in two otherwise, and so are texts that hold the string of a special token, which is that token's id as the
    tokenizer encodes it by itself. With special_as_text such strings are ordinary text.
    """

    def __init__(self, path: str, most_words: int = 1_200_000, longest: int = 64, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        names = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # any case, as some tokenizers look for them in lowered texts
        self.special = re.compile("|".join(map(re.escape, names)).encode(), re.IGNORECASE) if names else None
        pre = (json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}).get("type")
        self.kind = {"ByteLevel": "spaced", "Sequence": "words"}.get(pre, "whole")
        self.model = self.tokenizer.model
        if self.kind != "whole":
            self.marks = {mark: [t.id for t in self.model.tokenize(mark)] for mark in ".,"}
            self.line_end = [t.id for t in self.model.tokenize("\u010a")]
            vocabulary = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that begin with a blank or a line end
            self.opens[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True
        self.most, self.longest = most_words, longest
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)  # ids of all known segments end to end
        self.ends = np.zeros(1 << 15, np.int64)  # where each segment's end; the first is the end id alone
        self.ids[0], self.ends[1], self.n = 0, 1, 1

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where segments begin: at white space after other characters, and where a text begins."""
        start = np.zeros(len(data), bool)
        if self.kind != "whole":
            space = self.space[data]
            start[1:] = space[1:] & ~space[:-1]
        raw = data.tobytes()
        if self.special and self.special.search(raw):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if self.special.search(raw, a, b):
                    start[a:b] = False
        if self.kind == "spaced":
            if any(h in raw for h in _WIDE_HINTS):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = raw[a:b]
                    if any(h in text for h in _WIDE_HINTS) and _WIDE.search(text.decode()):
                        start[a:b] = False
        firsts = offsets[:-1]
        start[firsts[firsts < offsets[1:]]] = True
        return np.flatnonzero(start)

    def _plain(self, word: str) -> list[int] | None:
        """The ids of a plain segment from the tokenizer's model itself; None if the segment isn't plain.

        Plain: at most one blank or line end, Latin letters, at most one full stop or comma. Normalisation only lowers
        such letters (if anything), and pre-tokens are the line end, the letters with a blank before them, the mark.
        """
        m = _PLAIN.fullmatch(word)
        if not m:
            return None
        space, letters, mark = m.groups()
        if self.kind == "words":
            head, letters = "", letters.lower()
        else:
            head = "\u0120" if space == " " else ""  # a blank belongs to its word
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(head + letters)]
        if space == "\n" and self.kind == "spaced":
            ids = self.line_end + ids
        return ids + self.marks[mark] if mark else ids

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """For byte-level vocabularies: which segments were encoded end to end, their ids, and how many each has.

        These are the segments whose only white space is one blank or line end at their start. Side by side they fall
        into the same segments again, and a token that begins with white space begins a segment.
        """
        raw = b"".join(words)
        if self.special and self.special.search(raw):
            return None
        size = np.fromiter(map(len, words), np.int64, len(words))
        data, start = np.frombuffer(raw, np.uint8), np.cumsum(size) - size
        simple = ((data[start] == 32) | (data[start] == 10)) & (np.add.reduceat(self.space[data].view(np.uint8), start, dtype=np.int64) == 1)
        if any(h in raw for h in _WIDE_HINTS):
            simple &= ~np.fromiter((any(h in w for h in _WIDE_HINTS) for w in words), bool, len(words))
        some = [words[i] for i in np.flatnonzero(simple).tolist()]
        texts = [b"".join(some[i : i + 256]).decode() for i in range(0, len(some), 256)]
        ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        begins = np.flatnonzero(self.opens[ids])
        if len(begins) != len(some) or (len(ids) and not self.opens[ids[0]]):
            return None
        return simple, ids, np.diff(np.append(begins, len(ids)))

    def _add(self, words: list[bytes]) -> None:
        together = self._together(words) if self.kind == "spaced" else None
        alone = words if together is None else [words[i] for i in np.flatnonzero(~together[0]).tolist()]
        texts = [w.decode() for w in alone]
        lists = [self._plain(w) for w in texts] if self.kind != "whole" else [None] * len(texts)
        rest = [i for i, x in enumerate(lists) if x is None]
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            lists[i] = x.ids
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        if together is not None:
            simple, ids_of, sizes_of = together
            each = np.empty(len(words), np.int64)
            each[simple], each[~simple] = sizes_of, sizes
            both, of = np.empty(int(each.sum()), np.uint32), np.repeat(simple, each)
            both[of], both[~of] = ids_of, ids
            ids, sizes = both, each
        ends = self.ends[self.n] + np.cumsum(sizes)
        need = self.n + len(words) + 1
        if need > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(need, np.int64)])
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(int(ends[-1]), np.uint32)])
        self.ids[self.ends[self.n] : ends[-1]] = ids
        self.ends[self.n + 1 : need] = ends
        self.known.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (bytes end to end, starts with the last end), each with the end id, end to end; and where
        each text's begin, with the end of the last."""
        starts = self._starts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = cut.dictionary_encode()
        raw, at = coded.dictionary.buffers()[2], np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(coded.dictionary) + 1)
        raw, at = raw.to_pybytes() if raw else b"", at.tolist()
        words = [raw[a:b] for a, b in zip(at, at[1:])]
        number = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(number < 0)
        if self.n + len(new) > self.most:
            self._clear()
            new = np.arange(len(words))
        if len(new):
            number[new] = self.n + np.arange(len(new))
            added = [words[i] for i in new.tolist()]
            self._add(added)
            for w in added:
                if len(w) > self.longest:
                    del self.known[w]  # its ids stay until all are cleared
        segments = number[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        last = np.searchsorted(starts, offsets[1:])  # segments before each text's end
        segments = np.insert(segments, last, 0)
        begin = np.where(segments > 0, self.ends[segments], 0)
        size = self.ends[segments + 1] - begin
        upto = np.concatenate([[0], np.cumsum(size)])
        out = self.ids[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return out, np.concatenate([[0], upto[last + np.arange(1, len(last) + 1)]])


def shared_cache(path: str) -> WordCache:
    """This process's cache for a vocabulary: it outlives a task, as workers do."""
    held = sys.modules.setdefault("_pixelframe_word_caches", types.ModuleType("_pixelframe_word_caches")).__dict__
    if path not in held:
        held[path] = WordCache(path)
    return held[path]


def encoded(batches: Iterable[pa.RecordBatch], text_col: str, path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with their texts' ids, each with the end id, end to end, and where each text's begin."""
    cache = shared_cache(path)
    for piece in pieces(batches, text_col, 4 << 20):
        yield piece, *cache.encode(*text_bytes(piece.column(piece.schema.get_field_index(text_col))))
