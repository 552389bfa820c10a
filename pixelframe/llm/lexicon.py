"""BPE encoding and decoding with a lexicon of frequent words, a minimal acyclic transducer that tasks map into memory."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.arrow_text import coded_runs, pieces, text_bytes
from pixelframe.llm.common import new_path, written
from pixelframe.llm.tokens import default_path

_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_PRINTABLE = re.compile("[!-~]*")
_NEVER = np.int64(1) << 40
#: The letters of byte-level vocabularies, by their rule: a byte that is printable ASCII or Latin-1 is itself, the others follow from 256 on.
_LETTER = {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else None for b in range(256)}
_LETTER |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if _LETTER[b] is None)}


def _held(key: str, make: Callable[[], Any]) -> Any:
    """What this process made for a key: it outlives a task, as workers do."""
    kept = sys.modules.setdefault("_pixelframe_lexicons", types.ModuleType("_pixelframe_lexicons")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Merger:
    """Encodes words by the vocabulary's merges, many words at once.

    For tokenizers that drop white space and mark words' ends: a word (no white space in it) is then encoded by itself.
    Normalisation and splitting of words with other than printable ASCII are the tokenizer's own.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        split = steps[0]
        if split.get("type") != "Split" or split.get("behavior") != "Removed" or spec["model"]["type"] != "BPE" or spec["model"].get("ignore_merges"):
            raise ValueError("this operator takes BPE vocabularies whose tokenizer drops white space")
        self.lowered = "Lowercase" in json.dumps(spec["normalizer"])
        self.split = regex.compile(split["pattern"]["Regex"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].strip() or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("special tokens are found as they are, and hold no white space")
        self.special = special
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.first, self.last = ([vocab.get(_LETTER[b] + tail, -1) for b in range(256)] for tail in ("", self.end))
        self.by_letter = {_LETTER[b]: (self.first[b], self.last[b]) for b in range(256)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        a, b, c = (np.array(v, np.int64) for v in zip(*[(vocab[x], vocab[y], vocab[x + y]) for x, y in pairs]))
        key = (a << 32) | b
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), c[order]
        born = np.full(max(vocab.values()) + 1, -1, np.int64)  # the merge that first makes a token
        born[c[::-1]] = np.arange(len(c))[::-1]
        # if a pair's parts are always made before it, all places of a pair can be merged at once
        self.at_once = bool(((born[a] < np.arange(len(c))) & (born[b] < np.arange(len(c)))).all())
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.joined = (spec["decoder"] or {}).get("type") is None
        if not self.joined:
            raise ValueError("this operator decodes vocabularies without a decoder of their own")

    def _parts(self, word: str) -> list[str | int]:
        """A word's pre-tokens in the vocabulary's letters, and ids of special tokens."""
        if self.cut and "<" in word or self.cut and not all(x.startswith("<") for x in self.special):
            whole = self.cut.split(word)
            if len(whole) > 1:
                return [x for k, part in enumerate(whole) if part for x in ([self.special[part]] if k % 2 else self._parts_of(part))]
        return self._parts_of(word)

    def _parts_of(self, word: str) -> list[str | int]:
        if _PRINTABLE.fullmatch(word):
            return self.split.findall(word.lower() if self.lowered else word)
        normal = self.tokenizer.normalizer.normalize_str(word)
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each has."""
        symbols: list[int] = []
        sizes: list[int] = []  # of pre-tokens
        per_word: list[int] = []
        letters = self.by_letter
        for word in words:
            before = len(sizes)
            for part in self._parts(word):
                if isinstance(part, int):
                    symbols.append(part)
                    sizes.append(1)
                else:
                    symbols += [letters[x][0] for x in part[:-1]]
                    symbols.append(letters[part[-1]][1])
                    sizes.append(len(part))
            per_word.append(len(sizes) - before)
        merged, counts = self.merge(np.array(symbols, np.int64), np.array(sizes, np.int64))
        upto = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(per_word) if per_word else np.zeros(0, np.int64)
        return merged, np.diff(upto[ends], prepend=0) if len(ends) else ends

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of pre-tokens of the given sizes, the lowest rank first, in all of them side by side."""
        n = len(sizes)
        of = np.repeat(np.arange(n), sizes)
        done_s, done_o = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pair = np.full(len(symbols), -1, np.int64)  # the merge of each symbol with the next one
        if len(symbols) > 1:
            same = np.flatnonzero(of[1:] == of[:-1])
            pair[same] = self._ranks(symbols[same], symbols[same + 1])
        while len(symbols):
            rank = np.where(pair >= 0, self.rank[pair], _NEVER)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            size = np.diff(np.append(first, len(of)))
            least = np.minimum.reduceat(rank, first)
            ready = np.repeat(least == _NEVER, size)
            if ready.any():
                done_s.append(symbols[ready])
                done_o.append(of[ready])
                left = ~ready
                symbols, of, pair, rank = symbols[left], of[left], pair[left], rank[left]
                size, least = size[least < _NEVER], least[least < _NEVER]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            if self.at_once:  # of places in a row every other one, from the first on
                begin = np.concatenate([[True], np.diff(at) != 1])
                run = np.flatnonzero(begin)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            else:
                at = at[np.concatenate([[True], of[at][1:] != of[at][:-1]])]
            symbols[at] = self.made[pair[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            spot = at - np.arange(len(at))  # places after the merged halves have gone
            pair[at] = -1
            symbols, of, pair = symbols[keep], of[keep], pair[keep]
            near = np.unique(np.concatenate([spot, spot[spot > 0] - 1]))
            near = near[near + 1 < len(symbols)]
            same = of[near] == of[near + 1]
            pair[near] = np.where(same, self._ranks(symbols[near], symbols[near + 1]), -1)
        symbols, of = np.concatenate(done_s), np.concatenate(done_o)
        order = np.argsort(of, kind="stable")
        return symbols[order], np.bincount(of, minlength=n)


def compile_lexicon(words: list[bytes], ids: list[tuple[int, ...]]) -> bytes:
    """A minimal acyclic transducer from words (sorted, distinct) to their ids, as a file.

    Words are added in order; states behind the part that a word shares with the next one are final in form and replaced
    by equal states met before, so words share their endings. What a word's ids have in common with those of the words
    that branch off later stays on the arcs towards the start, so that the rest of the way is the same for more words.
    Layout: eight sizes, then the arrays of `Lexicon`.
    """
    known: dict[tuple, int] = {}
    keys: list[int] = []  # state * 256 + label of every arc, in order
    targets: list[int] = []
    outs: list[int] = []  # of arcs
    finals: list[int] = []  # a state's last ids, by number; -1: not final
    numbers: dict[tuple[int, ...], int] = {(): 0}

    path: list[list[Any]] = [[[], None]]  # [[label, target, ids], ...] and last ids of each state on the way of the last word

    def frozen(state: list[Any]) -> int:
        arcs, last = state
        key = (last, tuple((a, b, c) for a, b, c in arcs))
        if key not in known:
            known[key] = number = len(finals)
            finals.append(-1 if last is None else numbers.setdefault(last, len(numbers)))
            for label, target, out in arcs:
                keys.append(number << 8 | label)
                targets.append(target)
                outs.append(numbers.setdefault(out, len(numbers)))
        return known[key]

    before = b""
    for word, out in zip(words, ids):
        common = 0
        for x, y in zip(before, word):
            if x != y:
                break
            common += 1
        while len(path) > common + 1:
            state = path.pop()
            path[-1][0][-1][1] = frozen(state)
        for k in range(common):
            arc, state = path[k][0][-1], path[k + 1]
            have, same = arc[2], 0
            while same < len(have) and same < len(out) and have[same] == out[same]:
                same += 1
            rest = have[same:]
            if rest:
                arc[2] = have[:same]
                for after in state[0]:
                    after[2] = rest + after[2]
                if state[1] is not None:
                    state[1] = rest + state[1]
            out = out[same:]
        for label in word[common:]:
            path[-1][0].append([label, -1, out])
            path.append([[], None])
            out = ()
        path[-1][1] = out
        before = word
    while len(path) > 1:
        state = path.pop()
        path[-1][0][-1][1] = frozen(state)
    root = frozen(path[0])
    sizes = np.cumsum([0, *map(len, numbers)])
    arrays = [keys, targets, outs, finals, sizes.tolist(), [i for x in numbers for i in x]]
    parts = [np.array(v, np.int64).astype("<i4") for v in arrays]
    head = np.array([root, *map(len, parts), 0], "<i4")
    return b"".join(p.tobytes() for p in (head, *parts))


class Lexicon:
    """A compiled lexicon, mapped into memory: looks many words up at once, a letter of all of them at a time."""

    def __init__(self, file: str):
        data = np.memmap(file, "<i4", "r")
        self.root, sizes, at, parts = int(data[0]), data[1:7].tolist(), 8, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        self.keys, self.targets, self.outs, self.finals, self.ends, self.ids = parts

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words (data[start : start + size]) it knows, the ids of those end to end, and how many each has."""
        n = len(start)
        state, alive = np.full(n, self.root, np.int64), np.arange(n)
        who, what = [], []  # outputs in the order of letters
        known = np.zeros(n, bool)
        depth = 0
        while len(alive):
            over = size[alive] == depth
            if over.any():
                full = alive[over]
                last = self.finals[state[full]]
                known[full[last >= 0]] = True
                who.append(full[last > 0])
                what.append(last[last > 0])
                alive = alive[~over]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] << 8 | data[start[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            alive, at = alive[on], at[on]
            state[alive] = self.targets[at]
            out = self.outs[at]
            who.append(alive[out > 0])
            what.append(out[out > 0])
            depth += 1
        who, what = (np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for v in (who, what))
        mine = known[who]  # words that end outside have given some ids, too
        who, what = who[mine], what[mine]
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order]
        begin = self.ends[what].astype(np.int64)
        length = self.ends[what + 1] - begin
        upto = np.cumsum(length) - length
        ids = self.ids[np.repeat(begin - upto, length) + np.arange(int(length.sum()))]
        return known, ids.astype(np.int64), np.bincount(who, length, n).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str, longest: int) -> DataFrame:
    """Words (between ASCII white space) of up to `longest` bytes, and how often each occurs."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text"):
            words, ids, _ = coded_runs(*text_bytes(piece.column(0)), _SOLID)
            some = np.flatnonzero(np.diff(np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)) <= longest)
            text = words.take(pa.array(some)).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text, pa.array(np.bincount(ids, minlength=len(words))[some].astype(np.int64))], names=["word", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, most_words: int = 1 << 17, longest: int = 64, text_col: str = "text") -> str:
    """Compile the most frequent words of all texts, and give the file to all executors; returns the file's name.

    The lexicon is bounded: the words found at least so often that most_words aren't exceeded, and twice or more. Only
    they and the number of words with each count come to the driver. The file is in the shared folder, from which Spark
    hands it to executors, later ones too.
    """
    spark = docs.sparkSession
    words = written(word_counts(docs, text_col, longest).filter("n > 1"), "word-counts")
    cap = 1 << 20
    of_count = words.groupBy(F.least("n", F.lit(cap)).alias("n")).agg(F.count("*").alias("words")).collect()  # at most cap rows
    least, total = cap + 1, 0
    for r in sorted(of_count, key=lambda r: -r["n"]):
        total += r["words"]
        if total > most_words:
            break
        least = r["n"]
    kept = sorted(r["word"].encode() for r in words.filter(F.col("n") >= least).select("word").collect())
    ids, sizes = _held(f"merger {path}", lambda: Merger(path)).encode([w.decode() for w in kept])
    ends, ids = np.cumsum(sizes).tolist(), ids.tolist()
    data = compile_lexicon(kept, [tuple(ids[e - s : e]) for e, s in zip(ends, sizes.tolist())])
    return _shared(spark, data)


def _shared(spark: SparkSession, data: bytes) -> str:
    to = f"{new_path(spark, 'lexicon')}.bin"
    place = spark._jvm.org.apache.hadoop.fs.Path(to)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(to)
    return to.rsplit("/", 1)[1]


def _encoded(batches: Iterable[pa.RecordBatch], path: Callable[[], str], lexicon: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of rows (id, _text) with their ids end to end, and where each text's begin, with the end of the last."""
    vocabulary = path()
    merger = _held(f"merger {vocabulary}", lambda: Merger(vocabulary))
    known = _held(f"lexicon {lexicon}", lambda: Lexicon(SparkFiles.get(lexicon)))
    for piece in pieces(batches, "_text", 2 << 20):
        data, offsets = text_bytes(piece.column(1))
        words, number, start = coded_runs(data, offsets, _SOLID)
        bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
        raw = words.buffers()[2]
        letters = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        found, ids, size = known.find(letters, bounds[:-1], np.diff(bounds))
        rest = np.flatnonzero(~found)
        more, more_size = merger.encode(words.take(pa.array(rest)).cast(pa.large_string()).to_pylist())
        begin = np.cumsum(size) - size
        size[rest] = more_size
        begin[rest] = len(ids) + np.cumsum(more_size) - more_size
        pool = np.concatenate([ids, more])
        each = size[number]
        upto = np.concatenate([[0], np.cumsum(each)])
        out = pool[np.repeat(begin[number] - upto[:-1], each) + np.arange(upto[-1])]
        yield piece, out, upto[np.searchsorted(start, offsets)]


def _vocabulary(tokenizer: str) -> Callable[[], str]:
    """A vocabulary file's place on the machine that asks: a path, or a public tokenizer's name."""
    return lambda: tokenizer if "/" in tokenizer else default_path(tokenizer)


def bpe_encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", most_words: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of whole texts: doc_id and ids (array<int>).

    Two passes: words are counted and the frequent ones compiled to a lexicon (see build_lexicon); then a task cuts texts
    into words, looks the distinct ones up in the lexicon, merges the others by the vocabulary's ranks, and puts ids
    together. Null and empty texts: no ids. Null ids, repeated rows: returned each. Very long texts and words are whole.
    Other columns, whatever their names, are ignored. Empty table: no rows.
    """
    path = _vocabulary(tokenizer)
    lexicon = build_lexicon(docs, path(), most_words, text_col=text_col)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ids, ends in _encoded(batches, path, lexicon):
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["doc_id", "ids"])

    return _narrow(docs, id_col, text_col).mapInArrow(encode, "doc_id long, ids array<int>")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


class Decoder:
    """Texts of ids: the tokens' names with blanks between them; and the ids in decimal, likewise."""

    def __init__(self, names: list[str]):
        self.names = pa.array([f"{x} ".encode() for x in names], pa.large_binary())
        self.decimals = pa.array([f"{k} ".encode() for k in range(len(names))], pa.large_binary())

    def joined(self, table: pa.LargeBinaryArray, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """The texts of ids[ends[k] : ends[k + 1]]."""
        taken = table.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)
        raw = memoryview(taken.buffers()[2] or b"")
        at = offsets[ends].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(at, at[1:])]


def bpe_decode(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Texts of ids (doc_id, ids), special tokens kept: doc_id and text. Null ids: an empty text."""
    path = _vocabulary(tokenizer)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = path()
        decoder = _held(f"decoder {vocabulary}", lambda: Decoder(Merger(vocabulary).names))
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            texts = decoder.joined(decoder.names, lists.flatten().to_numpy(), ends)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bytes(t).decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def bpe_digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", most_words: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts encoded and decoded in one pass, as digests: doc_id, n_tokens, ids_sha256 (of the decimal ids, a blank
    between them) and decoded_sha256. The cases of bpe_encode hold."""
    path = _vocabulary(tokenizer)
    lexicon = build_lexicon(docs, path(), most_words, text_col=text_col)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = path()
        decoder = _held(f"decoder {vocabulary}", lambda: Decoder(_held(f"merger {vocabulary}", lambda: Merger(vocabulary)).names))
        for piece, ids, ends in _encoded(batches, path, lexicon):
            sums = [pa.array([hashlib.sha256(t).hexdigest() for t in decoder.joined(table, ids, ends)], pa.string()) for table in (decoder.decimals, decoder.names)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(ends)), *sums], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _narrow(docs, id_col, text_col).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
