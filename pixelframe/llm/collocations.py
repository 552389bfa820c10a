"""Collocations: frequent phrases found by Rabin-Karp fingerprints, verified against text, ranked by their best cut."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm.arrow_text import coded_runs, pieces, text_bytes
from pixelframe.llm.common import partitions, written
from pixelframe.llm.neardup import mixed
from pixelframe.operators.groups import whole_groups

#: What separates words of a piece, and what ends a piece.
BETWEEN = b" \t"
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Occurrences that a task holds before it sorts and sends them.
HELD = 1_500_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Fingerprints:
    """Polynomials modulo 2^64 of runs in a sequence of numbers, from prefix sums of the numbers times powers of a base.

    A run's part of the sums is moved back to the power 0 by the base's inverse, so equal runs have equal fingerprints
    wherever they stand. A last mixing spreads them over all bits.
    """

    def __init__(self):
        self.power = self.back = np.ones(1, np.uint64)

    def sums(self, numbers: np.ndarray) -> np.ndarray:
        n = len(numbers)
        if len(self.power) < n + 1:
            full = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + (n >> 2), b, np.uint64)]))
            self.power, self.back = full(_BASE), full(_INVERSE)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers * self.power[:n])])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def words(self, words: pa.LargeBinaryArray) -> np.ndarray:
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        raw = words.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        return self.of(self.sums(data.astype(np.uint64) + np.uint64(1)), offsets[:-1], offsets[1:])


class Scanned:
    """The words of a batch of texts: each a number of a (word, lang) pair, with the text's piece that it stands in."""

    def __init__(self, batch: pa.RecordBatch, prints: Fingerprints):
        langs = batch.column(0).dictionary_encode()
        data, offsets = text_bytes(batch.column(1))
        data = _LOWER[data]
        words, ids, self.start = coded_runs(data, offsets, _SOLID)
        edge = _ENDS[data]
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        self.piece = np.cumsum(edge, dtype=np.int32)[self.start]
        text = np.searchsorted(offsets, self.start, "right") - 1
        n = max(1, len(langs.dictionary))
        both = ids.astype(np.int64) * n + langs.indices.to_numpy()[text]
        if len(words) * n <= max(4 << 20, 4 * len(both)):
            self.counts = np.bincount(both, minlength=len(words) * n)
            used = np.flatnonzero(self.counts)
            number = np.zeros(len(self.counts), np.int64)
            number[used] = np.arange(len(used))
            self.counts, self.word = self.counts[used], number[both]
        else:
            used, self.word, self.counts = np.unique(both, return_inverse=True, return_counts=True)
        self.words, self.lang_of, self.langs = words.take(pa.array(used // n)), used % n, langs.dictionary
        salt = np.array([_salt(x) for x in langs.dictionary.to_pylist()] or [0], np.uint64)
        self.codes = mixed(prints.words(self.words) ^ salt[self.lang_of])
        self.sums, self.prints = prints.sums(self.codes[self.word]), prints
        self.bytes = len(data)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all runs of n words, by their first word, and whether a run lies in one piece."""
        last = max(0, len(self.word) - n + 1)
        at = np.arange(last)
        return self.prints.of(self.sums, at, at + n), self.piece[:last] == self.piece[n - 1 : n - 1 + last]

    def texts(self, at: list[np.ndarray]) -> pa.Array:
        """Phrases of (word, lang) numbers, word by word."""
        return pc.binary_join_element_wise(*[self.words.take(pa.array(x)) for x in at], pa.scalar(b" ", pa.large_binary()))

    def lang(self, of: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.lang_of[of]))


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_ENDS = _table(ENDS)
_SOLID = ~(_ENDS | _table(BETWEEN))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Sieve:
    """A bit for each value of the upper bits of fingerprints: tells those that aren't in a set, of a fixed size in memory.

    As the set grows more others pass, which costs time but no results.
    """

    def __init__(self, rows: DataFrame, bits: int):
        self.shift = 64 - bits
        place = F.shiftrightunsigned("fp", self.shift)
        slices = rows.groupBy(F.shiftrightunsigned(place, 15).alias("slice")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits"))
        whole = np.zeros(1 << (bits - 3), np.uint8)
        for r in slices.toLocalIterator():  # at most 2^bits / 8 bytes
            whole[r["slice"] * 4096 : (r["slice"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
        self.bits = rows.sparkSession.sparkContext.broadcast(whole)

    def __call__(self, fp: np.ndarray) -> np.ndarray:
        place = fp >> np.uint64(self.shift)
        return (self.bits.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _words(docs: DataFrame) -> DataFrame:
    """lang, word and f, how often it occurs."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, held, rows = Fingerprints(), [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            merged = pa.Table.from_batches(held).group_by(["lang", "word"]).aggregate([("f", "sum")]) if len(held) > 1 else pa.Table.from_batches(held)
            for b in merged.select([*["lang", "word"], merged.column_names[-1]]).rename_columns(["lang", "word", "f"]).to_batches(100_000):
                yield b

        for piece in pieces(batches, "_text", 2 << 20):
            s = Scanned(piece, prints)
            lang, word = s.lang(np.arange(len(s.words))).cast(pa.string()), s.words.cast(pa.large_string()).cast(pa.string())
            held.append(pa.RecordBatch.from_arrays([lang, word, pa.array(s.counts, pa.int64())], names=["lang", "word", "f"]))
            rows += len(word)
            if rows > 1_000_000:
                yield from sent()
                held, rows = [], 0
        if held:
            yield from sent()

    return docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _frequent(docs: DataFrame, n: int, least: int, sieve: Callable[[Scanned], np.ndarray], tag: str) -> DataFrame:
    """Fingerprints (fp) of runs of n words found at least `least` times, with f and the place (task, at) of an occurrence.

    `sieve` tells which runs of a scan can be frequent. A task sorts its occurrences, adds equal ones up and sends them
    in buckets of fingerprints as packed columns, so a frequent phrase is one entry a task and buckets are of equal size.
    """
    spark = docs.sparkSession
    buckets = 8 * partitions(spark)

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, task = Fingerprints(), TaskContext.get().partitionId()
        fps: list[np.ndarray] = []
        places: list[np.ndarray] = []
        done = base = rows = 0

        def sent() -> Iterator[pa.RecordBatch]:
            fp, at = np.concatenate(fps), np.concatenate(places)
            fps.clear()
            places.clear()
            order = np.argsort(fp, kind="stable")
            fp, at = fp[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            f = np.diff(np.append(first, len(fp))).astype("<u4")
            fp, at = fp[first], at[first]  # the first of equal ones, as the sort is stable
            bucket = ((fp >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = [*cut[1:].tolist(), len(fp)]
            packed = [pa.array([c[s:e].tobytes() for s, e in zip(cut.tolist(), ends)], pa.binary()) for c in (fp, f, at)]
            head = [pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), task, np.int32)), pa.array(np.full(len(cut), base, np.int64))]
            yield pa.RecordBatch.from_arrays([*head, *packed], names=["bucket", "task", "base", "fp", "f", "at"])

        for piece in pieces(batches, "_text", 2 << 20):
            s = Scanned(piece, prints)
            fp, inside = s.grams(n)
            kept = np.flatnonzero(inside & sieve(s))
            fps.append(fp[kept])
            places.append((s.start[kept] + (done - base)).astype(np.uint32))
            done, rows = done + s.bytes, rows + len(kept)
            if rows > HELD:
                yield from sent()
                rows, base = 0, done
        if rows:
            yield from sent()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["bucket"]):
            bucket = group["bucket"].to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
            for s, e in zip(cut, [*cut[1:], len(bucket)]):
                part = group.slice(s, e - s)
                fp, f, at = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in part[c]]) for c, t in (("fp", "<u8"), ("f", "<u4"), ("at", "<u4")))
                size = np.array([x.as_buffer().size // 8 for x in part["fp"]])
                order = np.argsort(fp, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], fp[order][1:] != fp[order][:-1]]))
                total = np.add.reduceat(f[order].astype(np.int64), first)
                often = total >= least
                pick = order[first[often]]
                of = np.repeat(np.arange(len(size)), size)[pick]
                task, base = part["task"].to_numpy()[of], part["base"].to_numpy()[of]
                yield pa.RecordBatch.from_arrays([pa.array(fp[pick].astype(np.int64)), pa.array(total[often]), pa.array(task), pa.array(base + at[pick])], names=["fp", "f", "task", "at"])

    sent = docs.mapInArrow(collect, "bucket int, task int, base long, fp binary, f binary, at binary")
    dealt = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "task", "base")
    return written(dealt.mapInArrow(add, "fp long, f long, task int, at long"), tag)


def _materialised(docs: DataFrame, often2: Sieve, often3: Sieve, least: int) -> DataFrame:
    """lang, phrase, a: frequent phrases of two and three words with their exact counts.

    Texts are read only where a fingerprint is a frequent one. Within a task equal phrases are told by their words, and
    tasks' counts are added up by the phrase itself, so phrases that share a fingerprint are told apart here.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for piece in pieces(batches, "_text", 2 << 20):
            s = Scanned(piece, prints)
            two, three = (s.grams(n) for n in (2, 3))
            hit2 = two[1] & often2(two[0])
            hit3 = three[1] & hit2[: len(three[0])] & hit2[1:] if len(three[0]) else np.zeros(0, bool)
            spot = np.flatnonzero(hit3)
            spot = spot[often3(three[0][spot])]
            w, n = s.word, len(s.words)
            pairs, number, count = np.unique(w[:-1][hit2] * n + w[1:][hit2], return_inverse=True, return_counts=True)
            found = [([pairs // n, pairs % n], count)]
            if len(spot):
                place = np.cumsum(hit2) - 1
                triples, count = np.unique(number[place[spot]] * n + w[spot + 2], return_counts=True)
                found.append(([pairs[triples // n] // n, pairs[triples // n] % n, triples % n], count))
            for at, count in found:
                if len(count):
                    phrase = s.texts(at).cast(pa.large_string()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([s.lang(at[0]).cast(pa.string()), phrase, pa.array(count, pa.int64())], names=["lang", "phrase", "a"])

    return docs.mapInArrow(read, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def _joined(rows: DataFrame, counts: DataFrame, part: str, name: str, hot: DataFrame) -> DataFrame:
    """Rows with the count of a part of their phrase; those of the most frequent words are sent to all tasks."""
    often = F.broadcast(hot.select("lang", F.col("part").alias(part), F.col("f").alias("_hot")))
    marked = rows.join(often, ["lang", part], "left")
    rest = marked.filter("_hot is null").drop("_hot").join(counts.select("lang", F.col("part").alias(part), F.col("f").alias(name)), ["lang", part])
    return marked.filter("_hot is not null").withColumnRenamed("_hot", name).select(rest.columns).unionByName(rest)


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, sieve_bits: int = 27, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Phrases of two and three words found at least `least` times in a language, ranked by how much they cling together.

    Words and pieces of text are those of BETWEEN and ENDS, A to Z lowered. Four passes over the texts: words are counted
    as they are; runs of two words, both frequent, by fingerprints; runs of three whose two pairs are frequent, likewise;
    then the frequent ones alone are read as texts and counted exactly. A phrase is scored by its worst cut in two parts,
    floor(10^6 * a * a / (l * r)) from its count a and its parts' counts l and r; equal scores by the earlier cut.
    Phrases inside a longer one that has at least half their count go.

    Returns each language's first `top`: lang, rank, phrase, a, l, r, n (all words of the language) and score, all long.
    Null languages: `und`; null and empty texts, and texts without words: nothing. Repeated rows count each. Ties: by a,
    then by the phrase's bytes. Very long texts are read as a whole. Other columns, whatever their names, are ignored.
    Empty table: no rows. Tasks hold a few million occurrences and 2^sieve_bits bits; nothing is cut off.
    """
    narrow = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    words = written(_words(narrow), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.filter(F.col("f") >= least)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            salt = np.array([_salt(x) for x in batch.column(0).to_pylist()], np.uint64)
            fp = mixed(prints.words(batch.column(1).cast(pa.large_string()).cast(pa.large_binary())) ^ salt)
            yield pa.RecordBatch.from_arrays([pa.array(fp.astype(np.int64))], names=["fp"])

    one = Sieve(often.mapInArrow(code, "fp long"), sieve_bits)

    def pair_of_often(s: Scanned) -> np.ndarray:
        ok = one(s.codes)[s.word]
        return ok[:-1] & ok[1:]

    two = Sieve(_frequent(narrow, 2, least, pair_of_often, "pairs"), sieve_bits)

    def triple_of_often(s: Scanned) -> np.ndarray:
        fp, _ = s.grams(2)
        ok = two(fp)
        return ok[:-1] & ok[1:]

    three = Sieve(_frequent(narrow, 3, least, triple_of_often, "triples"), sieve_bits)
    found = written(_materialised(narrow, two, three, least).withColumn("w", F.split("phrase", " ")), "phrases")
    return _ranked(found, often, totals, top)


def _ranked(found: DataFrame, often: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Score, filter and rank phrases (lang, phrase, a, w: its words) by the counts of words and of themselves."""
    number = often.agg(F.sum("f")).first()[0] or 0
    # each has over 1/4096 of all words, so there are less than 4096
    hot = often.filter(F.col("f") * 4096 > number).select("lang", F.col("word").alias("part"), "f")
    counts = often.select("lang", F.col("word").alias("part"), "f").unionByName(found.filter(F.size("w") == 2).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    inner = found.filter(F.size("w") == 3).select("lang", F.explode(F.array(*[F.concat_ws(" ", F.get("w", k), F.get("w", k + 1)) for k in (0, 1)])).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < 50 * F.col("a"))).drop("longer")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("right"))
    cuts = _joined(_joined(cuts, counts, "left", "l", hot), counts, "right", "r", hot)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"_over": (wide("a") * wide("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"), "_under": wide("l") * wide("r")})
    scored = cuts.withColumn("score", F.expr("_over div _under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.score", "b.a", "b.l", "b.r")
    order: list[Column] = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    # a language's best are among the best of its parts; so no task sorts a whole language
    some = some.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_nth") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return some.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
