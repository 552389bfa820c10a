"""Near-duplicate texts by DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.arrow_text import pieces, text_bytes
from pixelframe.llm.common import fresh, partitions, text_hashes, with_nodes, written
from pixelframe.llm.components import connected

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (a finaliser of shifts and multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of many texts at once.

    A word's hash is a polynomial in its bytes: sums of bytes times powers of an odd number up to each place are taken
    once, and a word's part of them is moved back to the power 0 by the inverse.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.power = self.back = np.ones(1, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            inverse = pow(self.BASE, -1, 1 << 64)
            full = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + (n >> 2), b, np.uint64)]))
            self.power, self.back = full(self.BASE), full(inverse)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every word's hash in order, and how many words each text has, of texts end to end in data."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
        self._powers(n)
        solid = ~self.space[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        begins[edges] = solid[edges]
        start = np.flatnonzero(begins)
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        ends[last] = solid[last]
        end = np.flatnonzero(ends) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n])])
        codes = mixed((sums[end] - sums[start]) * self.back[start] + (end - start).astype(np.uint64))
        return codes, np.diff(np.searchsorted(start, offsets))


class Shingles:
    """Hashes of runs of `size` words of texts; a text of fewer words has one run, one of no words has none."""

    def __init__(self, size: int = 5):
        self.size, self.words = size, Words()

    def all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every run's hash in order, and the text that it is of."""
        codes, sizes = self.words(data, offsets)
        text = np.repeat(np.arange(len(sizes)), sizes)
        n, out, of = self.size, [], []
        if len(codes) >= n:
            end = len(codes) - n + 1
            h = np.zeros(end, np.uint64)
            for k in range(n):
                h = (h ^ codes[k : k + end]) * _M3
                h ^= h >> np.uint64(32)
            inside = text[:end] == text[n - 1 :]
            out.append(mixed(h[inside]))
            of.append(text[:end][inside])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for i in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in codes[starts[i] : starts[i + 1]]:
                    h = (h ^ c) * _M3
                    h ^= h >> np.uint64(32)
            out.append(mixed(np.array([h], np.uint64) + np.uint64(sizes[i])))
            of.append(np.array([i]))
        if not out:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(out), np.concatenate(of)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of each text with how often they occur: (text, hash, count), by text."""
        codes, of = self.all(data, offsets)
        order = np.lexsort((codes, of))
        codes, of = codes[order], of[order]
        first = np.ones(len(codes), bool)
        first[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(first)
        return of[at], codes[at], np.diff(np.append(at, len(codes)))


class Darts:
    """DartMinHash: k minima of weighted sets from few hashed darts.

    The plane of weight and rank is cut into regions, dyadic in both. Each element throws into each region as many
    darts as a Poisson number, read off its hash, says (one for each unit of area); a dart's hash gives its weight,
    its rank and one of k coordinates. Darts above the element's weight miss. The earliest rank in each coordinate is
    kept, with its dart's name: two sets agree in a coordinate with the probability of their weighted Jaccard
    similarity. About k ln k + 2k darts fill all coordinates, so regions beyond that rank, which falls with the total
    weight, aren't visited; sets with a coordinate left open go on with twice the rank.
    """

    LOW = 5  # the first region of ranks ends at 2**-LOW

    def __init__(self, k: int):
        self.k = k
        self.aim = k * math.log(k) + 2 * k
        self.tables: dict[float, np.ndarray] = {}

    def _counts(self, area: float, u: np.ndarray) -> np.ndarray:
        """Poisson numbers with mean `area` from uniform numbers."""
        if area not in self.tables:
            most = int(area + 12 * math.sqrt(area) + 24)
            logs = [-area + j * math.log(area) - math.lgamma(j + 1) for j in range(most)]
            self.tables[area] = np.cumsum(np.exp(logs))
        return np.searchsorted(self.tables[area], u)

    def _throw(self, sig: np.ndarray, of: np.ndarray, codes: np.ndarray, weights: np.ndarray, nu: int, rho: int) -> None:
        w0, w1 = (0.0, 1.0) if nu == 0 else (2.0 ** (nu - 1), 2.0**nu)
        r0, r1 = (0.0, 2.0**-self.LOW) if rho == 0 else (2.0 ** (rho - 1 - self.LOW), 2.0 ** (rho - self.LOW))
        region = mixed(codes + np.uint64((nu * 4099 + rho + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        n = self._counts((w1 - w0) * (r1 - r0), (region >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        who = np.repeat(np.arange(len(codes)), n)
        if not len(who):
            return
        nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        dart = mixed(region[who] + (nth.astype(np.uint64) + np.uint64(1)) * _M3)
        if (weights[who] < w1).any():
            height = w0 + (w1 - w0) * (mixed(dart ^ _M1) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            hit = height < weights[who]
            who, dart = who[hit], dart[hit]
        rank = r0 + (r1 - r0) * (dart >> np.uint64(32)).astype(np.float64) * 2.0**-32
        # ranks in 32 bits of a logarithmic scale, then the dart's name
        order = ((np.log2(rank + 2.0**-40) + 40) * 2.0**25).astype(np.uint64)
        name = mixed(dart ^ _M2)
        coordinate = (name >> np.uint64(40)).astype(np.int64) % self.k
        np.minimum.at(sig, of[who] * self.k + coordinate, order << np.uint64(32) | (name & np.uint64(0xFFFFFFFF)))

    def signatures(self, n: int, of: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Names of the earliest darts of sets 0 .. n - 1, (n, k) unsigned 32-bit; a set without weight has zeros."""
        sig = np.full(n * self.k, EMPTY, np.uint64)
        total = np.bincount(of, weights, minlength=n)
        limit = self.aim / np.maximum(total, 1e-12)
        done = np.zeros(n)  # ranks below it have been visited
        open_ = total > 0
        while open_.any():
            top = float(limit[open_].max())
            rho = 0
            while (0.0 if rho == 0 else 2.0 ** (rho - 1 - self.LOW)) < top:
                low = 0.0 if rho == 0 else 2.0 ** (rho - 1 - self.LOW)
                visit = open_ & (limit > low) & (done <= low)
                if visit.any():
                    mine = visit[of]
                    nu = 0
                    while True:
                        use = mine & (weights > (0.0 if nu == 0 else 2.0 ** (nu - 1)))
                        if not use.any():
                            break
                        self._throw(sig, of[use], codes[use], weights[use], nu, rho)
                        nu += 1
                    done[visit] = 2.0 ** (rho - self.LOW)
                rho += 1
            open_ &= (sig.reshape(n, self.k) == EMPTY).any(1)
            limit[open_] = 2 * np.maximum(limit[open_], done[open_])
        names = (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, self.k)
        names[total == 0] = 0
        return names


def texts_of(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(piece.column(piece.schema.get_field_index("_text")))


def text_nodes(docs: DataFrame, bands: int, rows: int, weighting: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h1 and h2 (hashes of the text), node, and the keys of its bands (null for texts without words), written."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    narrow = narrow.select("doc_id", *text_hashes(F.col("_text")), "_text")

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, darts = Shingles(), Darts(bands * rows)
        salt = np.arange(bands, dtype=np.uint64) * _M3
        for piece in pieces(batches, "_text", 1 << 19, 512):
            n = piece.num_rows
            of, codes, counts = shingles.sets(*texts_of(piece))
            weights = counts.astype(np.float64) if weighting == "count" else np.ones(len(codes))
            sig = darts.signatures(n, of, codes, weights).astype(np.uint64).reshape(n, bands, rows)
            h = np.broadcast_to(salt, (n, bands)).copy()
            for r in range(rows):
                h = mixed((h ^ sig[:, :, r]) * _M3 + np.uint64(r))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(h.astype(np.int64).ravel()), mask=pa.array(np.bincount(of, minlength=n) == 0))
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], keys], names=["doc_id", "h1", "h2", "keys"])

    return with_nodes(written(narrow.mapInArrow(sign, "doc_id long, h1 long, h2 long, keys array<long>"), "nodes"))


def shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, weighting: str, id_col: str, text_col: str) -> DataFrame:
    """node and codes (sorted distinct hashes of its shingles, as bytes) of the wanted nodes, written: one row a node.

    With weighting 'count' a shingle's further occurrences are elements of their own.
    """
    named = nodes.join(wanted, "node").select("node", "h1", "h2", "min_doc")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = texts.select("doc_id", *text_hashes(F.col("_text")), "_text")
    held = texts.join(named, (texts["h1"] == named["h1"]) & (texts["h2"] == named["h2"]) & F.col("doc_id").eqNullSafe(F.col("min_doc"))).select("node", "_text")

    def shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for piece in pieces(batches, "_text", 1 << 19, 512):
            of, codes, counts = shingles.sets(*texts_of(piece))
            if weighting == "count":
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                of, codes = np.repeat(of, counts), mixed(np.repeat(codes, counts) + nth.astype(np.uint64) * _M3)
                order = np.lexsort((codes, of))
                of, codes = of[order], codes[order]
            ends = np.searchsorted(of, np.arange(piece.num_rows + 1)).tolist()
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([codes[x:y].tobytes() for x, y in zip(ends, ends[1:])], pa.binary())], names=["node", "codes"])

    return written(held.mapInArrow(shingled, "node long, codes binary"), "shingles").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b of nodes) whose sets have at least the similarity, exactly counted."""

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("codes_a", "codes_b"))):
                ca, cb = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if min(len(ca), len(cb)) < similarity * max(len(ca), len(cb)):
                    good.append(False)
                    continue
                at = np.minimum(np.searchsorted(cb, ca), len(cb) - 1)
                shared = int((cb[at] == ca).sum())
                good.append(shared >= similarity * (len(ca) + len(cb) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda s: sets.select(F.col("node").alias(s), F.col("codes").alias(f"codes_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "codes_a", "codes_b").mapInArrow(compared, "a long, b long")


def links_to_outsiders(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between outsiders of buckets and members of other components.

    rows: band, key, block, outsider (boolean), node, comp, codes; a block holds a bounded number of a bucket's
    outsiders and all of its members. A block's outsiders are held as one sorted list of their elements; each member
    that passes by is compared with all of them at once, exactly. For an outsider and a component one link is enough.
    """
    keys = ["band", "key", "block"]

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, comps, sets, index = None, [], [], [], None
        for batch in batches:
            get = [batch.column(batch.schema.get_field_index(c)) for c in (*keys, "outsider", "node", "comp", "codes")]
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                *at, outsider, node, comp, raw = (c[i].as_py() for c in get)
                if at != group:
                    group, names, comps, sets, index, seen = at, [], [], [], None, set()
                codes = np.frombuffer(raw, np.uint64)
                if outsider:
                    names.append(node)
                    comps.append(comp)
                    sets.append(codes)
                    continue
                if not sets:
                    continue  # no outsider fell into this block
                if index is None:
                    elements = np.concatenate(sets)
                    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                    order = np.argsort(elements, kind="stable")
                    index = elements[order], owner[order], np.array([len(x) for x in sets]), np.array(comps)
                elements, owner, sizes, of = index
                left, right = np.searchsorted(elements, codes), np.searchsorted(elements, codes, "right")
                n = right - left
                hits = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[hits], minlength=len(sizes))
                alike = (shared >= similarity * (sizes + len(codes) - shared) - 1e-9) & (of != comp)
                for k in np.flatnonzero(alike).tolist():
                    if (k, comp) not in seen:
                        seen.add((k, comp))
                        found.append((names[k], node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    placed = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, F.desc("outsider"))
    return placed.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 26, rows: int = 5, weighting: str = "count", block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of exact and near copies: components of links between texts with at least the similarity.

    Similarity: weighted Jaccard of shingles of five words; weighting 'count' gives each distinct shingle the number of
    its occurrences as its weight, 'set' 1. Equal texts are one node from the start. Nodes with an equal band of their DartMinHash
    signatures share a bucket (26 bands of 5 miss a pair of similarity 0.8 once in 30,000). In a bucket all nodes are
    compared with one leader, exactly, and join its component if they are similar. The leader is the member whose
    buckets are the largest, as the original is that others were copied from. Nodes left outside the leader's component
    are then compared, in blocks, with all members of other components. So a group of near copies costs a comparison
    for each of them, not a row for each pair, and no link within a bucket that could join two components is left out.

    Returns a row an input row: doc_id, class_id (smallest id of the class), class_texts (different texts in it),
    class_links (pairs of them that were compared and are alike, which join the class), links (those of this text),
    h1 and h2 (hashes of the text), and first_h1 and first_h2 (those of the class's text with that id).
    Texts without words (null, empty): of one class only where the id is equal too. Null ids: a class is named by its
    smallest id that isn't null, null if there is none. Repeated rows: each is returned. Empty table: no rows. Very
    long texts are taken whole. Other columns, whatever their names, are ignored.
    """
    rows_ = text_nodes(docs, bands, rows, weighting, id_col, text_col)
    nodes = written(rows_.filter("keys is not null").groupBy("node").agg(F.min("doc_id").alias("min_doc"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.min("keys").alias("keys")), "nodes")
    keyed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(keyed.join(sizes, ["band", "key"]), "buckets")
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = members.join(weight, "node").groupBy("band", "key").agg(F.max_by("node", "weight").alias("leader"))
    members = written(members.join(leaders, ["band", "key"]).select("band", "key", "node", "leader"), "members")
    pairs = written(members.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = shingle_sets(docs, nodes, wanted, weighting, id_col, text_col)
    links = written(verified(pairs, sets, similarity), "verified")
    comps = written(connected(links), "components")
    of = lambda c, name: comps.select(F.col("node").alias(c), F.col("comp").alias(name))
    placed = members.join(of("node", "comp"), "node", "left").join(of("leader", "leader_comp"), "leader", "left")
    placed = placed.select("band", "key", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("leader_comp", "leader").alias("leader_comp"))
    placed = written(placed, "placed")
    # of a bucket of two, the pair is compared already
    open_ = placed.groupBy("band", "key").agg(F.count_if(F.col("comp") != F.col("leader_comp")).alias("n_out"), F.count("*").alias("n")).filter("n_out > 0 AND n > 2")
    open_ = written(placed.join(open_, ["band", "key"]), "open")
    # blocks get about equal shares of a bucket's outsiders by a hash, so no bucket is numbered in one task
    blocks = F.ceil(F.col("n_out") / block).cast("int")
    outsiders = open_.filter("comp != leader_comp").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    everyone = open_.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    compared = outsiders.select("band", "key", "block", F.lit(True).alias("outsider"), "node", "comp").unionByName(everyone.select("band", "key", "block", F.lit(False).alias("outsider"), "node", "comp"))
    more = links_to_outsiders(compared.join(sets, "node").select("band", "key", "block", "outsider", "node", "comp", "codes"), similarity)
    more = written(more.distinct(), "verified")
    if not more.isEmpty():
        links = links.unionByName(more)
        comps = written(connected(links), "components")
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select(F.explode(F.array("a", "b")).alias("node"))
    of_text = ends.groupBy("node").agg(F.count("*").alias("links"))
    comps = comps.join(of_text, "node", "left")
    named = comps.join(nodes.select("node", "min_doc", "h1", "h2"), "node")
    first = F.min(F.struct(F.col("min_doc").isNull(), F.col("min_doc"), F.col("h1"), F.col("h2"))).alias("first")
    classes = named.groupBy("comp").agg(first, F.count("*").alias("texts"), (F.sum("links") / 2).cast("long").alias("class_links"))
    classes = named.select("node", "comp", "links").join(classes, "comp").select("node", F.col("first.min_doc").alias("class_doc"), F.col("first.h1").alias("c1"), F.col("first.h2").alias("c2"), "texts", "class_links", "links")
    none = F.lit(0).cast("long")
    alone = (
        nodes.select("node", F.col("min_doc").alias("own"), "h1", "h2")
        .join(classes, "node", "left")
        .select(
            "node",
            F.coalesce("class_doc", "own").alias("class_id"),
            F.coalesce("texts", F.lit(1)).alias("class_texts"),
            F.coalesce("class_links", none).alias("class_links"),
            F.coalesce("links", none).alias("links"),
            F.coalesce("c1", "h1").alias("first_h1"),
            F.coalesce("c2", "h2").alias("first_h2"),
        )
    )
    out = ["doc_id", "class_id", "class_texts", "class_links", "links", "h1", "h2", "first_h1", "first_h2"]
    worded = rows_.filter("keys is not null").select("doc_id", "node", "h1", "h2").join(alone, "node").select(*out)
    plain = rows_.filter("keys is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_texts"), none.alias("class_links"), none.alias("links"), "h1", "h2", F.col("h1").alias("first_h1"), F.col("h2").alias("first_h2"))
    return worded.unionByName(plain)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class of near_duplicates: the one with the class's id and text, once; columns as before.

    Null and empty texts stay, once for each id; of repeated rows one stays; very long texts are compared whole. Columns
    may have any names. Empty table: no rows.
    """
    rows = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h1") == F.col("first_h1")) & (F.col("h2") == F.col("first_h2"))
    told = written(rows.select(F.struct("doc_id", "h1", "h2").alias("row"), stays.alias("stays")), "classes")
    (key,) = fresh(docs, "_row")
    gone = told.filter("not stays").select(F.col("row").alias(key)).distinct()
    hashes = text_hashes(F.coalesce(F.col(text_col), F.lit("")))
    left = docs.withColumn(key, F.struct(F.col(id_col).cast("long").alias("doc_id"), *hashes))
    # ids may be null, which equal nothing in a join of structs' fields, but equal each other in structs
    left = left.join(gone, key, "left_anti")
    if not told.filter("stays").groupBy("row").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([key])  # repeated rows: one stays
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
