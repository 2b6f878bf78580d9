"""MinHash near-dedup with DartMinHash signatures of weighted word shingles."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, join_salted, join_spread, stored, stored_seen, text_of, tidy
from .components import connected_components
from .sequences import _mix

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 4 coordinates miss a pair of similarity 0.8 once in 2e7.
COORDINATES, BANDS = 128, 32
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def rank_bands():
    """The intervals of the rank axis in which darts are thrown cell by cell, without end."""
    edges = [0, 0.25, 0.5, 1, 1.5, 2, 3, 4, 6, 8]
    yield from zip(edges, edges[1:], strict=False)
    at = 8.0
    while True:
        yield at, at + 8
        at += 8


@lru_cache(maxsize=256)
def _poisson(mean: float) -> np.ndarray:
    """The distribution function of Poisson(mean) at 0, 1, ..."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 20))
    return np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])))


def words_of(text: str) -> list[bytes]:
    """Runs of other than blanks, A-Z lower-cased."""
    return text.encode().lower().split()


def shingles(docs: list[list[bytes]], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle): 64-bit hashes of each document's shingles, repeated ones too, sorted by both. A document of fewer
    than n words is one shingle; one of none has none."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for d in docs for w in d]
    with np.errstate(over="ignore"):
        w = np.concatenate([pd.util.hash_array(flat, categorize=False), np.zeros(n, np.uint64)])
        owner = np.repeat(np.arange(len(docs)), sizes)
        ends = np.cumsum(sizes)
        here = np.arange(len(owner))
        left = ends[owner] - here  # words from here to the document's end
        gram = np.zeros(len(owner), np.uint64)
        for j in range(n):
            gram += np.where(j < left, w[j : j + len(owner)], np.uint64(0)) * ODD[j % 5] * np.uint64(1 + 2 * (j // 5))
        whole = (left >= n) | ((sizes[owner] < n) & (left == sizes[owner]))
        doc, gram = owner[whole], _mix(gram[whole] + np.minimum(sizes[owner[whole]], n).astype(np.uint64))
    order = np.lexsort((gram, doc))
    return doc[order], gram[order]


def _firsts(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return np.r_[True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])] if len(doc) else np.empty(0, bool)


def weighted_elements(docs: list[list[bytes]], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight): each document's different shingles and how often it has them."""
    doc, gram = shingles(docs, n)
    starts = np.flatnonzero(_firsts(doc, gram))
    return doc[starts], gram[starts], np.diff(np.r_[starts, len(doc)]).astype(np.float64)


def elements(docs: list[list[bytes]], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, element): the multiset of each document's shingles as a set of 64-bit hashes of (shingle, how often it
    came before), sorted by both. So the Jaccard index of two such sets is the weighted one of the counts."""
    doc, gram = shingles(docs, n)
    if not len(doc):
        return doc, gram
    first = _firsts(doc, gram)
    before = np.arange(len(doc)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    with np.errstate(over="ignore"):
        out = _mix(gram + before.astype(np.uint64) * ODD[1])
    order = np.lexsort((out, doc))
    return doc[order], out[order]


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers from 0 to 1."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(doc: np.ndarray, element: np.ndarray, n_docs: int, k: int = COORDINATES, seed: int = 1, weight: np.ndarray | None = None) -> np.ndarray:
    """n_docs x k ids of darts (Christiani, 2020). Darts fall on (element, weight, rank) at rate 1: a Poisson number in each
    cell of an element, an interval of weights (to 1, and then each twice as far) and one of ranks, by the cell's hash
    alone. A document's darts are those that fall below its weight of the element and below the rank at which about
    k ln k + 2k have fallen; each has a coordinate, and the earliest of each coordinate is kept. Where one is still empty,
    the rank is doubled. Two documents agree in a coordinate with the probability of their weighted similarity. Weights are
    any positive numbers, 1 if not given; an element costs its number of weight intervals. Documents without elements have
    zeros."""
    out = np.zeros((n_docs, k), np.uint64)
    weight = np.ones(len(doc)) if weight is None else np.asarray(weight, np.float64)
    total = np.bincount(doc, weight, minlength=n_docs)
    open_docs = total > 0
    throws = k * math.log(k) + 2 * k
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    base = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, base, 1.0)
    partial = bool((weight != np.floor(weight)).any() or (weight > 1).any())
    with np.errstate(over="ignore"):
        own_cell = np.where(level > 0, _mix(element[of] + ODD[0] * level.astype(np.uint64)), element[of])
        while open_docs.any():
            top = np.where(open_docs, throws / np.maximum(total, 1e-300), 0.0)
            rows = np.flatnonzero(open_docs[doc[of]])
            best, ids = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
            for number, (low, high) in enumerate(rank_bands()):
                on = top[doc[of[rows]]] > low
                if not on.any():
                    break
                if not on.all():
                    rows = rows[on]
                cell = _mix(own_cell[rows] + ODD[2] * np.uint64(number + 1) + np.uint64(seed))
                chance, wide = _unit(cell), width[rows]
                count = np.searchsorted(_poisson(high - low), chance, side="right")
                for x in np.unique(wide[wide > 1]):
                    count[wide == x] = np.searchsorted(_poisson((high - low) * x), chance[wide == x], side="right")
                own = np.repeat(np.arange(len(rows)), count)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                dart = _mix(cell[own] + ODD[3] * (nth + 1).astype(np.uint64))
                rank = low + (high - low) * _unit(dart)
                d = doc[of[rows]][own]
                hit = rank < top[d]
                own, dart, rank, d = own[hit], _mix(dart[hit] + ODD[4]), rank[hit], d[hit]
                if partial:
                    at = rows[own]
                    inside = base[at] + width[at] * _unit(_mix(dart + ODD[0])) < weight[of[at]]
                    dart, rank, d = dart[inside], rank[inside], d[inside]
                slot = d * k + (dart % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, slot, rank)
                won = best[slot] == rank
                ids[slot[won]] = dart[won]
            filled = np.isfinite(best).reshape(n_docs, k).all(axis=1) & open_docs
            out[filled] = ids.reshape(n_docs, k)[filled]
            open_docs &= ~filled
            throws *= 2
    return out


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit hash of each band's coordinates and its number."""
    n, k = signature.shape
    rows = k // bands
    parts = signature[:, : bands * rows].reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * ODD[1], (n, bands)).copy()
        for r in range(rows):
            out = _mix(out + parts[:, :, r] * ODD[r % 5])
    return out.view(np.int64)


def _blocks(texts, words: int = 60_000):
    """Lists of word lists with about so many words together."""
    got, n = [], 0
    for t in texts:
        got.append(words_of(t))
        n += len(got[-1])
        if n >= words:
            yield got
            got, n = [], 0
    if got:
        yield got


def text_key(words: list[bytes]) -> bytes:
    """128 bits of a text's words in order: texts with equal ones are exact copies here."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def signed(docs: DataFrame, n: int = SHINGLE, k: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """(id, key, bands): for each row of docs (id, text) its text's key and the hashes of its bands, none without words."""

    def run(batches):
        for b in batches:
            at = 0
            for block in _blocks(x.as_py() for x in b.column(1)):
                doc, element, weight = weighted_elements(block, n)
                hashes = band_hashes(dart_signatures(doc, element, len(block), k, weight=weight), bands)
                keep = np.array([len(x) > 0 for x in block])
                flat, ends = hashes[keep].ravel(), np.cumsum(np.r_[0, np.where(keep, bands, 0)]).astype(np.int32)
                keys = pa.array(map(text_key, block), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(block)), keys, pa.ListArray.from_arrays(ends, pa.array(flat))], ["id", "key", "bands"])
                at += len(block)
            tidy()

    return docs.select("id", "text").mapInArrow(run, "id long, key binary, bands array<long>")


def element_sets(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(key, elements): docs (id, text) as sorted 64-bit elements, for the exact check."""

    def run(batches):
        for b in batches:
            for block in _blocks(x.as_py() for x in b.column(1)):
                doc, element = elements(block, n)
                cuts = np.cumsum(np.bincount(doc, minlength=len(block)))[:-1]
                sets = [x.tobytes() for x in np.split(element, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(map(text_key, block), pa.binary()), pa.array(sets, pa.binary())], ["key", "elements"])
            tidy()

    return docs.select("id", "text").mapInArrow(run, "key binary, elements binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b, of the pairs (hub, key) whose sets are at least so similar. A hub that very many pairs share has its
    set in several tasks."""

    def run(batches):
        for b in batches:
            hit = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                hit.append(jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))
            tidy()

    ends = pairs.select(F.col("hub").alias("key"), F.col("key").alias("other"))
    left = join_salted(ends, sets.select("key", F.col("elements").alias("x")), "key", F.xxhash64("other"))
    both = left.select(F.col("key").alias("hub"), "x", F.col("other").alias("key")).join(sets.select("key", F.col("elements").alias("y")), "key")
    return both.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"), "x", "y").mapInArrow(run, "a binary, b binary")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray], alone: bool) -> np.ndarray:
    """How many elements each set of x shares with each of y, by matrix products over the elements that both sides have
    (alone: x is y; those that two sets have)."""
    fx, fy = np.concatenate(x), np.concatenate(y)
    ux, nx = np.unique(fx, return_counts=True)
    columns = ux[nx > 1] if alone else np.intersect1d(ux, np.unique(fy))
    out = np.zeros((len(x), len(y)), np.float32)
    for c in range(0, len(columns), 4096):
        part = columns[c : c + 4096]

        def matrix(sets, flat, part=part):
            at = np.searchsorted(part, flat)
            hit = part[np.minimum(at, len(part) - 1)] == flat
            m = np.zeros((len(sets), len(part)), np.float32)
            m[np.repeat(np.arange(len(sets)), [len(z) for z in sets])[hit], at[hit]] = 1
            return m

        mx = matrix(x, fx)
        out += mx @ (mx if alone else matrix(y, fy)).T
    return out


def _rest(star: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float, block: int = 256, block_bytes: int = 4 << 20) -> DataFrame:
    """(hub, key): the pairs of different classes so far that were compared with one hub (all that share a bucket were) and
    whose sets overlap enough.

    Only hubs whose partners are of more than one class count. Sets can only be so similar if their sizes are, so partners
    are dealt by size into steps of one similarity, and meet those of their own step and the next on either side; within a
    step into blocks of about `block` sets and block_bytes. Blocks of those outside the hub's largest class meet all blocks,
    and are compared as matrices. A row is a pair of blocks, so no group is gathered whole and no pair that fails is a row.
    """
    own = star.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = own.groupBy("hub", "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy("hub").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("classes"), F.sum("n").alias("n"))
    top, _ = stored(top.filter("classes > 1").select("hub", "top", "n"), "tops")
    own = join_spread(own, top, "hub", F.col("n"), top.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    step = F.floor(F.log(F.octet_length("elements") / 8.0) / (math.log(1 / similarity) * (1 + 1e-9))).cast("int")
    own = own.select("hub", "key", "label", (F.col("label") != F.col("top")).alias("minor")).join(sets, "key").withColumn("step", step)
    parts = own.groupBy("hub", "step", "minor").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.octet_length("elements")) / block_bytes)).alias("parts"))
    dealt = own.join(parts, ["hub", "step", "minor"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    blocks, _ = stored(dealt.groupBy("hub", "step", "minor", "part").agg(F.collect_list(F.struct("key", "label", "elements")).alias("rows")), "blocks")
    left = blocks.filter("minor").select("hub", F.col("step").alias("s"), F.col("part").alias("p"), F.col("rows").alias("x"), F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    right = blocks.select("hub", "step", F.col("part").alias("q"), F.col("minor").alias("m"), F.col("rows").alias("y"))
    met = left.join(right, ["hub", "step"]).filter("not m or (s, p) <= (step, q)").select("x", "y", F.expr("m and s = step and p = q").alias("alone"))

    def run(batches):
        for b in batches:
            for x, y, alone in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                x, y = x.values, y.values
                one, two = ([np.frombuffer(e.as_buffer(), np.uint64) for e in z.field("elements")] for z in (x, y))
                nx, ny = (np.array([len(e) for e in z]) for z in (one, two))
                least = (nx[:, None] + ny[None, :]) * (similarity / (1 + similarity)) - 1e-3
                la, lb = (np.array(z.field("label").to_pylist(), dtype=object) for z in (x, y))
                hit = (_overlaps(one, two, alone) >= least) & (la[:, None] != lb[None, :])
                ka, kb = (z.field("key").to_pylist() for z in (x, y))
                out = {(min(ka[i], kb[j]), max(ka[i], kb[j])) for i, j in zip(*np.nonzero(hit), strict=True)}
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.binary()) for z in zip(*out, strict=True)], ["hub", "key"])
            tidy()

    return met.mapInArrow(run, "hub binary, key binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n: int = SHINGLE, k: int = COORDINATES, bands: int = BANDS) -> DataFrame:
    """(doc_id, class_id, class_size): one row for each row of docs; class_id is the least doc_id of its class.

    Texts with the same words (between blanks, A-Z lower-cased) are copies and count as one. Two texts are linked if the
    weighted Jaccard index of their n-word shingles, counted, is at least `similarity`; classes are the components of links.
    Texts that agree in a band share a bucket. In each bucket all are compared exactly with one hub, the text that has
    most company over all its buckets (in a group of edited copies that is their original). Pairs of a bucket that are in
    one class then need no comparison; all others are compared by overlap, block by block, and exactly where that is
    enough. So no bucket is gathered and none of its pairs is left out. Texts of fewer than n words are one shingle;
    texts without words, null ones too, are copies of each other. A row of null id has the class of its text, null if no
    id has any text of the class; links through such texts count. Rows that repeat an id each count. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    sig, _ = stored(signed(rows, n, k, bands), "darts")
    texts, texts_path = stored(sig.groupBy("key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "texts")
    of_bucket = texts.select("key", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "key")
    counts, counts_path, seen = stored_seen(of_bucket.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets", n=F.sum("n"))
    shared = seen["n"] or 0
    members, members_path = stored(join_spread(of_bucket, counts, "bucket", F.col("n"), shared), "members")
    company, company_path = stored(members.groupBy("key").agg(F.sum("n").alias("company")), "company")
    hubs, hubs_path = stored(members.join(company, "key").groupBy("bucket", "n").agg(F.max_by("key", F.struct("company", "key")).alias("hub")), "hubs")
    met = join_spread(members.select("bucket", "key"), hubs, "bucket", F.col("n"), shared)
    star, star_path = stored(met.filter("key <> hub").select("hub", "key").distinct(), "star")
    pairs, pairs_path = stored(star.groupBy(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).agg(F.first("hub").alias("hub"), F.first("key").alias("key")).select("hub", "key"), "pairs")
    wanted = texts.join(company, "key", "left_semi").select(F.col("rep").alias("id")).distinct()
    chosen = rows.join(wanted.withColumnRenamed("id", "__wanted"), F.col("id").eqNullSafe(F.col("__wanted")), "left_semi")
    sets, sets_path = stored(element_sets(chosen, n).dropDuplicates(["key"]), "sets")
    links, links_path = stored(_verified(pairs, sets, similarity), "links")
    labels = connected_components(links, "a", "b", "near").select(F.col("id").alias("key"), F.col("component").alias("label"))
    rest, rest_path = stored(_rest(star, labels, sets, similarity), "rest")
    more, more_path, seen = stored_seen(_verified(rest, sets, similarity), "links", n=F.count("*"))
    if seen["n"]:
        labels = connected_components(links.unionAll(more), "a", "b", "near").select(F.col("id").alias("key"), F.col("component").alias("label"))
    of_text = texts.select("key", "rep").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = sig.groupBy("key").agg(F.count("*").alias("n"))
    sized, sized_path, seen = stored_seen(of_text.join(sizes, "key"), "sized", n=F.sum("n"), texts=F.count("*"))
    of_class = sized.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts"))
    classes, _ = stored(join_spread(sized, of_class, "label", F.col("n_texts"), seen["texts"] or 0).select("key", "n", "class_id", "class_size"), "classes")
    for p in (texts_path, counts_path, members_path, company_path, hubs_path, star_path, pairs_path, sets_path, links_path, rest_path, more_path, sized_path):
        drop_dir(spark, p)
    return join_spread(sig.select(F.col("id").alias("doc_id"), "key"), classes, "key", F.col("n"), seen["n"] or 0).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near duplicates: of each class the rows of its least doc_id stay, and rows of null id."""
    gone = near_duplicates(docs, id_col, text_col, **options).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct().hint("merge")  # it grows with the corpus
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
