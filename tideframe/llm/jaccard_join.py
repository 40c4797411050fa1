"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles. Two documents link when intersection / union reaches the threshold.
For sets of n1 and n2 shingles that bounds the symmetric difference by (100 - T) / (100 + T) * (n1 + n2) for T percent.

Sketches. Sets are banded by size. In a band whose largest linked difference is d, every shingle XORs its hash into one
of k > d blocks. Each shingle that two sets don't share changes one block at most, so the number of unequal blocks is a
lower bound of the difference, and by the pigeonhole principle linked sets have an equal block. Empty blocks tell
nothing; k leaves room for them, and a set that has too many of them joins on its empty blocks too, so no link is lost.
A set near the top of its band is also sketched for the next band, where its larger partners are.

Jobs: (1) documents with equal sets become one class, held by the smallest id; (2) a pre-aggregated grouping finds the
block values of two or more classes, and a join brings them to their classes; (3) within each block value all classes
are held against the smallest one: first by parity bit sketches (one bit per shingle, whose Hamming distance also bounds
the difference from below), then exactly, on the texts; verified links give components; (4) where the other classes of
one block value are of several components, pairs across these are compared by sketches, in tiles of bounded size. A block
value of so many classes that each would stand in more tiles than it has shingles is first cut by shingles: two linked
sets share one among the first of each in any common order, so with the value's common shingles put last only classes
that share a rare one still meet. Each tile first gives only a forest of the pairs that pass, one pair at most for each component it could join, and these are
verified exactly; only tiles that gave any, of block values that still hold several components, are compared again under
the new ones, for all pairs that still pass;
(5) final components. Copies and linked families are never expanded into all pairs.

Defined results: null or empty text and text of white space have an empty set, link with nothing and are their own
component; fewer words than a shingle make one shingle of the whole sequence; rows that repeat a ``doc_id`` with the
same text are one document of which each row is returned; rows without a ``doc_id`` link with nothing; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.components import components
from tideframe.llm.shared import documents, prepare, small, stored, with_owner
from tideframe.llm.textops import LOWER_CODE, Words, chunks, mix, pair, text_buffers

_U = np.uint64
#: Documents of one block value that are compared with each other in one task.
TILE = 2048
#: Classes of one block value that are dealt to tiles as they are in any case, and the share of them that a common shingle is in.
CROWD, COMMON = 8192, 0.01
#: Members that are held against one centre in one task.
SALT = 256
#: Rows of such tiles, of many block values, that one task handles at once.
LOT = 10000


class Bands:
    """Size bands of ratio sqrt(2) and their numbers of blocks for a threshold in percent."""

    def __init__(self, percent: int):
        if not 71 <= percent <= 100:
            raise ValueError("thresholds of 71 to 100 percent: a partner is in the same band or the next")
        self.percent = percent
        self.low = np.unique(np.ceil(2.0 ** (np.arange(0, 96) / 2) - 1e-9).astype(np.int64))
        self.high = np.append(self.low[1:] - 1, np.iinfo(np.int32).max)
        self.most = (100 - percent) * 2 * self.high // (100 + percent)
        # enough blocks that the smallest sets of a band, but for chance, fill more than the largest difference
        least, k, need = self.low * (percent / 100), self.most + 1, np.flatnonzero(self.most > 0)
        while len(need):
            empty = k[need] * np.exp(-least[need] / k[need])
            need = need[(k[need] - empty - 2 * np.sqrt(empty) < self.most[need] + 1) & (k[need] < 2 * self.most[need] + 4)]
            k[need] += np.maximum(1, k[need] // 64)
        self.blocks = np.where(self.most > 0, k, 0)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def guest(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Sets that may link with one of the next band."""
        return n * 100 >= self.percent * self.low[np.minimum(band + 1, len(self.low) - 1)]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes with their document, ordered by both, and the number in each document."""
    h = w.hashes(LOWER_CODE)
    doc = w.doc_of()
    out = h
    for k in range(1, size):
        out = pair(out[: max(0, len(h) - k)], h[k:], k)
    whole = doc[: len(out)] == doc[size - 1 :][: len(out)]
    out, at = out[whole], doc[: len(out)][whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        total = np.zeros(len(short), _U)
        for k in range(size - 1):
            has = w.counts[short] > k
            total[has] = pair(total[has], h[w.first[short[has]] + k], 20 + k)
        out, at = np.append(out, total), np.append(at, short)
    order = np.lexsort((out, at))
    out, at = out[order], at[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (at[1:] != at[:-1])
    out, at = out[new], at[new]
    return out, at, np.bincount(at, minlength=len(w.counts))


def _profiles(size: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = text_buffers(batch.column(1))
            for lo, hi in chunks(bounds):
                h, at, n = shingles(Words(flat, bounds, lo, hi), size)
                a, b = np.zeros(hi - lo, _U), np.zeros(hi - lo, _U)
                np.bitwise_xor.at(a, at, mix(h + _U(1)))
                np.add.at(b, at, mix(h + _U(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "n_shingles", "set_a", "set_b"])

    return job


def block_values(h: np.ndarray, at: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit block values, document of each) over a document's own band and, near its top, the next one."""
    keys, docs = [], []
    own = bands.of(np.maximum(n, 1))
    for band, use in ((own, n > 0), (own + 1, (n > 0) & bands.guest(n, own))):
        band = np.minimum(band, len(bands.low) - 1)
        k = np.where(use, bands.blocks[band], 0)
        base = np.r_[0, np.cumsum(k)]
        if not base[-1]:
            continue
        mine = k[at] > 0
        x, d = h[mine], at[mine]
        slot = base[d] + ((x >> _U(20)) % k[d].astype(_U)).astype(np.int64)
        value = np.zeros(base[-1], _U)
        np.bitwise_xor.at(value, slot, mix(x + _U(3)))
        filled = np.bincount(slot, minlength=base[-1]) > 0
        owner = np.repeat(np.arange(len(n)), k)
        enough = np.bincount(owner, weights=filled, minlength=len(n)) > bands.most[band]
        emit = filled | ~enough[owner]
        place = (np.arange(base[-1]) - base[owner]).astype(_U)
        key = pair(value, place * _U(128) + band[owner].astype(_U), 9) >> _U(16)
        keys.append(key[emit].view(np.int64))
        docs.append(owner[emit])
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(size: int, percent: int):
    bands = Bands(percent)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(bounds):
                key, doc = block_values(*shingles(Words(flat, bounds, lo, hi), size), bands)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[lo:hi][doc])], ["key", "doc_id"])

    return job


def _parity(size: int, percent: int):
    """Parity bit sketches of four to twelve bits a shingle, a power of two of them: few shingles share a bit, so that the
    distance of two sketches is hardly less than that of the sets, and few pairs pass that do not link."""
    bands = Bands(percent)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = text_buffers(batch.column(1))
            for lo, hi in chunks(bounds):
                h, at, n = shingles(Words(flat, bounds, lo, hi), size)
                bits = np.maximum(64, 1 << np.ceil(np.log2(4 * bands.high[bands.of(np.maximum(n, 1))])).astype(np.int64))
                base = np.r_[0, np.cumsum(bits)]
                spot = base[at] + (mix(h + _U(4)) & (bits[at] - 1).astype(_U)).astype(np.int64)
                odd = np.packbits(np.bincount(spot, minlength=base[-1]).astype(np.uint8) & 1)
                rows = [odd[base[i] // 8 : base[i + 1] // 8].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(rows, pa.binary())], ["doc_id", "n", "sketch"])

    return job


def _every(size: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(bounds):
                h, at, n = shingles(Words(flat, bounds, lo, hi), size)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][at]), pa.array(n[at].astype(np.int64)), pa.array(h.view(np.int64))], ["doc_id", "n", "h"])

    return job


def _by_rare_shingles(docs: DataFrame, crowd: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, doc_id, comp) of crowded block values cut by the shingles of their classes.

    Of n shingles the first n - ceil(percent * n / 100) + 1 are kept, in an order that puts common ones last.
    """
    wanted = stored(crowd.select("doc_id").distinct(), "crowded")
    each = docs.join(small(wanted, 16), "doc_id").mapInArrow(_every(size), "doc_id long, n long, h long")
    rows = crowd.join(each, "doc_id")
    common = rows.groupBy("key", "h").agg(F.count("*").alias("c"), F.max("members").alias("members")).where(F.col("c") > COMMON * F.col("members"))
    common = stored(common.select("key", "h", F.lit(1).alias("common")), "common-shingles")
    place = F.row_number().over(Window.partitionBy("key", "doc_id").orderBy(F.coalesce("common", F.lit(0)), "h"))
    rows = rows.join(small(common, 32), ["key", "h"], "left").withColumn("place", place)
    first = rows.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return first.select(F.xxhash64("key", "h").alias("key"), "doc_id", "comp")


def _mixed(marked: DataFrame) -> DataFrame:
    """The rows (key, doc_id, comp) of block values with several components, with the number of classes."""
    mixed = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("members")).where("low < high")
    return marked.join(mixed.select("key", "members"), "key")


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _within(ids, comp, n, bits, left: np.ndarray, right: np.ndarray, same: bool, percent: int, forest: bool) -> np.ndarray:
    """Pairs of one key's tile, across components, whose sketches may belong to linked sets; in a forest only the first pair
    that could join two components, so fewer pairs than there are components."""
    out = []
    comp = comp.copy()
    for x in left:
        y = right[ids[right] > ids[x]] if same else right
        y = y[comp[y] != comp[x]]
        most = (100 - percent) * (n[y] + n[x]) // (100 + percent)
        near = np.abs(n[y] - n[x]) <= most
        y, most = y[near], most[near]
        y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(1) <= most]
        if forest and len(y):
            joined, first = np.unique(comp[y], return_index=True)
            y = y[first]
            comp[np.isin(comp, joined)] = comp[x]
        out.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _tile(percent: int, forest: bool):
    def job(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
        key, i, j, side, ids, comp, n = (table.column(c).to_numpy() for c in ("key", "i", "j", "tile", "doc_id", "comp", "n"))
        sketches = table.column("sketch").to_pylist()
        cut = np.r_[0, np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1, len(key)]
        pairs, where = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo > 1:
                raw = [np.frombuffer(x, np.uint8) for x in sketches[lo:hi]]
                size = min(map(len, raw))
                bits = np.stack([_fold(x, size) for x in raw])
                left, right = np.flatnonzero(side[lo:hi] == i[lo]), np.flatnonzero(side[lo:hi] == j[lo])
                pairs.append(_within(ids[lo:hi], comp[lo:hi], n[lo:hi], bits, left, right, i[lo] == j[lo], percent, forest))
                where.append(np.full(len(pairs[-1]), lo))
        both, at = np.concatenate(pairs), np.concatenate(where)
        return pa.table({"key": pa.array(key[at]), "i": pa.array(i[at], pa.int32()), "j": pa.array(j[at], pa.int32()), "a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    return job


def _screen(percent: int):
    """Pairs (a, b) with sizes and sketches of both: those that may be linked."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = (100 - percent) * (n1 + n2) // (100 + percent)
            ok = np.abs(n1 - n2) <= most
            first, second = batch.column(4), batch.column(5)
            for k in np.flatnonzero(ok):
                x, y = np.frombuffer(first[k].as_buffer(), np.uint8), np.frombuffer(second[k].as_buffer(), np.uint8)
                size = min(len(x), len(y))
                ok[k] = np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum() <= most[k]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return job


def shingle_set(text: str | bytes | None, size: int) -> set[bytes]:
    """The distinct shingles of a text, as bytes."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)}


def _verify(size: int, percent: int):
    """One centre's text (where doc_id is the centre) against its members' texts."""

    def job(key: tuple, table: pa.Table) -> pa.Table:
        centre = key[0].as_py()
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary())
        own = shingle_set(texts[ids.index(centre)].as_py(), size)
        out = []
        for i, text in zip(ids, texts, strict=True):
            if i != centre:
                other = shingle_set(text.as_py(), size)
                both = len(own & other)
                if both and 100 * both >= percent * (len(own) + len(other) - both):
                    out.append(i)
        return pa.table({"a": pa.array([centre] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return job


def _linked(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) that link, verified on the texts; hot centres are dealt over many tasks."""
    pairs = stored(pairs.distinct(), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    spread = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.col("b").alias("doc_id"))
    centres = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("a").alias("doc_id"))
    wanted = stored(spread.union(centres), "to-verify")
    found = docs.join(small(wanted, 40), "doc_id").select("a", "salt", "doc_id", "text")
    return found.groupBy("a", "salt").applyInArrow(_verify(size, percent), "a long, b long")


def _lots(left: DataFrame) -> DataFrame:
    """Each row of ``left`` in all tile pairs of its key, which are dealt into lots of about LOT rows each.

    A row comes as often as its key has tiles, so the lots are counted by these.
    """
    rows = left.agg(F.sum(F.col("tiles").cast("long"))).first()[0] or 0
    left = left.withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left = left.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    return left.withColumn("lot", F.pmod(F.xxhash64("key", "i", "j"), F.lit(-(-rows // LOT) or 1))).drop("other", "tiles")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of ``docs``, which has ``doc_id`` and ``text``."""
    prepare(docs.sparkSession)
    docs = documents(docs, "doc_id", "text")
    profile = stored(docs.mapInArrow(_profiles(size), "doc_id long, n_shingles long, set_a long, set_b long"), "profiles")
    sets = profile.where("n_shingles > 0 and doc_id is not null").select("set_a", "set_b", "doc_id")
    copies = with_owner(sets, ["set_a", "set_b"], "doc_id").where("doc_id > owner").select("doc_id", F.col("owner").alias("class_id"))
    copies = stored(copies.distinct(), "copies")

    docs = docs.where("doc_id is not null")
    blocks = docs.mapInArrow(_blocks(size, percent), "key long, doc_id long")
    shared = blocks.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    hits = blocks.join(shared, "key").join(small(copies, 24), "doc_id", "left")
    hits = stored(hits.select("key", F.coalesce("class_id", "doc_id").alias("doc_id")).distinct(), "hits")
    centres = hits.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("high")).where("a < high").drop("high")
    members = stored(hits.join(centres, "key").where("a < doc_id"), "members")
    one = docs.dropDuplicates(["doc_id"]) if profile.groupBy("doc_id").count().where("count > 1").limit(1).count() else docs
    wanted = stored(members.select("doc_id").union(members.select("a")).distinct(), "wanted")
    sketches = one.join(small(wanted, 16), "doc_id").mapInArrow(_parity(size, percent), "doc_id long, n long, sketch binary")
    sketches = stored(sketches, "sketches")

    stars = members.select("a", F.col("doc_id").alias("b")).distinct()
    of = lambda k: sketches.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    stars = stars.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_screen(percent), "a long, b long")
    links = stored(_linked(one, stars, size, percent), "links")

    # the smallest class of each block value has met all others; among these, pairs across components remain
    comp = components(links)
    marked = members.join(small(comp, 24), members["doc_id"] == comp["v"], "left").select("key", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    left = stored(_mixed(marked), "across")
    large = left.where(F.col("members") > CROWD)
    if not large.isEmpty():  # the tiles of a class against the shingles it has
        cost = large.join(sketches.select("doc_id", "n"), "doc_id").groupBy("key").agg(F.avg("n").alias("n"), F.max("members").alias("members"))
        keys = small(stored(cost.where(F.col("members") > TILE * F.col("n")).select("key"), "crowded-values"), 16)
        crowd = left.join(keys, "key", "left_semi")
        if not crowd.isEmpty():
            cut = stored(_by_rare_shingles(one, crowd, size, percent), "rare-shingles")
            left = stored(left.join(keys, "key", "left_anti").unionByName(_mixed(cut)), "across")
    tiled = lambda rows: _lots(rows.withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int")).drop("members"))
    tile = ["lot", "key", "i", "j", "tile", "doc_id", "comp", "n", "sketch"]
    pair = "key long, i int, j int, a long, b long"
    forest = stored(tiled(left).join(sketches, "doc_id").select(*tile).groupBy("lot").applyInArrow(_tile(percent, True), pair), "forest")
    busy = stored(forest.select("key", "i", "j").distinct(), "busy-tiles")
    if not busy.isEmpty():
        links = links.union(stored(_linked(one, forest.select("a", "b"), size, percent), "links"))
        now = stored(components(links).select(F.col("v").alias("doc_id"), F.col("comp").alias("now")), "components")
        # block values that the forest has joined into one component need no second comparison
        again = left.drop("members").join(small(now, 24), "doc_id", "left").select("key", "doc_id", F.coalesce("now", "doc_id").alias("comp"))
        again = tiled(stored(_mixed(again), "still-across")).join(small(busy, 24), ["key", "i", "j"], "left_semi")
        across = again.join(sketches, "doc_id").select(*tile).groupBy("lot").applyInArrow(_tile(percent, False), pair).select("a", "b").join(forest.select("a", "b").distinct(), ["a", "b"], "left_anti")
        links = links.union(stored(_linked(one, across, size, percent), "links"))
        comp = components(links)
    comp = stored(comp, "components")
    out = profile.join(small(copies, 24), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(small(comp, 24), out["class_id"] == comp["v"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "class_id").alias("component_id"), "class_id")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that link, directly or not, with a document of a smaller id; all columns stay."""
    gone = near_duplicates(docs, size, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(small(stored(gone, "near-duplicates"), 16), "doc_id", "left_anti").select(*docs.columns)
