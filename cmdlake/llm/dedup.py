"""Operator 2: near-duplicates by Order MinHash, verified by banded alignment.

Two texts are linked if the edit distance of their lower-cased words is at most
(1 - SIMILARITY) of the longer one's words. Copies of one text are one text from the
start, known by its digest.

Candidates: shingles of five words are labelled by occurrence; each of BANDS hash
functions picks its LEAST smallest ones, and their hashes in text order are the band's
value; each of SINGLES more hash functions gives its smallest shingle as a value, which
reaches pairs near SIMILARITY. Texts of up to SHORT words, where a few edits touch every
shingle of five, have as many values of shingles of two besides (of two texts that can be
linked, one of 30 words or fewer has no partner above SHORT). A sketch can still miss a
pair: one edit in every five words, evenly spaced, leaves no common shingle of five (the
README has the recall measured). Texts with an equal value share a bucket; of buckets with
the same members one is kept.

Rounds, whose comparisons grow with the members, not with their pairs: first each member
meets the bucket's leader, the member that shares most buckets (of edited copies the one
that the others come from); then, in buckets that still hold several components, each
member outside the largest one meets members of it that hashes choose, MEETINGS times.
What is left is every pair of a bucket that lies in two components. Buckets up to SMALL
members are paired as they are; of those up to MIDDLE, bags meet in a group for each
bucket and only pairs that may be near come out. In a larger one (unlike texts with a common line or
passage) a pair can only be linked if most pairs of neighbouring words are common to both
(an edit touches two), so that one of each text's rarest is among the other's rarest: an
exact prefix filter, by the order of how many texts have a cell of CELLS (any one order is
right, and pairs of a common line come last). Members go to the keys of their rarest pairs
of words, as a hash of the text and a sign, and meet there: 64 bits, one for each of the
crowded buckets a text is in, as only texts of one bucket are a pair. What two texts of
equal hashes make is more pairs. So no link of a bucket is lost, and no bucket's pairs are
written out. Keys with more than SMALL members are paired in tiles of about TILE x TILE, each a
group of its own; a pair that has several such keys meets at the first one, as far as the
keys before are the same. Numbers of words
and the bags of words' hashes, counted into BAG cells or as many as a longer text has
words, rule out pairs before any text is read (both bound the edit distance from below).
Pairs get their bags, and then their texts, in portions whose shuffles hold a PART of the
corpus, however many pairs there are; only texts whose hash is that of a pair's go there.

Verification: common ends are dropped, a bag distance bounds the edit distance from
below, and what is left goes through a bit-parallel alignment of the band of
diagonals that so many edits can reach.

Classes: connected components of the links, by a worker for up to EDGES of them, else by
alternating large-star and small-star steps on tables in the shared folder; nothing of the
corpus goes to the driver.

Defined cases: a text of one to four words has one shingle, all of it; texts without
words are linked to their exact copies only; a null text is a class of its own; class_id
is the smallest doc_id of the class (null only if all are); repeated rows are copies;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._shared import forget, released, settings, written

#: Words of a shingle and the similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands, and shingles picked by each.
BANDS, LEAST = 24, 2
#: Bands of one shingle; words up to which a text has such bands of shingles of two words as well.
SINGLES, SHORT = 24, 38
#: Cells of a bag, and those a long text's may have (a power of two); members of a bucket up to which a plain join pairs them; members of a tile's side.
BAG, BAG_MOST, SMALL, TILE = 256, 1 << 14, 16, 256
#: Rounds of meetings with the largest component; a bucket's members of it that can be met; cells of the grams' counts, and those of a row of them.
MEETINGS, MET, CELLS, CELL_ROW = 1, 8, 1 << 22, 1 << 15
#: Parts that the edges of one centre are dealt to; edges up to which a single worker finds the components (its memory was not measured).
SALTS, EDGES = 8, 1 << 19
#: The share of the corpus' words that pairs carry through a shuffle at once, and so many words at least; rows of 64 slots of the texts' hashes.
PART, PART_LEAST, SLOTS = 1 / 4, 4_000_000, 1 << 17
#: Words up to which the texts of pairs are sent to the workers whole; members of a bucket up to which their bags meet in one group.
AT_HAND, MIDDLE = 2_000_000, 256
#: Rows and bytes of whole texts that are sent to a Python worker at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}

_RNG = np.random.default_rng(20_011)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 1 << 63, 64 + BANDS + 2 * SINGLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse."""

    def __init__(self):
        self.n, self.up, self.down = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def at_least(self, n: int):
        if n >= len(self.up):
            grow = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, b, np.uint64)]), dtype=np.uint64)
            self.up, self.down = grow(np.uint64(_BASE)), grow(np.uint64(pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    space = np.concatenate([[True], _SPACE[data], [True]])
    turn = np.flatnonzero(space[1:] != space[:-1])
    if not turn.size:
        return np.zeros(0, np.uint64)
    begin, end = turn[::2], turn[1::2]
    up, down = _POWERS.at_least(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    return _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _shingles(w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of k words, in text order; the same labelled by occurrence."""
    k = min(k, len(w))
    g = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        g += w[i : len(w) - k + 1 + i] * _ODD[i]
    g = _mix(g)
    order = np.argsort(g, kind="stable")
    same = np.concatenate([[False], g[order][1:] == g[order][:-1]])
    labelled = _mix(g)
    if same.any():  # the occurrence: places since the run of equal ones began
        place = np.arange(len(g))
        nth = np.empty(len(g), np.uint64)
        nth[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(np.uint64)
        labelled = _mix(g + nth * _ODD[8])
    return g, labelled


def _smallest(labelled: np.ndarray, first: int) -> np.ndarray:
    """The smallest shingle by each of SINGLES hash functions, as values of bands of their own."""
    out, step = np.empty(SINGLES, np.uint64), SINGLES if len(labelled) < 40_000 else 1
    for lo in range(0, SINGLES, step):
        v = labelled[None, :] * _ODD[first + lo : first + lo + step, None]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        out[lo : lo + step] = v.min(1)
    return _mix(out + np.arange(first, first + SINGLES, dtype=np.uint64) * _ODD[11])


def sketch(text: str) -> tuple[int, np.ndarray, bytes]:
    """Number of words; the bands' values (none if there are no words); the bag: how many words' hashes fall in each cell."""
    w = word_hashes(text)
    if not len(w):
        return 0, np.zeros(0, np.int64), bytes(BAG)
    cells = max(BAG, min(BAG_MOST, 1 << len(w).bit_length()))
    bag = np.minimum(np.bincount((w & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()
    g, labelled = _shingles(w, SHINGLE)
    least = min(LEAST, len(g))
    picked = np.empty((BANDS, least), np.int64)
    step = BANDS if len(g) < 40_000 else 1
    for lo in range(0, BANDS, step):
        v = labelled[None, :] * _ODD[64 + lo : 64 + lo + step, None]
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        picked[lo : lo + step] = np.argpartition(v, least - 1, axis=1)[:, :least]
    picked.sort(axis=1)
    value = np.zeros(BANDS, np.uint64)
    for i in range(least):
        value = _mix(value * _ODD[9] + g[picked[:, i]])
    bands = [_mix(value + np.arange(BANDS, dtype=np.uint64) * _ODD[10]), _smallest(labelled, 64 + BANDS)]
    if len(w) <= SHORT:
        bands.append(_smallest(_shingles(w, 2)[1], 64 + BANDS + SINGLES))
    return len(w), np.concatenate(bands).view(np.int64), bag


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lo in range(0, len(b), 1000):
            some = b.iloc[lo : lo + 1000]
            got = [sketch(t) if isinstance(t, str) else (0, np.zeros(0, np.int64), bytes(BAG)) for t in some["text"]]
            yield pd.DataFrame({"text_key": some["text_key"].to_numpy(), "n_words": [n for n, _, _ in got], "bands": [np.unique(x) for _, x, _ in got], "bag": [x for _, _, x in got]})


def grams(text: str, similarity: float) -> np.ndarray:
    """Hashes of the pairs of neighbouring words (of a lone word, or where so few must be alike that no pair need be: of words)."""
    w = word_hashes(text)
    if len(w) < 2 or similarity < 0.75:
        return w
    return _mix(w[:-1] * _ODD[12] + w[1:] * _ODD[13])


def _cells(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How many texts of a task have a gram in each cell of its hash, 255 at most (only the order of the cells is
        read off them); a row for each CELL_ROW cells in which there is one."""
        n = np.zeros(CELLS, np.uint32)
        for b in batches:
            for t in b["text"]:
                n[np.unique(grams(t, similarity) & np.uint64(CELLS - 1)).astype(np.int64)] += 1
        for at in range(0, CELLS, CELL_ROW):
            if n[at : at + CELL_ROW].any():
                yield pd.DataFrame({"at": [at], "n": [np.minimum(n[at : at + CELL_ROW], 255).astype(np.uint8).tobytes()]})

    return run


def _sum_cells(g: pd.DataFrame) -> pd.DataFrame:
    """The counts of all tasks, as a byte of their logarithm."""
    n = sum(np.frombuffer(x, np.uint8).astype(np.int64) for x in g["n"])
    return pd.DataFrame({"at": g["at"].iloc[:1], "n": [np.minimum(12 * np.log2(1 + n), 255).astype(np.uint8).tobytes()]})


def rarest(text: str, n_words: int, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Hashes of the grams, labelled by occurrence, that come first by the counts of their cells: so many that any
    text within the similarity has one of them among its own. An edit touches at most two pairs (one word), so of the
    longer text's grams all but twice (once) the edits allowed are common to both."""
    g = grams(text, similarity)
    labelled, touched = _shingles(g, 1)[1], 1 if len(g) == n_words else 2
    longer = np.arange(n_words, int(n_words / similarity) + 2)
    common = int((longer - (n_words - len(g)) - touched * np.floor(longer - similarity * longer + 1e-9)).min())
    order = np.lexsort((labelled, counts[(g & np.uint64(CELLS - 1)).astype(np.int64)]))
    out = np.sort(labelled[order[: len(g) - max(common, 1) + 1]].view(np.int64))
    return np.where(out == 0, 1, out)  # 0 says that there is no key


def _rarest(shared, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["id", "sign", "n_words", "root"]].assign(keys=[rarest(t, n, shared.value, similarity) for t, n in zip(b["text"], b["n_words"])])

    return run


def keys(docs: DataFrame) -> DataFrame:
    """docs with text_key: the digest of the text; a null text has one of its own id."""
    null = F.concat(F.lit("null:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.withColumn("text_key", F.unhex(F.md5(F.coalesce(F.concat(F.lit("text:"), F.col("text")), null).cast("binary"))))


def within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance of two lists is at most so much."""
    if abs(len(a) - len(b)) > most:
        return False
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if max(len(a), len(b)) <= most:
        return True
    bag = Counter(a)
    bag.subtract(b)
    if max(sum(v for v in bag.values() if v > 0), -sum(v for v in bag.values() if v < 0)) > most:
        return False
    return _banded(a, b, most) <= most if len(a) >= len(b) else _banded(b, a, most) <= most


def _banded(a: list, b: list, most: int) -> int:
    """Edit distance of a (the longer, more than most) and b, or a number above most. Only the
    diagonals within most of the main one are computed, a column of them as the bits of integers
    (vertical and horizontal differences); the distance is followed down the outermost diagonal,
    then along the last row."""
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    up, down, at = (full << (width - most - 1)) & full, 0, most
    shift, last = most + 1 - width, top >> 1
    limit = 2 * most + len(b) - len(a)
    for j, x in enumerate(b):
        s = shift + j
        m = where.get(x, 0)
        m = (m >> s if s >= 0 else m << -s) & full
        d = ((((m & up) + up) & full) ^ up) | m | down
        right, left = down | (full & ~(d | up)), d & up
        if j < len(a) - most:
            at += not d & top
            if at > limit:
                return most + 1
        else:
            at += bool(right & last) - bool(left & last)
            last >>= 1
        d >>= 1
        up, down = left | (full & ~(d | right)), d & right
    return at


def _verified(similarity: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok, cached, words = [], None, None
            for text, leader, key in zip(b["text"], b["leader_text"], b["leader"]):
                if key != cached:
                    cached, words = key, leader.lower().encode().split()
                mine = text.lower().encode().split()
                n = max(len(mine), len(words))
                ok.append(within(mine, words, int(n - similarity * n + 1e-9)))
            yield pd.DataFrame({"text_key": b["text_key"], "leader": b["leader"], "ok": ok})

    return verify


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether bags allow an edit distance of (1 - similarity) of n, the words of the longer: a bound from below."""
    d = a - b
    more = np.maximum(d, 0).sum(-1, dtype=np.int32)
    return np.maximum(more, more - d.sum(-1, dtype=np.int32)) <= np.floor(n - similarity * n + 1e-9)


def _bags(column, cells: int = BAG) -> np.ndarray:
    """Bags of one size as rows of so many cells; larger ones are folded."""
    each = np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(len(column), -1, cells)
    return each[:, 0].astype(np.int16) if each.shape[1] == 1 else each.sum(1, dtype=np.int16)


def _same_size(column) -> np.ndarray:
    """Bags as rows of as many cells as the smallest one has."""
    sizes = column.map(len).to_numpy()
    out = np.empty((len(column), sizes.min()), np.int16)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = _bags(column.iloc[at], out.shape[1])
    return out


def _tiled(similarity: float):
    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        """A tile: pairs of members of block lo and block hi, in two components and perhaps of one bucket, that may be
        near. Where both have the same crowded key before this one, they have met there."""
        lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
        bag, n, root, key, sign = _same_size(g["bag"]), g["n_words"].to_numpy(), pd.factorize(g["root"].map(bytes))[0], g["id"].to_numpy(), g["sign"].to_numpy()
        before, block = g["before"].fillna(0).to_numpy(np.int64), g["block"].to_numpy()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        most = np.maximum(n[left][:, None], n[right])
        meet = np.abs(n[left][:, None] - n[right]) <= np.floor(most - similarity * most + 1e-9)
        meet &= (root[left][:, None] != root[right]) & ((before[left][:, None] != before[right]) | (before[left][:, None] == 0))
        meet &= (sign[left][:, None] & sign[right]) != 0
        if lo == hi:
            meet &= left[:, None] < right
        i, j = np.nonzero(meet)
        i, j = left[i], right[j]
        ok = [_near(bag[i[at : at + 2048]], bag[j[at : at + 2048]], np.maximum(n[i[at : at + 2048]], n[j[at : at + 2048]]), similarity) for at in range(0, len(i), 2048)]
        ok = np.concatenate(ok) if ok else np.zeros(0, bool)
        return pd.DataFrame({"id": key[i[ok]], "_id": key[j[ok]]})

    return pairs


def _filtered(similarity: float):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok, most = np.zeros(len(b), bool), b["most"].to_numpy()
            sizes = np.array([[len(x) for x in b["bag"]], [len(x) for x in b["other"]]]).T
            for size in np.unique(sizes, axis=0):
                at, cells = np.flatnonzero((sizes == size).all(1)), int(size.min())
                ok[at] = _near(_bags(b["bag"].iloc[at], cells), _bags(b["other"].iloc[at], cells), most[at], similarity)
            yield b.loc[ok, ["text_key", "leader", "most"]]

    return keep


def _forest(g: pd.DataFrame) -> pd.DataFrame:
    """text_key, root of the ends of a bounded number of edges."""
    codes, found = pd.factorize(pd.concat([g["a"], g["b"]]).map(bytes), sort=True)
    root = list(range(len(found)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(codes[: len(g)].tolist(), codes[len(g) :].tolist()):
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    found = np.asarray(found, object)
    return pd.DataFrame({"text_key": found, "root": found[[top(x) for x in range(len(found))]]})


def _components(edges: DataFrame) -> DataFrame:
    """text_key, root (the smallest key of its component) for the ends of edges (a, b), written."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # A centre's least neighbour goes to SALTS parts, among which its edges are dealt out.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumn("salt", salts)
        joined = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least, ["a", "salt"])
        kept = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select("b", "m").union(joined.select("a", "m")).toDF("a", "b")
        return kept.filter(F.col("a") != F.col("b")).distinct()

    now = written(edges.select("a", "b").filter(F.col("a") != F.col("b")), "stars")
    if now.count() <= EDGES:
        out = written(now.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_forest, "text_key binary, root binary"), "roots")
        forget(now)
        return out
    while True:
        before, now = now, written(star(star(now, True), False), "stars")
        forget(before)
        # Done when it is a forest of stars: a node with an edge down has one, and none up.
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)").agg(F.count(F.lit(1))).first()[0]:
            break
    out = written(now.select(F.col("a").alias("text_key"), F.col("b").alias("root")).union(now.select("b", "b").distinct()), "roots")
    forget(now)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_key, class_id, class_key (the text that stands for the class: of
    those with the class's smallest id, null last, the one with the smallest key), copies (rows of the same text),
    links (different texts it was found similar to)."""
    with settings(docs.sparkSession, BATCHES):
        return _classes(docs, similarity)


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    spark = docs.sparkSession
    docs = keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    # Texts are read where they are: what is dealt and written of each is its sketch, which is less than half of it.
    each = docs.select("text_key", "text").mapInPandas(_sketches, "text_key binary, n_words int, bands array<long>, bag binary")
    sketches = written(each.groupBy("text_key").agg(*(F.first(x).alias(x) for x in ("n_words", "bands", "bag"))), "sketches")
    ids = written(docs.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "ids")
    bags = sketches.select("text_key", "n_words", "bag")
    words = bags.select("text_key", "n_words")
    at_once = max(PART_LEAST, int(PART * (words.agg(F.sum("n_words")).first()[0] or 0)))

    # Most values have one text: they are counted in the shuffle that deals them, and go no further.
    shared = sketches.select("text_key", F.explode("bands").alias("h")).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("h"))).filter("n > 1")
    shared = written(shared, "shared")
    counted = shared.groupBy("h", "n").agg(F.sum(F.xxhash64("text_key").cast("decimal(38,0)")).alias("who"))
    counted = counted.groupBy("n", "who").agg(F.min("h").alias("h")).select("h")
    members = written(shared.join(counted, "h"), "members")
    forget(shared)
    released(spark)

    done, links, roots, open_tables = [], None, None, [members]

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for x in tables[1:]:
            out = out.union(x)
        return out

    def portions(pairs: DataFrame, cost, by: int) -> list[DataFrame]:
        """Parts of the pairs that cost so many words each as may be carried at once; another `by`, other parts."""
        n = max(1, -(-int(pairs.agg(F.sum(cost)).first()[0] or 0) // at_once))
        return [pairs.filter(F.pmod(F.xxhash64("text_key", "leader", F.lit(by)), F.lit(n)) == i) for i in range(n)]

    def of_pairs(pairs: DataFrame, column: str, table: DataFrame, what: str) -> DataFrame:
        """What a table has of a side of the pairs, and of others of the same slots (at most SLOTS rows are sent to the workers, of 64 slots each)."""
        slot = lambda x: F.pmod(F.xxhash64(x), F.lit(SLOTS)).alias("slot")
        place = lambda x: F.pmod(F.shiftright(F.xxhash64(x), 32), F.lit(64)).cast("int").alias("place")
        slots = pairs.select(slot(column), place(column)).groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("places"))
        found = table.select("text_key", what, slot("text_key"), place("text_key")).join(F.broadcast(slots), "slot").filter("shiftright(places, place) & 1 = 1")
        return once(found.select("text_key", what), table, what).withColumnRenamed("text_key", column)

    def once(found: DataFrame, table: DataFrame, what: str) -> DataFrame:
        """One row of each text, which docs have as often as there are copies."""
        return found.groupBy("text_key").agg(F.first(what).alias(what)) if table is docs else found

    def at_hand(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame | None:
        """What a table has of the texts of all pairs, where that is so little (many pairs of few texts) that every worker can have it."""
        ends = pairs.select("text_key", "most").union(pairs.select("leader", "most")).groupBy("text_key").agg(F.max("most").alias("most"))
        if (ends.agg(F.sum(F.greatest("most", F.lit(BAG)))).first()[0] or 0) > min(AT_HAND, at_once):
            return None
        found = table.select("text_key", what).join(F.broadcast(ends.select("text_key")), "text_key", "left_semi")
        return written(once(found, table, what), "at-hand")

    def with_sides(pairs: DataFrame, table: DataFrame, what: str, other: str, cost, by: int) -> Iterator[DataFrame]:
        """The pairs with what a table has of both sides, in portions, or at once where all of that is at hand."""
        if (near := at_hand(pairs, table, what)) is not None:
            yield pairs.join(F.broadcast(near), "text_key").join(F.broadcast(near.toDF("leader", other)), "leader")
            forget(near)
            return
        for some in portions(pairs, cost, by):
            yield some.join(of_pairs(some, "text_key", table, what), "text_key").join(of_pairs(some, "leader", table, what).withColumnRenamed(what, other), "leader")

    def compared(pairs: DataFrame) -> list[DataFrame]:
        """text_key, leader, ok of the pairs that no bound rules out."""
        pairs = pairs.filter(F.col("text_key") != F.col("leader")).select(F.least("text_key", "leader").alias("text_key"), F.greatest("text_key", "leader").alias("leader")).distinct()
        pairs = pairs.join(words, "text_key").join(words.select(F.col("text_key").alias("leader"), F.col("n_words").alias("_n")), "leader")
        most = F.greatest("n_words", "_n")
        pairs = pairs.withColumn("most", most).filter(F.abs(F.col("n_words") - F.col("_n")) <= F.floor(most - similarity * most + 1e-9))
        close, out = written(pairs.select("text_key", "leader", "most"), "close"), []
        # A bag has two bytes for a word at most, a word takes six.
        for some in with_sides(close, bags, "bag", "other", F.greatest("most", F.lit(BAG)) / 3, 0):
            some = written(some.select("text_key", "leader", "bag", "other", "most").mapInPandas(_filtered(similarity), "text_key binary, leader binary, most int"), "pairs")
            for part in with_sides(some, docs, "text", "leader_text", F.col("most"), 1):
                out.append(written(part.select("text_key", "text", "leader", "leader_text").mapInPandas(_verified(similarity), "text_key binary, leader binary, ok boolean"), "verified"))
            forget(some)
            released(spark)  # the tables that were sent to the workers for this portion
        forget(close)
        return out

    def unresolved() -> DataFrame:
        """text_key, h, root, largest, n: members of buckets that hold several components, and the bucket's largest one."""
        rooted = written(members.select("text_key", "h").join(roots, "text_key", "left").select("text_key", "h", F.coalesce("root", "text_key").alias("root")), "rooted")
        parts = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k"))
        several = parts.groupBy("h").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "root")).alias("x"), F.sum("k").alias("n")).filter("parts > 1")
        several = written(several.select("h", F.col("x.root").alias("largest"), "n"), "several")
        out = written(rooted.join(several, "h"), "unresolved")
        forget(rooted, several)
        return out

    def meetings(left: DataFrame, turn: int) -> DataFrame:
        """Each member outside its bucket's largest component, and one of that component, by slots of hashes. Those that
        several buckets name are told apart by the pair alone, so that of a component a text meets MET at most."""
        slot = lambda *by: F.pmod(F.xxhash64(*by, F.lit(turn)), F.lit(MET))
        inside = left.filter(F.col("root") == F.col("largest")).select("h", "largest", slot("text_key").alias("slot"), "text_key")
        some = written(inside.groupBy("h", "largest", "slot").agg(F.max(F.struct(F.xxhash64("text_key", F.lit(turn)), "text_key")).alias("x")).select("h", "largest", "slot", F.col("x.text_key").alias("leader")), "met")
        open_tables.append(some)
        out = left.filter(F.col("root") != F.col("largest")).select("text_key", "h", slot("text_key", "h").alias("slot")).join(some, ["h", "slot"])
        return out.groupBy("text_key", "largest", "slot").agg(F.max("leader").alias("leader")).select("text_key", "leader")

    def rest(left: DataFrame) -> DataFrame:
        """All pairs of a bucket in two components that can be linked."""
        small = left.filter(F.col("n") <= SMALL).join(words, "text_key").select(F.col("h").alias("key"), "n", "text_key", "root", "n_words")
        most = F.greatest("n_words", "_n_words")
        far = F.abs(F.col("n_words") - F.col("_n_words")) > F.floor(most - similarity * most + 1e-9)
        other = lambda df, *names: df.select(*(F.col(x).alias(x if x == "key" else f"_{x}") for x in names))
        pairs = small.join(other(small, "key", "text_key", "root", "n_words"), "key").filter((F.col("text_key") < F.col("_text_key")) & (F.col("root") != F.col("_root")) & ~far).select("text_key", F.col("_text_key").alias("leader"))
        # Next, bags meet a bucket at a time; as for crowded keys, pairs that met in the bucket before do not again.
        middle = left.filter((F.col("n") > SMALL) & (F.col("n") <= MIDDLE))
        middle = middle.withColumn("before", F.lag("h").over(W.partitionBy("text_key").orderBy(F.desc("n"), "h"))).select("text_key", "h", "root", "before")  # a text's buckets are as few as its bands
        middle = middle.join(of_pairs(middle, "text_key", sketches.withColumn("both", F.struct("n_words", "bag")), "both"), "text_key")
        zero = F.lit(0).cast("long")
        middle = middle.select("h", "before", "root", F.col("text_key").alias("id"), "both.n_words", "both.bag", zero.alias("block"), zero.alias("lo"), zero.alias("hi"), F.lit(1).cast("long").alias("sign"))
        pairs = pairs.union(middle.groupBy("h").applyInPandas(_tiled(similarity), "id binary, _id binary").select(F.least("id", "_id"), F.greatest("id", "_id")))
        if not left.filter(F.col("n") > MIDDLE).limit(1).count():
            return pairs
        texts_of = left.filter(F.col("n") > MIDDLE).groupBy("text_key", "root").agg(F.collect_set("h").alias("hs"))
        texts_of = texts_of.withColumn("id", F.xxhash64("text_key")).withColumn("sign", F.expr("aggregate(hs, 0L, (x, h) -> x | shiftleft(1L, cast(pmod(h, 64) as int)))"))
        texts_of = written(texts_of.join(words, "text_key").join(of_pairs(texts_of, "text_key", docs, "text"), "text_key"), "crowded")
        counts = np.zeros(CELLS, np.uint8)
        for r in texts_of.select("text").mapInPandas(_cells(similarity), "at int, n binary").groupBy("at").applyInPandas(_sum_cells, "at int, n binary").collect():  # at most CELLS bytes, whatever the corpus
            counts[r["at"] : r["at"] + CELL_ROW] = np.frombuffer(r["n"], np.uint8)
        keyed = texts_of.select("id", "sign", "n_words", "root", "text").mapInPandas(_rarest(spark.sparkContext.broadcast(counts), similarity), "id long, sign long, n_words int, root binary, keys array<long>")
        # Most grams have one text and go here; a key has as many rows as texts, and one comes first in few texts.
        named = keyed.select("id", "sign", "n_words", "root", F.explode("keys").alias("key")).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).filter("n > 1")
        named = written(named, "named")
        open_tables.extend([texts_of, named])

        few = named.filter(F.col("n") <= SMALL)
        met = few.join(other(few, "key", "id", "sign", "n_words", "root"), "key").filter((F.col("id") < F.col("_id")) & (F.col("root") != F.col("_root")) & (F.col("sign").bitwiseAND(F.col("_sign")) != 0) & ~far).select("id", "_id")
        # Crowded keys: each member goes to the tiles of its block with every block.
        blocks = F.ceil(F.col("n") / TILE)
        large = named.filter(F.col("n") > SMALL).withColumn("before", F.lag("key").over(W.partitionBy("id").orderBy(F.desc("n"), "key")))  # a text's keys are fewer than its words
        # A key of one component, or whose members all have one and the same key before it, makes no new pair.
        mixed = large.groupBy("key").agg(F.min("before").alias("a"), F.max("before").alias("b"), F.count("before").alias("c"), F.count(F.lit(1)).alias("k"), F.min("root").alias("r"), F.max("root").alias("s"))
        mixed = written(mixed.filter("r <> s and (c < k or a <> b)").select("key"), "mixed-keys")
        bags_of = texts_of.select("id", "text_key").join(bags.select("text_key", "bag"), "text_key").select("id", "bag")
        large = large.join(mixed, "key").join(bags_of, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks))
        large = large.select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("with"))
        large = large.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "before", "id", "sign", "root", "n_words", "bag")
        met = met.union(large.groupBy("key", "lo", "hi").applyInPandas(_tiled(similarity), "id long, _id long"))
        met = met.select(F.least("id", "_id").alias("id"), F.greatest("id", "_id").alias("_id")).distinct()
        # Of one bucket and two components.
        met = met.join(texts_of.select("id", "text_key", "root", "hs"), "id").join(other(texts_of, "id", "text_key", "root", "hs"), "_id").filter((F.col("root") != F.col("_root")) & F.arrays_overlap("hs", "_hs"))
        return pairs.union(met.select("text_key", F.col("_text_key").alias("leader")))

    left, changed = None, True
    for turn in range(MEETINGS + 2):
        if turn == 0:
            degree = written(members.groupBy("text_key").agg(F.sum("n").alias("degree")), "degrees")
            leaders = members.join(degree, "text_key").groupBy("h").agg(F.max(F.struct("degree", "text_key")).alias("x")).select("h", F.col("x.text_key").alias("leader"))
            leaders = written(leaders, "leaders")
            open_tables.extend([degree, leaders])
            pairs = members.select("h", "text_key").join(leaders, "h")
        else:
            if changed:
                left = unresolved()
                open_tables.append(left)
            if not left.limit(1).count():
                break
            pairs = meetings(left, turn) if turn <= MEETINGS else rest(left)
        got = compared(pairs)
        done.extend(got)
        got = union(got)
        changed = turn == 0 or bool(got.filter("ok").limit(1).count())
        if turn == 0 or changed:
            # The stars of the rounds before stand for their links.
            new = got.filter("ok").select(F.col("text_key").alias("a"), F.col("leader").alias("b"))
            links = union(done).filter("ok")
            before, roots = roots, _components(new if roots is None else new.union(roots.select(F.col("text_key"), F.col("root"))))
            forget(before)
        released(spark)

    edges = links.select(F.col("text_key").alias("a"), F.col("leader").alias("b"))
    least = ids.select("text_key", "doc_id")
    of_root = roots.join(least, "text_key").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("x")).select("root", F.col("x.doc_id").alias("class_id"), F.col("x.text_key").alias("class_key"))
    number = edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("text_key")).agg(F.count(F.lit(1)).alias("links"))
    of_root = written(of_root, "of-root")
    linked = roots.join(of_root, "root").join(number, "text_key").select("text_key", "class_id", "class_key", "links")
    classes = ids.select("text_key", "doc_id", "copies").join(linked, "text_key", "left").select("text_key", "copies", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_key", "text_key").alias("class_key"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = written(classes, "classes")
    forget(sketches, ids, roots, of_root, *open_tables, *done)
    released(spark)
    return docs.select("doc_id", "text_key").join(classes, "text_key").select("doc_id", "text_key", "class_id", "class_key", "copies", "links")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each class: one with its smallest doc_id (null only if all are) and the text
    that stands for it. Classes are told apart by that text, as ids may be null or repeated."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stay = near_duplicates(docs, similarity).filter(F.col("text_key") == F.col("class_key"))
    stay = stay.select("class_id", "class_key").distinct()
    rows = keys(inner)
    rows = rows.join(stay, (F.col("text_key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = W.partitionBy("class_key", "class_id").orderBy(F.lit(0))
    return rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "copies", "links")
