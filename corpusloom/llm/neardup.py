"""Problem 5: near-duplicate records with small edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import columns, salted, salted_semi, spread
from corpusloom.storage import checkpointed, written

#: Shingle frequencies are counted in so many buckets: 1 MB of counts at any size of the corpus.
BUCKETS = 1 << 18

#: Consistent samples a document, in bands of rows.  At a weighted similarity of 0.6 a pair shares a band with a chance of
#: 0.984, at 0.65 of 0.997; unrelated texts, similar to 0.01, with one of 3 in 10 million.
BANDS, ROWS = 30, 4
SAMPLES = BANDS * ROWS

#: Weights are rounded to quarter powers of two between 2**-2 and 2**6.
LOW_LEVEL, LEVELS = -8, 33

#: Pairs whose samples agree in a smaller part of the threshold than this are not compared word by word.  The part
#: of agreeing samples estimates the weighted similarity with a deviation of at most 0.06, so this is four of them.
LEAST_AGREEMENT = 0.6

#: Where plain similarity decides, the weighted one must be so large a part of the threshold.
LEAST_WEIGHTED = 0.5

#: A bucket of more rows is compared block against block.
BLOCK = 256

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Hashes of runs of consecutive words of a lower-cased text; words end at space, tab and line ends only."""

    def __init__(self, size: int = 3, bound: int = 400_000):
        self.size, self.bound, self.memory = size, bound, {}

    def words(self, text: str) -> list[bytes]:
        data = text.lower().encode("utf-8", "surrogatepass")
        if b"\x0b" in data or b"\x0c" in data:
            return [w for w in data.replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\n", b" ").split(b" ") if w]
        return data.split()

    def hashes(self, text: str, min_words: int) -> np.ndarray | None:
        """Hashes of all shingles in order; None for a text of fewer words."""
        words = self.words(text)
        if len(words) < max(min_words, self.size):
            return None
        memory = self.memory
        if len(memory) > self.bound:
            memory.clear()
        for w in set(words):
            if w not in memory:
                memory[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.size + 1
        out = np.zeros(n, np.uint64)
        for k in range(self.size):
            out = _mix(out * _MIX[0] + ids[k : k + n] + _MIX[(k + 1) % 3])
        return out


class Sampler:
    """Improved consistent weighted sampling (Ioffe, 2010).

    For each shingle and sample the triple of random numbers r, c ~ Gamma(2, 1) and
    b ~ U(0, 1) is drawn from a table by a hash of both.  Weights take one of a few
    levels, so ln a = ln c - r (t - b) - r with t = floor(ln w / r + b) is itself a table
    over levels and triples, and a sample costs one look-up a shingle.
    """

    TRIPLES = 1 << 16

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        r, c, b = rng.gamma(2.0, 1.0, self.TRIPLES), rng.gamma(2.0, 1.0, self.TRIPLES), rng.random(self.TRIPLES)
        log_w = np.log(2.0) * (np.arange(LEVELS) + LOW_LEVEL)[:, None] / 4
        self.t = np.floor(log_w / r + b).astype(np.int32).ravel()
        self.log_a = (np.log(c) - r * (np.floor(log_w / r + b) - b) - r).astype(np.float32).ravel()
        self.seeds = rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
        self.factors = rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """One 64-bit sample a position, for distinct, sorted shingles."""
        out = np.empty(SAMPLES, np.uint64)
        offset = (levels - LOW_LEVEL).astype(np.int64) * self.TRIPLES
        step = max(1, min(SAMPLES, 12_000 // len(shingles)))  # stays in the cache
        for start in range(0, SAMPLES, step):
            part = slice(start, start + step)
            index = shingles[None, :] ^ self.seeds[part, None]
            index *= self.factors[part, None]
            index >>= np.uint64(48)
            index = index.view(np.int64)
            index += offset
            best = self.log_a.take(index).argmin(axis=1)
            at = index[np.arange(len(best)), best]
            out[part] = shingles[best] * _MIX[0] ^ (self.t[at].astype(np.int64).astype(np.uint64) * _MIX[1])
        return _mix(out)


def _levels(weights: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(4 * np.log2(np.maximum(weights, 1e-9))), LOW_LEVEL, LOW_LEVEL + LEVELS - 1).astype(np.int32)


def weight_levels(shingles: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rounded TF-IDF weights of distinct shingles."""
    return _levels(counts * idf[(shingles >> np.uint64(46)).astype(np.int64)])


def shingle_idf(docs: DataFrame, size: int, min_words: int) -> np.ndarray:
    """Inverse document frequency of each bucket of shingles, over all documents.

    Every task adds up its own buckets, so at most one row a bucket and task is
    shuffled, and one array of a fixed megabyte reaches the driver.  Frequent shingles
    stand out of their bucket at any size of the corpus, since the share that rare
    ones add to a bucket does not depend on it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, n = Shingler(size), np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                hashes = shingler.hashes(text, min_words) if text else None
                if hashes is not None:
                    buckets = np.unique(hashes >> np.uint64(46)).astype(np.int64)
                    total[buckets] += 1
                    n += 1
        total[BUCKETS] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = docs.mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return np.log1p(df[BUCKETS] / np.maximum(df[:BUCKETS], 1)).astype(np.float32)


def signatures(docs: DataFrame, size: int, min_words: int, idf: np.ndarray, short: bool = False) -> DataFrame:
    """(id, content, content2, sig, bands): two hashes of the set of shingles, one byte a sample, and one key a band.

    With ``short`` texts of too few words come out as well, with hashes of their words and without samples.
    """
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # BUCKETS floats

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler, idf = Shingler(size), Sampler(), shared.value
        for batch in batches:
            ids, first, second, sigs, bands = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = shingler.hashes(text, min_words) if text and key is not None else None
                if hashes is None:
                    if short and text is not None and key is not None:
                        data = b" ".join(shingler.words(text))
                        ids.append(key)
                        first.append(xxhash.xxh3_64_intdigest(b"\x00" + data) - (1 << 63))
                        second.append(xxhash.xxh64_intdigest(data) - (1 << 63))
                        sigs.append(None)
                        bands.append(None)
                    continue
                shingles, counts = np.unique(hashes, return_counts=True)
                data = shingles.tobytes()
                ids.append(key)
                first.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                second.append(xxhash.xxh64_intdigest(data) - (1 << 63))
                samples = sampler.samples(shingles, weight_levels(shingles, counts, idf))
                sigs.append((samples >> np.uint64(56)).astype(np.uint8).tobytes())
                bands.append(band_keys(samples).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (ids, first, second)), *(pa.array(x, pa.binary()) for x in (sigs, bands))],
                names=["id", "content", "content2", "sig", "bands"],
            )

    return docs.mapInArrow(work, "id bigint, content bigint, content2 bigint, sig binary, bands binary")


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key a band, of which the band's number is part."""
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[2]
    for k in range(ROWS):
        key = _mix(key * _MIX[0] + rows[:, k])
    return key


def _band_rows(made: DataFrame) -> DataFrame:
    """(key, content): one row a band of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "content"])

    return made.where("bands IS NOT NULL").select("content", "bands").mapInArrow(work, "key bigint, content bigint")


def candidate_pairs(made: DataFrame) -> DataFrame:
    """(a, b), a < b: hashes of different texts that share a band, each pair once.

    A key is shared if the least and the greatest text under it differ, two partial aggregates, so equal copies, however
    many, cost one row a task and no bucket is collected.  Only rows of shared keys go on, each text once a key.  A large
    bucket is cut into blocks by a hash of the text; each pair of blocks is a group of its own, so no
    task holds a whole bucket and no pair is lost.
    """
    rows = _band_rows(made)
    shared = rows.groupBy("key").agg(F.min("content").alias("least"), F.max("content").alias("most")).where("least <> most").select("key")
    placed = checkpointed(salted_semi(rows, shared, ["key"], "content").distinct())
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    small = salted(placed, sizes.where(F.col("n") <= BLOCK), ["key"], "content").groupBy("key").agg(F.sort_array(F.collect_list("content")).alias("m"))
    pairs = small.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    large = salted(placed, sizes.where(F.col("n") > BLOCK), ["key"], "content").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    large = large.withColumn("block", F.expr("pmod(xxhash64(content), blocks)"))
    every = F.expr("transform(sequence(0L, blocks - 1), o -> struct(least(o, block) AS lo, greatest(o, block) AS hi))")
    cells = large.select("key", "content", "block", F.explode(every).alias("cell"))
    groups = cells.groupBy("key", "cell").agg(
        F.collect_list(F.when(F.col("block") == F.col("cell.lo"), F.col("content"))).alias("left"),
        F.collect_list(F.when(F.col("block") == F.col("cell.hi"), F.col("content"))).alias("right"),
    )
    crossed = groups.select(F.explode("left").alias("x"), "right").select("x", F.explode("right").alias("y")).where("x <> y")
    blocked = crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.where("a < b").union(blocked).distinct()


def _agreeing(pairs: DataFrame, made: DataFrame, threshold: float) -> DataFrame:
    """Pairs of ids (a, b) whose samples agree often enough; only signatures of a fixed size are moved."""
    least = LEAST_AGREEMENT * threshold
    sig = made.where("sig IS NOT NULL").select("id", "sig")
    joined = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    joined = joined.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SAMPLES) for i in (2, 3))
                keep = pa.array((left == right).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    size: int = 5,
    min_words: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    plain: bool = False,
    short: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) and links (a, b, jaccard, weighted) between representatives.

    Documents with equal sets of shingles are one class, represented by its least id.
    Texts are sampled by improved consistent weighted sampling over TF-IDF
    weights, banded, compared by samples, and verified on the whole texts: a link has a weighted
    Jaccard similarity of at least ``threshold``.  With ``plain`` the similarity of the sets without
    weights decides instead, after a weighted one of at least LEAST_WEIGHTED of the threshold.  Shuffled are ids, band keys
    and signatures of fixed size, and the shingles of documents that have a surviving partner.  Texts that are null
    or shorter than ``min_words`` words, and rows without an id, take no part, unless ``short`` puts equal
    short texts into one class; repeated rows change nothing.
    """
    rows = spread(columns(docs, id=id_col, text=text_col))
    idf = shingle_idf(rows, size, min_words)
    made = written(signatures(rows, size, min_words, idf, short))
    classes = written(made.groupBy("content", "content2").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")))
    several = classes.where("n > 1").select("content", "content2", "rep")
    copies = salted(made.select("id", "content", "content2"), several, ["content", "content2"], "id").select("id", "rep").distinct()
    members = copies.union(classes.where("n = 1").select(F.col("rep").alias("id"), "rep"))
    named = classes.select("content", "rep")
    found = candidate_pairs(made).join(named.select(F.col("content").alias("a"), F.col("rep").alias("x")), "a")
    found = found.join(named.select(F.col("content").alias("b"), F.col("rep").alias("y")), "b")
    found = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")
    pairs = checkpointed(_agreeing(found, made.dropDuplicates(["id"]), threshold))
    return members, verified(pairs, rows, threshold, size, min_words, idf, plain)


def verified(pairs: DataFrame, docs: DataFrame, threshold: float, size: int, min_words: int, idf: np.ndarray, exact: bool = False) -> DataFrame:
    """(a, b, jaccard, weighted): exact similarities of both texts, of their sets of shingles and of their weighted ones, which decides unless ``exact``."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # BUCKETS floats
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, idf = Shingler(size), shared.value
        for batch in batches:
            ids, found, weights = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = shingler.hashes(text, min_words)
                if hashes is not None:
                    shingles, counts = np.unique(hashes, return_counts=True)
                    ids.append(key)
                    found.append(shingles.tobytes())
                    weights.append(weight_levels(shingles, counts, idf).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()), pa.array(weights, pa.binary())], names=["id", "s", "w"])

    known = docs.where("text IS NOT NULL").join(wanted, "id", "left_semi").select("id", "text").mapInArrow(sets, "id bigint, s binary, w binary")
    known = known.dropDuplicates(["id"])  # one shuffle of the sets by id, which both joins use
    joined = pairs.join(known.select(F.col("id").alias("a"), F.col("s").alias("sa"), F.col("w").alias("wa")), "a")
    joined = joined.join(known.select(F.col("id").alias("b"), F.col("s").alias("sb"), F.col("w").alias("wb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, wa, sb, wb = (c.to_pylist() for c in batch.columns)
            plain, weighted = [], []
            for i in range(len(a)):
                x, y = np.frombuffer(sa[i], np.uint64), np.frombuffer(sb[i], np.uint64)
                p, q = (np.exp2(np.frombuffer(w, np.int8) / 4.0) for w in (wa[i], wb[i]))
                both, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                plain.append(len(both) / (len(x) + len(y) - len(both)))
                low, high = np.minimum(p[at_x], q[at_y]).sum(), np.maximum(p[at_x], q[at_y]).sum()
                weighted.append(low / (p.sum() + q.sum() - p[at_x].sum() - q[at_y].sum() + high))
            first, second = np.array(plain), np.array(weighted)
            keep = pa.array((first >= threshold) & (second >= LEAST_WEIGHTED * threshold) if exact else second >= threshold, pa.bool_())
            out = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(plain, pa.float64()), pa.array(weighted, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in out], names=["a", "b", "jaccard", "weighted"])

    return joined.select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(compare, "a bigint, b bigint, jaccard double, weighted double")


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of ids, those within a class of equal texts and those of linked classes.

    The output itself holds every pair, so this is for consumers that need pairs; keep
    members and links where classes may be large.
    """
    left, right = (members.select(F.col("rep").alias(r), F.col("id").alias(x)) for r, x in (("a", "x"), ("b", "y")))
    across = links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    copies = members.join(several, "rep", "left_semi")
    within = salted(copies.select("rep", F.col("id").alias("x")), copies.select("rep", F.col("id").alias("y")), ["rep"], "x").where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
