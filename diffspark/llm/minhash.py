"""Near-duplicate documents by an inverted join of MinHash signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.llm._common import checkpoint, gathered, trim, words
from diffspark.llm._packed import slices
from diffspark.llm.components import components

#: Coordinates of a signature, and how many two signatures must share. At the threshold of 0.75, fewer agree by chance in one pair of 10**9 or less.
COORDINATES, LEAST = 64, 24
#: Entries of a worker's memo of word hashes; it is emptied when full, and by the task that has signed its last text, as workers go on to other stages.
MEMO = 50_000
#: Hubs that a node is compared with in a round.
HUBS = 8
#: Texts whose shingles a task holds at a time.
SLICE = 500
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word shingles; of fewer words, of their whole sequence; none without words."""
    parts = words(text)
    w = np.fromiter(map(_hashes.__getitem__, parts), "u8", len(parts))
    if not len(w):
        return w
    k = min(n, len(w))
    out = np.zeros(len(w) - k + 1, "u8")
    for j in range(k):
        out = _mix(out * _PRIME + w[j : j + len(out)])
    return np.unique(_mix(out + np.uint64(k)))


def body_hash(text: str | None) -> int:
    """Never 0, which stands for any text."""
    h = xxhash.xxh3_64_intdigest((text or "").encode()) >> 1
    return h or 1


def _keys(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.int64).astype("u8") | np.uint64(1)


def signature(s: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key the least of the keyed hashes, cut to 32 bits."""
    out = np.full(len(keys), np.iinfo("u8").max, "u8")
    for at in range(0, len(s), 4096):
        part = s[None, at : at + 4096] * keys[:, None]
        np.minimum(out, part.min(1), out=out)
    return (out >> np.uint64(32)).astype("u4").astype("i4")


def signatures(docs: DataFrame, *, doc_id: str, text: str, n: int, coordinates: int, seed: int) -> DataFrame:
    """id, n_shingles, set_a, set_b (a 128-bit hash of the shingle set), body (a hash of the text), signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _keys(coordinates, seed)
        for b in batches:
            size, a, c, body, sig = [], [], [], [], []
            for x in b.column(1):
                s = shingles(x.as_py(), n)
                h = xxhash.xxh3_128(s.tobytes()).digest()
                size.append(len(s))
                a.append(int.from_bytes(h[:8], "little", signed=True))
                c.append(int.from_bytes(h[8:], "little", signed=True))
                body.append(body_hash(x.as_py()))
                sig.append(signature(s, keys) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(body, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["id", "n_shingles", "set_a", "set_b", "body", "signature"])
        _hashes.clear()
        trim()

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, body long, signature array<int>")


def prefixes(sets: DataFrame, coordinates: int, least: int) -> DataFrame:
    """Postings under which two sets with ``least`` equal coordinates must meet: list, rep, tag.

    A signature's postings are ordered from the rarest list to the longest, and only the first ``coordinates - least + 1`` are kept: two signatures that share ``least`` of them can't share all of those only among the ``least - 1`` longest, which are skipped. Postings alone in their list come first in the order and meet nobody, so a signature with that many of them drops out.
    """
    postings = sets.select("rep", "tag", F.posexplode("signature").alias("c", "v")).select("rep", "tag", F.xxhash64("c", "v").alias("list"))
    lengths = postings.groupBy("list").agg(F.count("*").alias("length")).where("length > 1")
    shared = postings.join(lengths, "list")
    order = W.partitionBy("rep", "tag").orderBy("length", "list")
    alone = F.lit(coordinates) - F.count("*").over(W.partitionBy("rep", "tag"))
    shared = shared.withColumn("_alone", alone).withColumn("_place", F.row_number().over(order) + F.col("_alone"))
    return shared.where(F.col("_place") <= coordinates - least + 1).select("list", "rep", "tag")


def verified(pairs: DataFrame, texts: DataFrame, *, n: int, percent: int) -> DataFrame:
    """The pairs (a, ta, b, tb) whose full shingle sets are alike: 100 * intersection >= percent * union."""
    names = ["a", "ta", "b", "tb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, left = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            keep = []
            for i, (a, ta, za, zb) in enumerate(zip(batch.column("a").to_pylist(), batch.column("ta").to_pylist(), batch.column("za"), batch.column("zb"), strict=True)):
                if (a, ta) != last:
                    last, left = (a, ta), shingles(unpack.decompress(za.as_py()).decode(), n)
                right = shingles(unpack.decompress(zb.as_py()).decode(), n)
                common = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * common >= percent * (len(left) + len(right) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in names], names)
        _hashes.clear()
        trim()

    full = pairs.join(texts.select(F.col("rep").alias("b"), F.col("tag").alias("tb"), F.col("z").alias("zb")), ["b", "tb"])
    full = full.join(texts.select(F.col("rep").alias("a"), F.col("tag").alias("ta"), F.col("z").alias("za")), ["a", "ta"])
    return full.select(*names, "za", "zb").mapInArrow(run, "a long, ta long, b long, tb long")


def tokens_of(rows: DataFrame, n: int) -> DataFrame:
    """A row for each shingle of the compressed texts of ``rows(rep, tag, z)``: rep, tag, shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                sets = [shingles(unpack.decompress(z.as_py()).decode(), n) for z in part.column("z")]
                row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([part.column("rep").take(row), part.column("tag").take(row), pa.array(np.concatenate(sets).view("i8"))], ["rep", "tag", "shingle"])
        _hashes.clear()
        trim()

    return rows.select("rep", "tag", "z").mapInArrow(run, "rep long, tag long, shingle long")


def across(nodes: DataFrame, texts: DataFrame, *, n: int, percent: int) -> DataFrame:
    """Every pair of ``nodes(rep, tag, component, stray, size)`` from two components, one of them a stray at least, that may be alike: a, ta, b, tb.

    An exact prefix join over the nodes' full shingle sets. Each set is ordered from the shingles that fewest nodes have to those that most have; those of one component alone come before all, as they can't be common to such a pair. If two sets are alike, then at the first shingle that they share, in this order, each must still have enough shingles to reach the overlap that the threshold asks for; so a shingle is posted only as far as that holds for a partner of some size, and the smaller of two sets is found by fewer of its shingles than the larger (``prefix_sides``). Pages of one template with some text of their own have too few left by the first shingle that they share, unless they are alike, and aren't posted under it at all.
    """
    tokens = checkpoint(tokens_of(texts.join(nodes.select("rep", "tag"), ["rep", "tag"]), n))
    owners = tokens.join(nodes.select("rep", "tag", "component"), ["rep", "tag"])
    counts = owners.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle", "holders")
    order = W.partitionBy("rep", "tag").orderBy(F.col("holders").desc(), "shingle")
    left = tokens.join(counts, "shingle").withColumn("left", F.row_number().over(order))
    posts = gathered(left.join(nodes, ["rep", "tag"]).where(100 * F.col("left") >= percent * F.col("size")).select("shingle", "rep", "tag", "component", "stray", "size", "left"))
    smaller, larger = prefix_sides(posts, percent)
    # A stray meets all as the smaller set, and strays alone are met by the others: one join, in which no two of a list's largest component meet.
    x = smaller.withColumn("role", F.when(F.col("stray"), 0).otherwise(1)).alias("x")
    y = larger.withColumn("role", F.explode(F.when(F.col("stray"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).alias("y")
    enough = F.least("x.left", "y.left") * (100 + percent) >= percent * (F.col("x.size") + F.col("y.size"))
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.role") == F.col("y.role")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.size") <= F.col("y.size")) & enough
    return x.join(y, met).select(*ordered("x", "y")).distinct()


def prefix_sides(posts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of ``posts(shingle, size, left)`` those under which a set can be the smaller one of a pair, and those under which it can be the larger one.

    ``left`` shingles to come, itself included, must hold an overlap of percent / (100 + percent) of both sizes together. The smaller of a pair has a partner of its own size at least, which few of its shingles allow; the larger one a partner of percent / 100 of its size.
    """
    return posts.where((100 + percent) * F.col("left") >= 2 * percent * F.col("size")), posts.where(100 * F.col("left") >= percent * F.col("size"))


def ordered(x: str, y: str) -> list:
    """The two nodes of a pair, the lesser first: a, ta, b, tb."""
    p, q = F.struct(f"{x}.rep", f"{x}.tag"), F.struct(f"{y}.rep", f"{y}.tag")
    return [F.least(p, q)["rep"].alias("a"), F.least(p, q)["tag"].alias("ta"), F.greatest(p, q)["rep"].alias("b"), F.greatest(p, q)["tag"].alias("tb")]


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, coordinates: int = COORDINATES, least: int = LEAST, hub_rounds: int = 1, seed: int = 7) -> DataFrame:
    """Link documents of alike word shingles: id, n_shingles, component_id, kept.

    1. One pass makes each document's shingle set hash and MinHash signature. Documents of one set are one class, with the least id as representative (and a tag of the set, where rows of that id differ).
    2. Representatives are posted under each coordinate-value pair (an inverted list); ``prefixes`` keeps the postings that a pair above the match threshold must share.
    3. In each list the least representative is the hub of the others, and each is paired with its ``HUBS`` most frequent ones. Pairs whose signatures collide in ``least`` coordinates are compared on their full shingle sets. The links give components.
    4. In lists that still hold several components, ``hub_rounds`` times, the members outside the largest one are paired with its member of most links, which lies nearest to the middle of its group.
    5. In lists that hold several components even then, the members outside the largest one are joined with all members of other components under the shingles that a pair above the threshold must share first (``across``), and the pairs are compared. So every pair that shares a kept posting is compared or can't be alike, unless its two documents are in one component anyway: a group of thousands of near copies costs some pairs for each copy, not their square.

    Full texts travel compressed, and only those of documents that share a kept posting with another.

    Defined cases: a null or empty text, and one without words, has an empty set and is linked with nothing; repeated rows of an id are one document, a row each: if their texts differ, it is linked with what any of them is linked with, and n_shingles is the row's own; null ids are left out of linking and return component_id null, kept true; an empty table gives an empty table; other columns are not read.
    """
    sigs = checkpoint(signatures(docs, doc_id=doc_id, text=text, n=n, coordinates=coordinates, seed=seed))
    own = sigs.where("n_shingles > 0 and id is not null")
    several = gathered(own.groupBy("id").agg(F.min("set_b").alias("low"), F.max("set_b").alias("high")).where("low < high").select("id"))
    classes = own.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "body")).alias("least"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"))
    classes = classes.select("set_a", "set_b", F.col("least.id").alias("rep"), "least.body", "signature", "size").join(several.select(F.col("id").alias("rep"), F.lit(True).alias("_several")), "rep", "left")
    sets = gathered(classes.withColumn("tag", F.when(F.col("_several"), F.col("body")).otherwise(0)).select("rep", "tag", "set_a", "set_b", "signature", "size"))
    posts = gathered(prefixes(sets, coordinates, least))
    wanted = posts.select("rep", "tag").distinct()
    # Rows of one id are one document: their classes are linked with it.
    same_id = gathered(own.join(several, "id").join(sets, ["set_a", "set_b"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([body_hash(x) for x in texts], pa.int64()), pa.array([pack.compress((x or "").encode()) for x in texts], pa.binary())], ["rep", "body", "z"])
        trim()

    rows = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("text")).where("rep is not null").mapInArrow(packed, "rep long, body long, z binary")
    texts = checkpoint(rows.join(wanted, "rep").where("tag = 0 or tag = body").select("rep", "tag", "z").dropDuplicates(["rep", "tag"]))

    def alike(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, ta, b, tb), those whose sizes allow a link and whose signatures collide often enough, compared on their sets."""
        s, t = (sets.select(F.col("rep").alias(c), F.col("tag").alias(f"t{c}"), F.struct("size", "signature").alias(f"s{c}")) for c in ("a", "b"))
        sizes = 100 * F.least("sa.size", "sb.size") >= percent * F.greatest("sa.size", "sb.size")
        collisions = F.size(F.filter(F.zip_with("sa.signature", "sb.signature", lambda u, v: u == v), lambda e: e))
        both = pairs.join(s, ["a", "ta"]).join(t, ["b", "tb"]).where(sizes & (collisions >= least))
        return verified(both.select("a", "ta", "b", "tb"), texts, n=n, percent=percent)

    def members(links: DataFrame) -> DataFrame:
        """Postings of the lists that hold several components, with each member's component and links, and whether its component is the list's largest."""
        found = components(links.select("a", "b").union(same_id))
        ties = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("ties"))
        member = posts.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(ties, "rep", "left")
        member = member.select("list", "rep", "tag", F.coalesce("component", "rep").alias("component"), F.coalesce("ties", F.lit(0)).alias("ties"))
        parts = member.groupBy("list", "component").agg(F.count("*").alias("k"))
        largest = parts.groupBy("list").agg(F.max(F.struct("k", "component"))["component"].alias("largest"), F.count("*").alias("parts")).where("parts > 1").select("list", "largest")
        return gathered(member.join(largest, "list").select("list", "rep", "tag", "component", "ties", (F.col("component") == F.col("largest")).alias("main")))

    def with_hubs(rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """Each node with the hubs of most of its lists, ``HUBS`` at most; what they leave apart is joined by ``across``."""
        met = rows.alias("x").join(hubs.alias("y"), F.col("x.list") == F.col("y.list")).where("x.rep <> y.rep")
        met = met.groupBy(F.struct("x.rep", "x.tag").alias("x"), F.struct("y.rep", "y.tag").alias("y")).agg(F.count("*").alias("lists"))
        best = met.withColumn("_place", F.row_number().over(W.partitionBy("x").orderBy(F.col("lists").desc(), "y"))).where(F.col("_place") <= HUBS)
        return best.select(*ordered("x", "y")).distinct()

    pair = ["a", "ta", "b", "tb"]
    leaders = posts.groupBy("list").agg(F.min(F.struct("rep", "tag")).alias("hub")).select("list", "hub.*")
    tried = gathered(with_hubs(posts, leaders))
    links = gathered(alike(tried))
    open_lists = members(links)
    for _ in range(hub_rounds):
        hubs = open_lists.where("main").groupBy("list").agg(F.max(F.struct("ties", (-F.col("rep")).alias("rep"), "tag")).alias("hub")).select("list", (-F.col("hub.rep")).alias("rep"), "hub.tag")
        pairs = gathered(with_hubs(open_lists.where("not main"), hubs).join(tried, pair, "left_anti"))
        links, tried = gathered(links.union(alike(pairs))), tried.union(pairs)
        open_lists = members(links)
    nodes = open_lists.groupBy("rep", "tag").agg(F.min("component").alias("component"), F.max(~F.col("main")).alias("stray")).join(sets.select("rep", "tag", "size"), ["rep", "tag"])
    cross = across(gathered(nodes), texts, n=n, percent=percent)
    more = gathered(verified(cross.join(tried, pair, "left_anti"), texts, n=n, percent=percent))
    found = gathered(components(links.union(more).select("a", "b").union(same_id)))
    reps = sets.select("set_a", "set_b", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = sigs.join(reps, ["set_a", "set_b"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
