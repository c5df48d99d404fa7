"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``2 * half`` bits share a variant that is within ``half`` bits of
both, so each fingerprint emits all its variants and those that meet in one are
linked; by the triangle inequality all fingerprints at a variant link, which each pair's
distance verifies again. The shuffle is on variants, by a block: a hash of the variant
that is linear over XOR. A fingerprint thus knows which of its flip patterns
fall into a block, so it travels once to a block and its variants are
made there, instead of one row for each of 2,081 variants. A block's variants are
sorted in slices of bounded size, links within it reduced to a spanning forest, and the
forests of all blocks joined by rounds of large-star and small-star. Equal
fingerprints are one node from the start, and no task holds a group of documents.

Edge cases: null and empty texts have fingerprint zero and link like any other; null
identifiers are kept, and a component of null identifiers only has a null component; repeated rows
stay; ties in bit counts give 0; texts of any length are read in slices; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, write_table

SEED = 42
#: Blocks at least; beyond MOST fingerprints in a block there are more.
BLOCKS, MOST = 64, 16_000_000
#: Variants sorted at once.
SLICE = 2_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 50_000):
        hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[k : k + 50_000], ends[k : k + 50_000])], np.uint64)
        total += _bit_counts(hashes)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the least. Up to 255 rows at a
    time are added as bytes of one 64-bit integer, eight bits of the hash at once."""
    ones, total = np.uint64(0x0101010101010101), np.zeros(64, np.int64)
    whole = len(hashes) // 255 * 255
    for part in (hashes[:whole].reshape(-1, 255), hashes[whole:].reshape(1, -1)):
        if part.size:
            for i in range(8):
                sums = ((part >> np.uint64(i)) & ones).sum(axis=1, dtype=np.uint64)
                total[i::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id, fp`` of each row; ``fp`` is the fingerprint's 64 bits as a signed long."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(lambda it: _fingerprints(it, shingle), "id long, fp long")


class Ball:
    """The flip patterns of up to ``half`` bits and the linear block hash."""

    def __init__(self, half: int, block_bits: int, slice_bits: int = 0):
        from itertools import combinations

        bit = [1 << i for i in range(64)]
        flips = [0] + [sum(bit[i] for i in c) for k in range(1, half + 1) for c in combinations(range(64), k)]
        self.flips, self.block_bits, self.slice_bits = np.array(flips, np.uint64), block_bits, slice_bits
        rng = np.random.default_rng(64)
        self.columns = rng.integers(1, 1 << 62, 64, dtype=np.uint64)
        self.mask = np.uint64((1 << (block_bits + slice_bits)) - 1)
        self.flip_class = self.classes(self.flips)

    def classes(self, values: np.ndarray) -> np.ndarray:
        """The XOR of the columns of a value's set bits, so that class(a ^ b) = class(a) ^ class(b)."""
        out = np.zeros(len(values), np.uint64)
        for i in range(64):
            out ^= self.columns[i] * ((values >> np.uint64(i)) & np.uint64(1))
        return out & self.mask


def _deal(batches: Iterator[pa.RecordBatch], half: int, block_bits: int) -> Iterator[pa.RecordBatch]:
    """For each family and block, the fingerprints that have a variant in it: ``prints`` those
    without a label, ``labelled`` the others, each before its label."""
    ball, blocks = Ball(half, block_bits), np.arange(1 << block_bits, dtype=np.uint64)
    reached = np.zeros(1 << block_bits, bool)
    reached[ball.flip_class.astype(np.int64)] = True
    for batch in batches:
        families, all_prints = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
        has, labels = np.asarray(batch.column(2).is_valid()), np.asarray(batch.column(2).fill_null(0))
        for family in np.unique(families):
            rows = np.flatnonzero(families == family)
            own = ball.classes(all_prints[rows])
            packs = []
            for g in np.unique(own):
                mine = rows[own == g]
                bare, named = mine[~has[mine]], mine[has[mine]]
                packs.append((g, all_prints[bare].tobytes(), np.stack([all_prints[named], labels[named].view(np.uint64)], axis=1).tobytes()))
            parts, named_parts, names, size = [], [], [], 0
            for block in blocks:
                near = [p for p in packs if reached[int(block ^ p[0])]]
                if near:
                    parts.append(b"".join(p[1] for p in near))
                    named_parts.append(b"".join(p[2] for p in near))
                    names.append(int(block))
                    size += len(parts[-1]) + len(named_parts[-1])
                if names and (size > 8 << 20 or block == blocks[-1]):
                    yield pa.RecordBatch.from_pydict({"family": pa.array([int(family)] * len(names), pa.int64()), "block": pa.array(names, pa.int64()), "prints": pa.array(parts, pa.binary()), "labelled": pa.array(named_parts, pa.binary())})
                    parts, named_parts, names, size = [], [], [], 0


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, over edges between nodes 0 to n - 1."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        keep = low != high
        a, b, low, high = a[keep], b[keep], low[keep], high[keep]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _links(prints: np.ndarray, block: int, half: int, block_bits: int, slice_rows: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of a block: nodes that aren't roots, and their roots. With labels, each pair of different
    labels that come next to each other at a variant, once."""
    n = len(prints)
    per_block = max(1, n * (1 + 64 + (half > 1) * 2016) >> block_bits)
    slice_bits = max(0, (per_block // slice_rows).bit_length())
    ball = Ball(half, block_bits, slice_bits)
    own = ball.classes(prints)
    by_class = {}
    for i, c in enumerate(ball.flip_class.tolist()):
        by_class.setdefault(c, []).append(i)
    by_class = {c: ball.flips[i] for c, i in by_class.items()}
    order = np.argsort(own, kind="stable")
    names, at = np.unique(own[order], return_index=True)
    groups = {c: order[a:b] for c, a, b in zip(names.tolist(), at, [*at[1:], n])}
    ea, eb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(1 << slice_bits):
        target = block | s << block_bits
        made, of = [], []
        for c, rows in groups.items():
            flips = by_class.get(c ^ target)
            if flips is not None:
                made.append((prints[rows][:, None] ^ flips[None, :]).ravel())
                of.append(np.repeat(rows, len(flips)))
        if not made:
            continue
        made, of = np.concatenate(made), np.concatenate(of)
        order = np.argsort(made) if label is None else np.lexsort((label[of], made))
        made, of = made[order], of[order]
        met = np.flatnonzero(made[1:] == made[:-1])
        if label is not None:
            met = met[label[of[met]] != label[of[met + 1]]]
        a, b = of[met], of[met + 1]
        good = np.bitwise_count(prints[a] ^ prints[b]) <= 2 * half
        pairs = np.unique(np.minimum(a, b)[good] * n + np.maximum(a, b)[good])
        ea.append(pairs // n)
        eb.append(pairs % n)
    ea, eb = np.concatenate(ea), np.concatenate(eb)
    if label is not None:
        pairs = np.unique(ea * n + eb)
        return prints[pairs // n], prints[pairs % n]
    root = forest(ea, eb, n)
    node = np.flatnonzero(root != np.arange(n))
    return prints[node], prints[root[node]]


def _match(table: pa.Table, half: int, block_bits: int, slice_rows: int, spanning: bool) -> pa.Table:
    block, family = table.column("block")[0].as_py(), table.column("family")[0].as_py()
    bare = np.frombuffer(b"".join(table.column("prints").to_pylist()), np.int64)
    named = np.frombuffer(b"".join(table.column("labelled").to_pylist()), np.int64).reshape(-1, 2)
    # nodes are told apart by their rank as signed longs, as Spark orders them; one without a label is its own
    prints, first = np.unique(np.concatenate([bare, named[:, 0]]), return_index=True)
    label = None if spanning else np.concatenate([bare, named[:, 1]])[first]
    a, b = _links(prints.view(np.uint64), block, half, block_bits, slice_rows, label)
    return pa.table({"family": pa.array([family] * len(a), pa.int64()), "a": a.view(np.int64), "b": b.view(np.int64)})


def meetings(prints: DataFrame, radius: int = 4, slice_rows: int = SLICE, spanning: bool = True, blocks: int = BLOCKS) -> DataFrame:
    """``family, a, b``: links between the distinct fingerprints ``fp`` of each ``family`` that are ``radius`` bits or
    fewer apart. With ``spanning`` they connect what is linked. Without, only fingerprints of different ``label`` (a
    long; null: one of its own) are paired: those that come next to each other at a variant when its fingerprints are
    sorted by label. ``blocks``: a power of two; more are taken beyond ``MOST`` fingerprints."""
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4")
    half = radius // 2
    label = F.min("label") if "label" in prints.columns else F.lit(None)
    prints = write_table(prints.groupBy(F.col("family").cast("long").alias("family"), "fp").agg(label.cast("long").alias("label")), "prints")
    most = prints.groupBy("family").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST:
        blocks = -(-2081 * most // MOST)
    bits = (blocks - 1).bit_length()
    dealt = prints.mapInArrow(lambda it: _deal(it, half, bits), "family long, block long, prints binary, labelled binary")
    return dealt.groupBy("family", "block").applyInArrow(lambda t: _match(t, half, bits, slice_rows, spanning), "family long, a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``, the smallest node reachable, of every node of ``a``-``b`` edges that isn't a root.

    Rounds of large-star (each node hangs its larger neighbours on its smallest) and
    small-star (its smaller ones) until nothing changes. Each round is written to the
    shared folder; what comes to the driver is two numbers. Nodes with many edges are pre-aggregated.
    """
    edges = write_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        last, small = edges, large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = write_table(small.where("a <> b").distinct(), "edges")
        drop_table(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``id, fp, component`` of each row: the smallest identifier among the rows it is linked to, itself included."""
    rows = write_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    roots = components(meetings(rows.withColumn("family", F.lit(0)), radius))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("low")).join(roots, F.col("fp") == F.col("node"), "left")
    nodes = write_table(nodes.select("fp", F.coalesce("root", "fp").alias("root"), "low"), "nodes")
    lows = nodes.groupBy("root").agg(F.min("low").alias("component"))
    named = nodes.join(lows, "root").select("fp", "component")
    return rows.join(named, "fp").select("id", "fp", "component")


#: Rows of a token in one task, about, in the rounds of neighbours.
TOKEN_ROWS = 20_000
#: Bins of a sketch; bits of a shingle's bin when frequencies are counted, and a shingle without words.
BINS, RANK_BITS, NO_WORDS = 256, 20, 1
#: 64-bit words of a set's parity bits.
PARITY = 16
#: Pairs of whole texts in one Arrow batch.
VERIFY_ROWS = 500
PARITY_COLUMNS = [f"p{k}" for k in range(PARITY)]
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another hash from a hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The hashes of a text's distinct word shingles, in order; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.array([NO_WORDS], np.uint64)
    digest = xxhash.xxh64_intdigest
    base = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    width = min(size, len(words))
    n, out = len(words) - width + 1, np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + base[k : k + n])
    return np.unique(out)


def sketch(words: list[bytes], shingle: int = 5) -> bytes:
    """One-permutation MinHash of the word shingles: 16 bits of each bin's least hash; 0xFFFF where a bin is empty."""
    import xxhash

    least = np.full(BINS, 0xFFFFFFFF, np.uint64)
    if words:
        flat = b" ".join(words)
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-1])]
        n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
        for k in range(0, n, 50_000):
            m = min(n, k + 50_000)
            hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[k:m], ends[k + min(shingle, len(words)) - 1 :])], np.uint64)
            np.minimum.at(least, (hashes >> np.uint64(56)).astype(np.int64), hashes & np.uint64(0xFFFFFFFE))
    low = np.minimum((least >> np.uint64(1)) & np.uint64(0xFFFF), np.uint64(0xFFFE))
    return np.where(least == 0xFFFFFFFF, np.uint64(0xFFFF), low).astype("<u2").tobytes()


def resemblance(a: bytes, b: bytes) -> float:
    """The estimate of two texts' Jaccard similarity; 1 for two texts without words."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    either = np.count_nonzero((x != 0xFFFF) | (y != 0xFFFF))
    return np.count_nonzero((x == y) & (x != 0xFFFF)) / either if either else 1.0


def _bin_counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How often the shingles of each bin stand in the texts of a partition."""
    total = np.zeros(1 << RANK_BITS, np.int64)
    for batch in batches:
        for t in batch.column(0):
            np.add.at(total, (shingles(t.as_py(), size) >> np.uint64(64 - RANK_BITS)).astype(np.int64), 1)
    bins = np.flatnonzero(total)
    for k in range(0, len(bins), 50_000):
        part = bins[k : k + 50_000]
        yield pa.RecordBatch.from_pydict({"bin": pa.array(part.astype(np.int32)), "n": pa.array(total[part])})


def bin_ranks(texts: DataFrame, size: int) -> np.ndarray:
    """A rank for each bin of shingles, by how often they stand in all texts: 2 bytes a bin at any size of the input."""
    counts = texts.mapInArrow(lambda it: _bin_counts(it, size), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    found = counts.select("bin", F.floor(64 * F.log2(F.col("n") + 1)).cast("int").alias("rank")).toArrow()
    ranks = np.zeros(1 << RANK_BITS, np.uint16)
    ranks[found["bin"].to_numpy()] = found["rank"].to_numpy()
    return ranks


def prefix(hashes: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the common order (rank of the bin, hash). Two sets that are ``similarity`` alike share one of
    their prefixes, whatever the ranks are."""
    least = math.ceil(similarity * len(hashes) - 1e-9)
    order = np.lexsort((hashes, rank[(hashes >> np.uint64(64 - RANK_BITS)).astype(np.int64)]))
    return hashes[order[: len(hashes) - least + 1]]


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of ``64 * PARITY`` bins whether an odd number of the hashes falls into it. Hashes that two sets share fall out
    of the difference of their bits, so sets differ in as many hashes at least as their bits do."""
    odd = np.bincount((hashes & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, rank: bytes, similarity: float) -> Iterator[pa.RecordBatch]:
    """The prefix of each text; its first row has the parity bits too."""
    ranks = np.frombuffer(rank, np.uint16)
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            sets = [shingles(t.as_py(), size) for t in part.column(1)]
            tops = [prefix(h, ranks, similarity) for h in sets]
            lengths = np.array(list(map(len, tops)))
            of = np.repeat(np.arange(len(sets)), lengths)
            first = np.diff(of, prepend=-1) != 0
            bits = np.zeros((len(of), PARITY), np.int64)
            bits[first] = [parity(h) for h in sets]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tops).view(np.int64)), part.column(0).take(pa.array(of)),
                pa.array(np.array(list(map(len, sets)), np.int32)[of]), *(pa.array(b, mask=~first) for b in bits.T),
            ], names=["token", "node", "n", *PARITY_COLUMNS])


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _verified(batches: Iterator[pa.RecordBatch], size: int, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs that link, by the whole texts of both: texts are shuffled, as they compress better than sets of hashes."""
    for batch in batches:
        good, last, known = [], None, None
        for x, b, y in zip(batch.column(2), batch.column(1).to_pylist(), batch.column(3)):
            if b != last:  # pairs of a text often stand together
                last, known = b, shingles(y.as_py(), size)
            good.append(jaccard(shingles(x.as_py(), size), known) >= least - 1e-9)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _key(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """``a``, ``b``: each text (``node``, ``text``) beside the least of those that it is linked to by fingerprints 4 bits apart
    or fewer, as in ``near_duplicates``, and beside the least one of an equal fingerprint."""
    found = write_table(near_duplicates(texts, "node"), "linked")
    same = found.groupBy("fp").agg(F.min("id").alias("least"))
    both = found.join(same, "fp").select(F.explode(F.array("component", "least")).alias("a"), F.col("id").alias("b"))
    return both.where("a <> b").distinct()


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, rounds: int = 3) -> DataFrame:
    """``key, root, low`` of each distinct text (null counts as empty): the class that it belongs to and its least identifier.

    Texts link if the Jaccard similarity of their whole sets of word shingles is ``similarity`` or more; classes are what links connect.
    The first candidates are those of SimHash: texts whose fingerprints are equal or linked at 4 bits. What it misses
    comes from an exact prefix filter: two such texts share a token among the first of both, in an order of all
    shingles that has frequent ones last (by counts of bins over all texts, which only decide the effort); their sizes and the number of tokens that both prefixes
    have must leave room for the overlap, and so must their parity bits. First, in ``rounds`` rounds, the texts of a token stand in a random order, another one in each
    round, and neighbours of different classes are compared: a pair at most for a row, which settles large groups. Then all pairs that
    share a token and are still in different classes are verified. Rows of a token that many texts have are dealt over several tasks.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(_key(text_col).alias("key"), F.col(id_col).cast("long").alias("id"), own.alias("text"))
    texts = texts.groupBy("key").agg(F.min("id").alias("low"), F.first("text").alias("text"))
    texts = write_table(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    source = texts.select("node", "text")
    ranks = bin_ranks(source.select("text"), shingle).tobytes()
    fields = ", ".join(f"{c} long" for c in PARITY_COLUMNS)
    tokens = write_table(source.mapInArrow(lambda it: _prefixes(it, shingle, ranks, similarity), f"token long, node long, n int, {fields}"), "prefixes")
    bits = write_table(tokens.where("p0 is not null").select("node", "n", *PARITY_COLUMNS), "parity")
    counts = tokens.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = write_table(tokens.select("token", "node", "n").join(counts, "token"), "tokens")
    drop_table(tokens)
    near = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6

    def alike(x: str, y: str):
        """Sets that are ``similarity`` alike differ in this share of their sizes at most."""
        apart = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in PARITY_COLUMNS), F.lit(0))
        return apart <= (1 - similarity + 1e-6) / (1 + similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs ``a``, ``b`` that link."""
        x, y = bits.alias("x"), bits.alias("y")
        pairs = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
        pairs = write_table(pairs.where(near(F.col("x.n"), F.col("y.n")) & alike("x", "y")).select("a", "b"), "pairs")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        some = write_table(source.join(ends, "node", "left_semi"), "ends")
        of = lambda c: some.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
        before = spark.conf.get(ARROW_ROWS)
        spark.conf.set(ARROW_ROWS, VERIFY_ROWS)
        try:
            links = write_table(both.mapInArrow(lambda it: _verified(it, shingle, similarity), "a long, b long"), "links")
        finally:
            spark.conf.set(ARROW_ROWS, before)
        drop_table(some)
        drop_table(pairs)
        return links

    def neighbours(rows: DataFrame, seed: int) -> DataFrame:
        at = F.xxhash64(F.lit(seed), "node")
        deal = F.pmod(F.xxhash64(F.lit(seed + 1000), "node"), F.ceil(F.col("rows") / TOKEN_ROWS))
        order = Window.partitionBy("token", "deal").orderBy("at", "node")
        x = F.lead(F.struct("class", "node", "n")).over(order)
        beside = rows.withColumn("at", at).withColumn("deal", deal).withColumn("x", x)
        open_pairs = beside.where((F.col("class") != F.col("x.class")) & near(F.col("n"), F.col("x.n")))
        return open_pairs.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()

    def classed(roots: DataFrame) -> DataFrame:
        """The rows of tokens that more than one class has."""
        named = shared.join(roots.select("node", "root"), "node", "left").select("token", F.coalesce("root", "node").alias("class"), "node", "n", "rows")
        return write_table(named, "classed")

    tried = write_table(simhash_pairs(source), "candidates")
    roots, rows = components(verified(tried)), None
    for seed in range(rounds):
        drop_table(rows)
        rows = classed(roots)
        pairs = write_table(neighbours(rows, seed).join(tried, ["a", "b"], "left_anti"), "candidates")
        tried = tried.unionByName(pairs)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(pairs))
        before, roots = roots, components(links)
        drop_table(before)
    drop_table(rows)
    rows = classed(roots)
    drop_table(shared)
    # the largest class of a token is held against the others only, so that its own pairs aren't made
    sizes = rows.groupBy("token", "class").agg(F.count("*").alias("size")).groupBy("token").agg(F.count("*").alias("classes"), F.max(F.struct("size", "class")).alias("x"))
    open_rows = rows.join(sizes.where("classes > 1").select("token", F.col("x.class").alias("major")), "token").drop("n").join(bits, "node")
    x, y = open_rows.where("class <> major").alias("x"), open_rows.alias("y")
    once = (F.col("y.class") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.class") != F.col("y.class")) & once
    met = x.join(y, apart & near(F.col("x.n"), F.col("y.n")) & alike("x", "y")).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))
    # the prefix that ends first in the order shares no more than the common tokens, and what is behind it is n less its length, least(n) - 1
    behind = F.ceil(similarity * F.greatest("n", "m") - 1e-9) - 1
    room = F.count("*") + F.max(behind) >= F.max(similarity / (1 + similarity) * (F.col("n") + F.col("m"))) - 1e-6
    pairs = met.groupBy("a", "b").agg(room.alias("room")).where("room").select("a", "b").join(tried, ["a", "b"], "left_anti")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(pairs)))
    nodes = texts.select("key", "low", "node").join(roots, "node", "left")
    return write_table(nodes.select("key", F.coalesce("root", "node").alias("root"), "low"), "classes")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class: that with the least identifier, ties by the text's hash, with the columns that ``docs`` came with."""
    classes = copy_classes(docs, id_col, text_col, **options)
    kept = classes.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "key")).alias("x")).select(F.col("x.low").alias("__low"), F.col("x.key").alias("__key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(text_col).alias("__own"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"))
    kept = kept.select("__key", F.coalesce(F.col("__low").cast("string"), F.lit("")).alias("__low"))
    there = rows.join(kept, (F.col("__own") == F.col("__key")) & (F.col("__id") == F.col("__low")), "left_semi")
    # repeated rows with other columns that differ: the one with the least hash of them
    sortable = [F.to_json(F.struct(F.col(f"row.`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"row.`{f.name}`") for f in docs.schema.fields]
    return there.groupBy("__own", "__id").agg(F.min_by("row", F.xxhash64(*sortable)).alias("row")).select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
