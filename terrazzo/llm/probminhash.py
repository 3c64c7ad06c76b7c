"""Near-duplicates by ProbMinHash, banding and exact verification.

A text is a weighted set of shingles of five lower-case words (weight 1 + ln count). Each
shingle is a Poisson process with its weight as rate: arrivals come at exponential distances,
each falls on a register chosen by hash, and a register keeps the shingle that arrived first.
Processing a text stops once no arrival can be earlier than the latest register. Two
signatures agree in a register with probability J_P, the probability Jaccard similarity.

Texts with the same weighted set are one representative from the start. Representatives that
agree in a band share a bucket. Members are compared with leaders first: the first round has
the bucket's first member lead; later rounds take only buckets whose members are still in two
components or more, and two leaders picked by hash anew for every bucket and round, one of
them from the largest component; members of smaller components ask leaders of larger ones,
until a round brings no link. What is left is compared whole: in buckets that still hold two
components, every pair across components meets in a tile of two salted blocks, members of
the largest component with the others only. Candidates whose signatures agree too little are
left out (five standard deviations below the threshold); the others are verified by the exact
J_P of their shingle sets, in tiles after an exact bound on it. Verified links are joined to
components.

Defined cases: texts of one to four words are one shingle of all their words; a text without
words (null, empty) is a class of its own; null ids come first; rows alike in id and text are
one document; ``class_id`` is the first id of the class, ``kept`` its first document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import annotate, blobs, frugal, quoted, slices
from .scratch import Scratch

WORDS, REGISTERS, BANDS, ROWS = 5, 128, 25, 5
THRESHOLD = 0.8
ROUNDS = 5
#: Members of a block of a tile; candidates of a tile from which bounds are worth a product.
BLOCK, MANY = 1_000, 200
CHUNK = 2_000_000
_U = np.uint64
_LOWEST = -(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(rows: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle, by row and hash."""
    known = _Hashes()
    own = [[known[w] for w in x.split()] for x in rows]
    flat = np.array([h for x in own for h in x], np.uint64)
    size = np.array([len(x) for x in own], np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    have = np.repeat(size, size)
    first = np.flatnonzero((at + words <= have) | (at == 0))
    with np.errstate(over="ignore"):
        h = np.zeros(len(first), np.uint64)
        for k in range(words):
            inside = at[first] + k < have[first]
            h = np.where(inside, _mix(h * _U(0x9E3779B97F4A7C15) + flat[np.minimum(first + k, len(flat) - 1)]), h) if len(flat) else h
    row = row[first]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.concatenate([new, [len(row)]]))


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle of each register, n x registers, by early arrivals of Poisson processes."""
    first = np.full(n * registers, np.inf)
    out = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(h))
    draw, block = 0, 1
    with np.errstate(over="ignore"):
        while len(h):
            steps = _U(0xD1B54A32D192ED03) * np.arange(draw + 1, draw + block + 1, dtype=np.uint64)
            bits = _mix(h[:, None] ^ _mix(steps)[None, :])
            gap = -np.log1p(-((bits >> _U(11)).astype(np.float64) * 2.0**-53)) / weight[:, None]
            arrival = time[:, None] + np.cumsum(gap, 1)
            place = row[:, None] * registers + (_mix(bits + _U(0x632BE59BD9B4E019)) % _U(registers)).astype(np.int64)
            np.minimum.at(first, place.ravel(), arrival.ravel())
            won, step = np.nonzero(arrival == first[place])
            out[place[won, step]] = h[won]
            latest = first.reshape(n, registers).max(1)
            time = arrival[:, -1]
            live = time < latest[row]
            row, h, weight, time = row[live], h[live], weight[live], time[live]
            draw += block
            block = 1 if draw < 3 else 16
    return out.reshape(n, registers)


SIGNED = T.StructType([T.StructField("c0", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])


def sign(texts: pa.Array) -> list:
    """Content hashes, number of shingles, bands and 16 bits of each register."""
    rows = [x.decode().lower().encode() for x in blobs(texts)]
    out: list[list] = [[] for _ in SIGNED.fields]
    for part in slices([len(x) for x in rows], CHUNK):
        some = rows[part]
        row, h, count = shingles(some)
        sig = signatures(row, h, weights(count), len(some))
        with np.errstate(over="ignore"):
            key = np.full((len(some), BANDS), 0x51ED270B, np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(ROWS):
                key = _mix(key * _U(0x9E3779B97F4A7C15) + sig[:, k : BANDS * ROWS : ROWS])
        short = (_mix(sig) >> _U(48)).astype("<u2")
        size = np.bincount(row, minlength=len(some))
        ends = np.cumsum(size)
        for i, n in enumerate(size):
            at = slice(ends[i] - n, ends[i])
            c = xxhash.xxh3_128_digest(h[at].tobytes() + count[at].tobytes())
            out[0].append(int.from_bytes(c[:8], "little", signed=True))
            out[1].append(int.from_bytes(c[8:], "little", signed=True))
        out[2].extend(size.tolist())
        out[3].extend(key.view(np.int64).tolist())
        out[4].extend(short[i].tobytes() for i in range(len(some)))
    return out


def pack_set(h: np.ndarray, count: np.ndarray) -> bytes:
    """32 bits of each shingle, in order, and counts where they aren't 1."""
    short = (h >> _U(32)).astype(np.uint32)
    many = np.flatnonzero(count > 1)
    return zstd.ZstdCompressor(level=1).compress(np.array([len(h), len(many)], np.uint32).tobytes() + np.diff(short, prepend=np.uint32(0)).tobytes() + many.astype(np.uint32).tobytes() + count[many].astype(np.uint32).tobytes())


def unpack_set(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(zstd.ZstdDecompressor().decompress(data), np.uint32)
    n, m = int(whole[0]), int(whole[1])
    count = np.ones(n)
    count[whole[2 + n : 2 + n + m]] = whole[2 + n + m :]
    return np.cumsum(whole[2 : 2 + n], dtype=np.uint32), weights(count)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (sorted hashes, weights): sort by weight ratio, then running sums."""
    ids, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    wa, wb = np.zeros(len(ids)), np.zeros(len(ids))
    np.add.at(wa, where[: len(a[0])], a[1])
    np.add.at(wb, where[len(a[0]) :], b[1])
    with np.errstate(divide="ignore"):
        ratio = wb / wa
    order = np.argsort(ratio, kind="stable")
    wa, wb, ratio = wa[order], wb[order], ratio[order]
    both = np.flatnonzero((wa > 0) & (wb > 0))
    if not len(both):
        return 0.0
    # up to an equal ratio the sum takes a's share, beyond it b's
    upto = np.searchsorted(ratio, ratio[both], "right")
    sum_a, sum_b = np.concatenate([[0], np.cumsum(wa)]), np.concatenate([[0], np.cumsum(wb)])
    return float((1 / (sum_a[upto] / wa[both] + (sum_b[-1] - sum_b[upto]) / wb[both])).sum())


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Node and least node of its component, for the nodes of ``edges`` (a, b).

    Every node takes its least neighbour below it for its parent, pointers jump to the roots,
    and edges that still join two roots are solved likewise.
    """
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    label = scratch.write(down.groupBy("node").agg(F.min("root").alias("root")), f"{name}-0")
    k = 0
    while True:
        beyond = label.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        if not label.join(beyond, "root", "left_semi").limit(1).count():
            break
        k += 1
        label = scratch.write(label.join(beyond, "root", "left").select("node", F.coalesce("beyond", "root").alias("root")), f"{name}-{k}")
    own = label.union(label.select(F.col("root").alias("node"), "root").distinct())
    rest = scratch.write(_rooted(edges, own).distinct(), f"{name}-rest")
    if not rest.limit(1).count():
        return own
    above = components(rest, scratch, f"{name}r").select(F.col("node").alias("root"), F.col("root").alias("to"))
    return scratch.write(own.join(above, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-all")


def _least(threshold: float) -> float:
    """Share of equal registers below which no similar pair is looked for."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures may be similar and whose exact J_P reaches the threshold."""
    least = _least(threshold)
    a, b = (sets.select(F.col("rid").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b"))

    def run(sig_a: pa.Array, sig_b: pa.Array, set_a: pa.Array, set_b: pa.Array) -> list:
        n = len(sig_a)
        u, v = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(n, -1) for c in (sig_a, sig_b))
        near = (u == v).mean(1) >= least if n else []
        cache: tuple[bytes, tuple] = (b"", ())
        out = np.zeros(n)
        for i in np.flatnonzero(near):
            q = set_b[i].as_py()
            if q != cache[0]:
                cache = q, unpack_set(q)
            out[i] = probability_jaccard(unpack_set(set_a[i].as_py()), cache[1])
        return [out]

    # a leader may have any number of partners: Spark splits the rows of such a key (AQE)
    met = pairs.join(a, "a").join(b, "b")
    similar = annotate(met, run, ["sig_a", "sig_b", "set_a", "set_b"], T.StructType([T.StructField("jp", T.DoubleType())]), ["a", "b"])
    return similar.filter(F.col("jp") >= threshold - 1e-12).select("a", "b")


def tiles(shared: DataFrame, root: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """Members (band, x, y, block, rid, root) of the tiles of buckets that hold two components.

    The first round compared the bucket's first member with all: it stays away.
    """
    members = shared.filter("rid <> b").select("band", "rid").join(root.withColumnRenamed("node", "rid"), "rid", "left").select("band", "rid", F.coalesce("root", "rid").alias("root"))
    sizes = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    bands = sizes.groupBy("band").agg(F.sum("size").alias("n"), F.max(F.struct("size", "root")).alias("x"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    crowd, others = (F.ceil(c / block) for c in (F.col("x.size"), F.col("n") - F.col("x.size")))
    bands = bands.select("band", F.col("x.root").alias("most"), (F.col("n") <= block).alias("few"), crowd.alias("mc"), others.alias("mo"))
    bands = scratch.write(bands, "bands")
    salt, own = F.xxhash64("rid", "band", F.lit("tile")), F.col("root") == F.col("most")
    place = F.when(F.col("few"), F.lit(0).cast("long")).when(own, F.pmod(salt, F.col("mc"))).otherwise(F.col("mc") + F.pmod(salt, F.col("mo")))
    meets = F.when(F.col("few"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.when(own, F.col("mc")).otherwise(F.lit(0).cast("long")), F.col("mc") + F.col("mo") - 1))
    dealt = members.join(bands, "band").select("band", "rid", "root", place.alias("block"), F.explode(meets).alias("with"))
    return dealt.select("band", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "rid", "root")


def bounds(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Upper bounds of J_P, left x right.

    1 / J_P has at least X / Cx + Y / Cy - 1 (Jensen), for weights X, Y of the sets of which Cx, Cy
    are on common shingles; equality holds where all common weights are equal.
    """
    sets = left + right
    size = [len(h) for h, _ in sets]
    row = np.repeat(np.arange(len(sets)), size)
    ids, col = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    weight = np.concatenate([w for _, w in sets])
    n, whole = len(left), np.bincount(row, weight, minlength=len(sets))
    both = (np.bincount(col[row < n], minlength=len(ids)) > 0) & (np.bincount(col[row >= n], minlength=len(ids)) > 0)
    keep = both[col]
    row, weight, col = row[keep], weight[keep], (np.cumsum(both) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, weight, col = row[order], weight[order], col[order]
    cx, cy = np.zeros((n, len(right)), np.float32), np.zeros((n, len(right)), np.float32)
    for a in range(0, int(both.sum()), 2_000):
        at = slice(*np.searchsorted(col, [a, a + 2_000]))
        grid = np.zeros((len(sets), 2_000), np.float32)
        np.add.at(grid, (row[at], col[at] - a), weight[at])
        has = (grid > 0).astype(np.float32)
        cx += grid[:n] @ has[n:].T
        cy += has[:n] @ grid[n:].T
    with np.errstate(divide="ignore"):
        return 1 / (whole[:n, None] / cx + whole[None, n:] / cy - 1)


def links_of_tile(band: int, same: bool, block: np.ndarray, root: np.ndarray, sig: np.ndarray, bands: np.ndarray, sets: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Rows that link the components of a tile (``same``: of one block), a forest of all similar pairs.

    Pairs that share an earlier band meet in that one's tiles.
    """
    rows = np.arange(len(root))
    left, right = (rows, rows) if same else (rows[block == block.min()], rows[block == block.max()])
    least = _least(threshold)
    some: list[np.ndarray] = []
    for at in range(0, len(left), 64):
        part = left[at : at + 64]
        cross = root[part][:, None] != root[right][None, :]
        if same:
            cross &= part[:, None] < right[None, :]
        i, j = np.nonzero(cross)
        if len(i) * 8 < cross.size:
            near = (sig[part[i]] == sig[right[j]]).mean(1) >= least
        else:
            near = (sig[part][:, None, :] == sig[right][None, :, :]).mean(2)[i, j] >= least
        i, j = part[i[near]], right[j[near]]
        first = (bands[i] == bands[j]).argmax(1)
        own = bands[i, first] == band
        some.append(np.stack([i[own], j[own]], 1))
    pairs = np.concatenate(some) if some else np.zeros((0, 2), np.int64)
    known: dict[int, tuple] = {}

    def content(k: int) -> tuple:
        if k not in known:
            known[k] = unpack_set(sets[k])
        return known[k]

    if len(pairs) > MANY:
        (one, i), (two, j) = (np.unique(c, return_inverse=True) for c in pairs.T)
        most = bounds([content(k) for k in one], [content(k) for k in two])[i, j]
        pairs = pairs[most >= threshold - 1e-4]
    above: dict[int, int] = {}

    def top(k: int) -> int:
        while k in above:
            k = above[k]
        return k

    out = []
    for i, j in pairs.tolist():
        a, b = top(int(root[i])), top(int(root[j]))
        if a != b and probability_jaccard(content(i), content(j)) >= threshold - 1e-12:
            above[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _across(shared: DataFrame, root: DataFrame, sets: DataFrame, reps: DataFrame, threshold: float, block: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of all similar pairs that share a bucket and no component."""

    def run(batches):
        now, held = None, []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[:3] != now:
                    yield from found(now, held)
                    now, held = r[:3], []
                held.append(r[3:])
        yield from found(now, held)

    def found(key: tuple | None, held: list[tuple]):
        if len({r[2] for r in held}) < 2:
            return
        own, rid, root_, sig, bands, data = zip(*held, strict=True)
        links = links_of_tile(key[0], key[1] == key[2], np.array(own), np.array(root_), np.frombuffer(b"".join(sig), "<u2").reshape(len(sig), -1), np.array(bands), data, threshold)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([rid[p[k]] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = tiles(shared, root, block, scratch).join(sets, "rid").join(reps.select("rid", "bands"), "rid")
    order = ["band", "x", "y"]
    return dealt.repartition(*order).sortWithinPartitions(*order).select(*order, "block", "rid", "root", "sig", "bands", "shingles").mapInArrow(frugal(run), "a long, b long").distinct()


def _joined(links: DataFrame, root: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """``root`` after links between components have moved whole components."""
    joined = components(scratch.write(_rooted(links, root).distinct(), f"between{k}"), scratch, f"c{k}").select(F.col("node").alias("root"), F.col("root").alias("to"))
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().join(root, "node", "left_anti").select("node", F.col("node").alias("root"))
    return scratch.write(root.union(ends).join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"root{k}")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Per document (k0, k1 as in ``keyed``): class_id, kept."""
    scratch = Scratch(docs.sparkSession, "near")
    base = keyed(docs, text, key)
    signed = scratch.write(annotate(base, sign, ["t"], SIGNED, ["k0", "k1"]), "signed")
    once = signed.filter("n > 0").groupBy("c0", "c1").agg(F.min(F.struct("k0", "k1")).alias("k"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = scratch.write(once.select(F.monotonically_increasing_id().alias("rid"), "c0", "c1", "k", "bands", "sig"), "reps")
    buckets = reps.select("rid", F.explode("bands").alias("band"))
    # tables of bands are written before they are joined: Spark splits a large band's rows (AQE) only
    # where both sides of a join come straight from a shuffle
    many = scratch.write(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("b")).filter("n > 1").select("band", "b"), "many")
    shared = scratch.write(buckets.join(many, "band").select("band", "rid", "b"), "shared")
    # sets of all that share a bucket: every later round reads them
    needed = reps.select("rid", F.col("k.k0").alias("k0"), F.col("k.k1").alias("k1"), "sig").join(shared.select("rid").distinct(), "rid")
    texts = base.join(needed.hint("shuffle_hash"), ["k0", "k1"]).select("rid", "sig", "t")

    def sets_of(column: pa.Array) -> list:
        rows = [x.decode().lower().encode() for x in blobs(column)]
        out = []
        for part in slices([len(x) for x in rows], CHUNK):
            row, h, count = shingles(rows[part])
            ends = np.searchsorted(row, np.arange(part.stop - part.start + 1))
            out += [pack_set(h[a:z], count[a:z]) for a, z in zip(ends, ends[1:])]
        return [out]

    sets = scratch.write(annotate(texts, sets_of, ["t"], T.StructType([T.StructField("shingles", T.BinaryType())]), ["rid", "sig"]).dropDuplicates(["rid"]), "sets")
    pairs = shared.filter("rid <> b").select(F.col("rid").alias("a"), "b").distinct()
    root: DataFrame | None = None
    for k in range(ROUNDS):
        links = scratch.write(_verified(pairs, sets, threshold), f"links{k}")
        if k and links.limit(1).count() == 0:
            break
        if root is None:
            root = scratch.write(components(links, scratch, "c0"), "root0")
        else:
            root = _joined(links, root, scratch, k)
        sized = root.join(root.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root").select(F.col("node").alias("rid"), "root", "size")
        members = shared.select("band", "rid").join(sized, "rid", "left").select("band", "rid", F.coalesce("root", "rid").alias("root"), F.coalesce("size", F.lit(1)).alias("size"))
        order = F.xxhash64("rid", "band", F.lit(k))
        one = F.struct((-F.col("size")).alias("s"), order.alias("o"), "rid", "root")  # of the largest component
        two = F.struct(F.lit(0).cast("long").alias("s"), order.alias("o"), "rid", "root", "size")
        leads = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(one).alias("x"), F.max(two).alias("y")).filter("low <> high")
        leads = leads.select("band", F.explode(F.array(F.struct(F.col("x.rid").alias("b"), F.col("x.root").alias("to"), (-F.col("x.s")).alias("most")), F.struct(F.col("y.rid").alias("b"), F.col("y.root").alias("to"), F.col("y.size").alias("most")))).alias("lead")).select("band", "lead.*")
        leads = scratch.write(leads, f"leads{k}")
        # the smaller component asks the larger: one stranger never meets a whole crowd
        asks = (F.col("root") != F.col("to")) & ((F.col("size") < F.col("most")) | ((F.col("size") == F.col("most")) & (F.col("root") > F.col("to"))))
        pairs = members.join(leads, "band").filter(asks).select(F.col("rid").alias("a"), "b").distinct()
    links = scratch.write(_across(shared, root, sets, reps, threshold, BLOCK, scratch), "across")
    if links.limit(1).count():
        root = _joined(links, root, scratch, ROUNDS)
    found = reps.select("c0", "c1", "rid", "k").join(root.withColumnRenamed("node", "rid"), "rid", "left").select("c0", "c1", "k", F.coalesce("root", "rid").alias("root"))
    first = found.groupBy("root").agg(F.min("k").alias("lead"))
    classes = found.join(first, "root").select("c0", "c1", "lead")
    out = signed.select("k0", "k1", "c0", "c1", "n").join(classes, ["c0", "c1"], "left")
    lead = F.when((F.col("n") > 0), F.col("lead")).otherwise(F.struct("k0", "k1"))
    return scratch.write(out.select("k0", "k1", lead.getField("k0").alias("class_id"), (lead == F.struct("k0", "k1")).alias("kept")), "classes")


def _rooted(links: DataFrame, root: DataFrame) -> DataFrame:
    a, b = root.select(F.col("node").alias("a"), F.col("root").alias("ra")), root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b")


def keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """k0 and k1 tell documents apart, in order; t is the text."""
    return docs.select(F.coalesce(quoted(key).cast("long"), F.lit(_LOWEST)).alias("k0"), F.xxhash64(quoted(text)).alias("k1"), quoted(text).alias("t"))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the key, class_id and kept (null ids stay null)."""
    found = near_duplicates(docs, text, key, threshold)
    own = lambda c: F.when(F.col(c) != _LOWEST, F.col(c))
    return found.select(own("k0").alias(key), own("class_id").alias("class_id"), "kept")


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The first document of each class, once, with all its columns."""
    found = near_duplicates(docs, text, key, threshold)
    stay = found.filter("kept").groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("copies"))
    held = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.coalesce(quoted(key).cast("long"), F.lit(_LOWEST)).alias("k0"), F.xxhash64(quoted(text)).alias("k1"))
    out = held.join(stay.hint("shuffle_hash"), ["k0", "k1"])
    # rows that repeat in id and text are rare: only they are grouped
    one = out.filter("copies = 1").select("row")
    rest = out.filter("copies > 1").groupBy("k0", "k1").agg(F.first("row").alias("row")).select("row")
    if stay.filter("copies > 1").limit(1).count():
        one = one.union(rest)
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
