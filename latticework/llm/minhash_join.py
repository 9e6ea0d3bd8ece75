"""Similarity join on sets of five-word shingles, with Bayesian pruning of candidates.

1. Equal texts form a class, represented by its smallest document id. Each text gets a MinHash
   signature. Classes that agree in a band of it are candidates (``BANDS`` bands of ``ROWS`` values
   miss a pair of similarity 0.8 with probability 5e-6).
2. In a bucket, signatures are compared ``STEP`` values at a time; a pair is dropped when the
   posterior probability (uniform prior) of reaching the threshold falls below ``TOLERANCE``.
   What survives gives a spanning forest a bucket, and the forests give candidate components.
3. Each component's texts come together once, in blocks of bounded size, and all pairs in it are
   verified exactly on their shingle hashes (64 bits). Links are counted there, and the verified
   forests give the final groups.

Nothing is emitted by pairs: rows out of buckets and components grow with their members. A bucket
or component beyond a block is spread over tasks by pairs of blocks, so a hot group stays whole and
no task holds more than two blocks; each of its members is sent once for every block of the group.
Equal texts are one member, however many documents have them.

Words are what ASCII white space separates. A text of fewer than five words is one shingle; texts
without words (null and empty ones included) link to nothing. Null and repeated document ids are
carried along; the class of a null id has the smallest other id of its group, or null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, field, map_batches, materialise, own_name, texts_of
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 40, 6, 24, 1e-7
HASHES = BANDS * ROWS
BUCKET_BLOCK = 8192  # classes of a bucket in one block
DOCS_BLOCK, SHINGLES_BLOCK = 4096, 2_000_000  # texts and shingles of a component in one block
TEXT_BUCKETS = 1 << 18

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:  # workers keep it, so it is small
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(1)
def _words() -> WordHashes:
    return WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in a row, repeated ones too, and how many each text has."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    get = _words().__getitem__
    w = np.fromiter((get(x) for ws in split for x in ws), np.uint64, int(n_words.sum()))
    n = np.where(n_words >= WORDS, n_words - WORDS + 1, np.minimum(n_words, 1))
    first = np.repeat(np.cumsum(n_words) - n_words, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(np.cumsum(n_words), n) - first  # words from here to the end of the text
    h = np.zeros(len(first), np.uint64)
    for k in range(WORDS):
        here = w[np.minimum(first + k, len(w) - 1)] if len(w) else h
        h = np.where(left > k, mixed(h * np.uint64(0x9E3779B97F4A7C15) + here + np.uint64(k)), h)
    return h, n


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The low 16 bits of ``HASHES`` MinHash values of each text that has shingles."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], starts).astype(np.uint16) if len(starts) else 0
    return out


@lru_cache(1)
def least_matches() -> list[tuple[int, int]]:
    """(values compared, fewest of them equal) to keep a pair: the posterior Beta(m + 1, n - m + 1)
    reaches the threshold with probability P(Binomial(n + 1, threshold) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < TOLERANCE:
            m += 1
            p += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        out.append((n, m))
    return out


def likely(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of rows of ``s`` stay, compared step by step."""
    live, equal, at = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, least in least_matches():
        equal[live] += (s[i[live], at:n] == s[j[live], at:n]).sum(1)
        live = live[equal[live] >= least]
        at = n
        if not len(live):
            break
    return live


def forest(s: np.ndarray) -> np.ndarray:
    """Root (a row number) of every row: rows linked by likely pairs. Each visited row is compared
    with rows not visited yet only, so a dense group costs little more than one pass."""
    root, left = np.arange(len(s)), np.arange(len(s))
    while len(left):
        queue, left = [left[0]], left[1:]
        at = 0
        while at < len(queue) and len(left):
            new = likely(s, np.full(len(left), queue[at]), left)
            root[left[new]] = queue[0]
            queue.extend(left[new].tolist())
            left = np.delete(left, new)
            at += 1
    return root


def groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold whole groups of equal ``key``; rows that belong to an
    unfinished group wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = _keys(b, key)
        same = np.flatnonzero((k[1:] != k[:-1]).any(1))
        if held:
            last = _keys(held[-1].slice(held[-1].num_rows - 1), key)[0]
            cut = 0 if (k[0] != last).any() else (int(same[0]) + 1 if len(same) else -1)
            if cut < 0:
                held.append(b)
                continue
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            b, k = b.slice(cut), k[cut:]
            same = np.flatnonzero((k[1:] != k[:-1]).any(1))
            held = []
            if not b.num_rows:
                continue
        if len(same):
            yield pa.Table.from_batches([b.slice(0, int(same[-1]) + 1)])
            b = b.slice(int(same[-1]) + 1)
        held = [b]
    if held:
        yield pa.Table.from_batches(held)


def _keys(t: pa.RecordBatch | pa.Table, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([t.column(t.schema.get_field_index(n)).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t[n].to_numpy() for n in names], 1)


def bounds(t: pa.Table, key: tuple[str, ...]) -> list[tuple[int, int]]:
    k = _keys(t, key)
    edge = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
    return list(zip(edge, edge[1:]))


def by_groups(df: DataFrame, key: tuple[str, ...], fn: Callable[[Iterator[pa.Table]], Iterator[list]], schema: T.StructType) -> DataFrame:
    """Bring rows of equal ``key`` together and let ``fn`` turn tables of whole groups into rows."""
    ordered = df.repartition(*key).sortWithinPartitions(*key)
    return map_batches(ordered, lambda batches: fn(groups(batches, key)), schema, text=None)


def fingerprints(docs: DataFrame, *, carry: list[str], key: str, text: str) -> DataFrame:
    """``carry`` and a struct ``_f``: uid long, id, digest binary (of the text), n (shingles), sig
    (null where the text has no words) and text, unless that is carried. Written down, so uids stay."""
    inner = T.StructType([field("uid", "bigint"), docs.schema[key].__class__("id", docs.schema[key].dataType, True), field("digest", "binary"), field("n", "bigint"), field("sig", "binary"), *([] if text in carry else [field("text", "string")])])
    name, own = own_name(docs, "_f"), [own_name(docs, x) for x in ("_uid", "_id", "_digest", "_text")]
    schema = T.StructType([*[docs.schema[c] for c in carry], field(name, inner)])

    def run(batches):
        for b in batches:
            h, n = shingles(texts_of(b, own[3]))
            sig = iter(map(bytes, signatures(h, n)))
            sigs = pa.array([next(sig) if x else None for x in n.tolist()], pa.binary())
            cols = [column(b, own[0]), column(b, own[1]), column(b, own[2]), pa.array(n), sigs, *([] if text in carry else [column(b, own[3])])]
            yield [*[b.column(i) for i in range(len(carry))], pa.StructArray.from_arrays(cols, [f.name for f in inner])]

    picked = docs.select(*carry, F.monotonically_increasing_id().alias(own[0]), F.col(key).alias(own[1]), F.unhex(F.md5(F.col(text))).alias(own[2]), F.col(text).alias(own[3]))
    return materialise(map_batches(picked, run, schema, limit=2 << 20, text=own[3]), "prints")


def classes_of(prints: DataFrame, f: str) -> DataFrame:
    """One row for each distinct text with words: ``cid`` (uid of its representative), ``id``,
    ``digest``, ``n``, ``sig``, ``copies``."""
    p = F.col(f)
    first = F.min(F.struct(p["id"].isNull().alias("none"), p["id"].alias("id"), p["uid"].alias("uid"), p["n"].alias("n"), p["sig"].alias("sig"))).alias("m")
    rows = prints.filter(p["sig"].isNotNull()).groupBy(p["digest"].alias("digest")).agg(first, F.count("*").alias("copies"))
    return materialise(rows.select(F.col("m.uid").alias("cid"), F.col("m.id").alias("id"), "digest", F.col("m.n").alias("n"), F.col("m.sig").alias("sig"), "copies"), "classes")


def block_pairs(df: DataFrame, member: str, n_blocks: Column) -> DataFrame:
    """Deal the members of each group to blocks by hash and repeat each for all pairs of blocks
    that its own is in: ``own`` is its block, ``pair`` the number of the pair, and ``across`` tells
    whether that is of two blocks."""
    df = df.withColumn("nb", n_blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64(member), F.col("nb")).cast("int"))
    other = F.explode(F.when(F.col("nb") > 1, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(F.lit(0))))
    df = df.withColumn("other", other).withColumn("across", F.col("own") != F.col("other"))
    return df.withColumn("pair", F.least("own", "other").cast("bigint") * F.col("nb") + F.greatest("own", "other")).drop("other", "nb")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Spanning forests of the likely pairs in all buckets: edges (a, b) between cids."""
    schema = T.StructType([field("key", "bigint"), field("cid", "bigint")])
    salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def bands(batches):
        for b in batches:
            s = np.frombuffer(b"".join(column(b, "sig").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(salt, s.shape[:2]).copy()
            for k in range(ROWS):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
            yield [pa.array(h.view(np.int64).reshape(-1)), pa.array(np.repeat(column(b, "cid").to_numpy(), BANDS))]

    rows = map_batches(classes.select("cid", "sig"), bands, schema, text=None)
    several = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").withColumnRenamed("key", "k")
    buckets = block_pairs(rows.join(several, F.col("key") == F.col("k")).select("key", "cid", "m"), "cid", F.ceil(F.col("m") / BUCKET_BLOCK))
    members = buckets.select("key", "pair", "cid").join(classes.select(F.col("cid").alias("c"), "sig"), F.col("cid") == F.col("c")).drop("c")

    def link(tables):
        for t in tables:
            cid = t["cid"].to_numpy()
            s = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
            a, b = [], []
            small_i, small_j = [], []
            for lo, hi in bounds(t, ("key", "pair")):
                if hi - lo <= 8:
                    i, j = np.triu_indices(hi - lo, 1)
                    small_i.append(i + lo)
                    small_j.append(j + lo)
                elif hi - lo > 1:
                    r = forest(s[lo:hi]) + lo
                    a.append(cid[lo:hi])
                    b.append(cid[r])
            if small_i:
                i, j = np.concatenate(small_i), np.concatenate(small_j)
                live = likely(s, i, j)
                a.append(cid[i[live]])
                b.append(cid[j[live]])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield [pa.array(a[a != b]), pa.array(b[a != b])]

    return by_groups(members, ("key", "pair"), link, T.StructType([field("a", "bigint"), field("b", "bigint")]))


def links_between(sets: list[np.ndarray], own: np.ndarray, across: bool, chunk: int = 512, width: int = 2048) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its linked rows), for pairs that this block pair is to judge: ``across`` its two
    blocks, even if rows of one of them only are there, else within its one. Intersections are exact: products of 0/1 matrices, ``width`` shingles
    at a time, below 2**24."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets)
    _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = df[ids] > 1
    ids, owner = ids[shared], owner[shared]
    new = np.cumsum(df > 1) - 1
    ids = new[ids]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    tops = np.searchsorted(ids, np.arange(0, (ids[-1] if len(ids) else 0) + width + 1, width))
    for lo in range(0, n, chunk):
        hi = min(n, lo + chunk)
        common = np.zeros((hi - lo, n), np.float32)
        for k, (x, y) in enumerate(zip(tops, tops[1:])):
            if x < y:
                m = np.zeros((n, width), np.float32)
                m[owner[x:y], ids[x:y] - k * width] = 1
                if m[lo:hi].any():
                    common += m[lo:hi] @ m.T
        for i in range(lo, hi):
            c = common[i - lo].astype(np.int64)
            # |x & y| / |x | y| >= 4 / 5, in whole numbers
            ok = 5 * c >= 4 * (sizes[i] + sizes - c)
            ok[i] = False
            if across:
                ok &= own != own[i]
            yield i, np.flatnonzero(ok)


def roots_of(n: int, links: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Smallest row of each row's component, by passing labels along links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for i, js in links:
            if len(js):
                least = min(label[i], label[js].min())
                label[i] = least
                label[js] = np.minimum(label[js], least)
        if (label == before).all():
            return label


def verified(texts: DataFrame, classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """``cid, root, links`` for each member and pair of blocks: its local root among verified links
    and how many documents it links to in other classes. ``texts``: ``uid`` and ``text`` of all rows,
    of which only those of the classes' representatives are used."""
    members = candidates.join(classes.drop("sig"), F.col("node") == F.col("cid")).select("cid", "copies", "n", F.col("root").alias("comp"))
    members = materialise(members, "members")
    size = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("all_n")).withColumnRenamed("comp", "of")
    dealt = members.join(size, F.col("comp") == F.col("of")).select("comp", "cid", "copies", F.greatest(F.ceil(F.col("m") / DOCS_BLOCK), F.ceil(F.col("all_n") / SHINGLES_BLOCK)).alias("blocks"))
    # texts whose number falls in no member's bucket are left out before the shuffle; the table of
    # buckets has ``TEXT_BUCKETS`` rows at most, however many members there are
    bucket = lambda uid: F.pmod(F.xxhash64(uid), F.lit(TEXT_BUCKETS)).cast("int")
    used = members.select(bucket("cid").alias("_b")).distinct()
    bodies = texts.join(F.broadcast(used), bucket("uid") == F.col("_b"), "left_semi")
    # a sorted join at every size: the members grow with the corpus, so they are never broadcast
    joined = bodies.join(dealt.hint("merge"), F.col("uid") == F.col("cid")).select("comp", "cid", "copies", "blocks", "text")
    spread = block_pairs(joined, "cid", F.col("blocks")).select("comp", "pair", "own", "across", "cid", "copies", "text")

    def verify(tables):
        for t in tables:
            out = []
            all_cid, all_copies, all_own, texts = t["cid"].to_numpy(), t["copies"].to_numpy(), t["own"].to_numpy(), t["text"]
            for lo, hi in bounds(t, ("comp", "pair")):
                at = np.arange(lo, hi)
                cid, copies = all_cid[at], all_copies[at]
                h, n = shingles([texts[int(i)].as_py() for i in at])
                sets = [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]
                links = list(links_between(sets, all_own[at], t["across"][lo].as_py()))
                root = roots_of(len(at), links)
                out += [(int(cid[i]), int(cid[root[i]]), int(copies[js].sum())) for i, js in links]
            if out:
                a, b, c = zip(*out)
                yield [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())]

    return by_groups(spread, ("comp", "pair"), verify, T.StructType([field("cid", "bigint"), field("root", "bigint"), field("links", "bigint")]))


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row a document: ``carry`` (``key`` alone if None), ``class_id`` (smallest id of its
    group of linked documents), ``n_links`` (other documents with a similarity of 0.8 or more),
    ``copy_of`` (smallest id with the same text) and ``first`` (true for one row of each group)."""
    carry = [key] if carry is None else carry
    clash = {"class_id", "n_links", "copy_of", "first"} & {c.lower() for c in carry}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    prints = fingerprints(docs, carry=carry, key=key, text=text)
    f = prints.columns[-1]
    classes = classes_of(prints, f)
    candidates = components(candidate_edges(classes))
    p = F.col(f)
    texts = prints.select(p["uid"].alias("uid"), (F.col(text) if text in carry else p["text"]).alias("text"))
    found = materialise(verified(texts, classes, candidates), "verified")
    final = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy(F.col("cid").alias("of")).agg(F.sum("links").alias("links"))
    slim = classes.select("cid", "id", "digest", "copies")
    grouped = slim.join(final, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid")).join(links, F.col("cid") == F.col("of"), "left")
    grouped = materialise(grouped.select("cid", "id", "digest", "copies", "root", F.coalesce("links", F.lit(0)).alias("links")), "grouped")
    least = grouped.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "cid")).alias("least"))
    named = grouped.join(least, F.col("root") == F.col("r")).select("digest", F.col("least.id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("id").alias("copy_of"), F.col("least.cid").alias("keep"))
    out = prints.join(named, p["sig"].isNotNull() & (p["digest"] == F.col("digest")), "left")
    alone = F.col("keep").isNull()
    return out.select(
        *[F.col(c) for c in carry],
        F.when(alone, p["id"]).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, p["id"]).otherwise(F.col("copy_of")).alias("copy_of"),
        (alone | (F.col("keep") == p["uid"])).alias("first"),
    )


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the one with the smallest id
    stays, and all texts without words."""
    own = {c: own_name(docs, f"_{i}_{c}") for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in own.items()])
    out = join(renamed, key=own[key], text=own[text], carry=list(own.values()))
    return out.filter("first").select(*[F.col(n).alias(c) for c, n in own.items()])
