"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation. Every code point is mapped to a class through a table, and every class to a
transition function of a small automaton. Those functions form a finite monoid, so their
composition is one table look-up and associative: the text is cut into equal chunks, all chunks
compose their functions side by side, a log-depth scan over the chunks gives the state in which
each begins, and a second side-by-side pass marks where pieces start.

Merging. Slices between the marks go to a cache of encoded pieces. All pieces that are not in it
are merged together, one merge a piece and round, with NumPy. Ids come out as little-endian
unsigned 32-bit integers; the offsets of documents and pieces are kept, and decoding goes by them.

Null texts count as empty; an empty text has no ids. Lone surrogates can't occur in UTF-8 input.
Rows are handled one by one, so ties, repeated rows and empty tables need no care.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import field, map_batches, texts_of, column, tokenizer_file

# Fixed values of the public pattern: contractions, and the code points of Unicode's White_Space.
SHORT = "stmd"
LONG = ("re", "ve", "ll")
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

LETTER, NUMBER, OTHER, SPACE = range(4)
#: What the automaton reads: letter, number, other, apostrophe of a contraction with one and with
#: two letters, last blank of a run before something, another last white space, inner white space.
READS = ("L", "N", "O", "A1", "A2", "blank", "last", "inner")
STATES = ("begin", "letters", "numbers", "others", "joined", "run", "single", "a1", "a2", "a2b", "ended")


def _step(state: str, read: str) -> tuple[str, bool]:
    """(next state, whether a piece starts here) when the automaton reads ``read`` in ``state``."""
    kind = {"L": "letters", "N": "numbers", "O": "others", "A1": "others", "A2": "others"}.get(read)
    if state in ("a1", "a2b"):
        return "ended", False
    if state == "a2":
        return "a2b", False
    if state == "joined" and kind:
        return kind, False
    if state == "others" and kind == "others" or state == kind:
        return kind, False
    if read == "inner":
        return "run", state != "run"
    return {"A1": "a1", "A2": "a2", "blank": "joined", "last": "single"}.get(read) or kind, True


class Automaton:
    """The transition monoid: ``after[m, r]`` composes element m with read r, ``then[m, n]`` two
    elements. Reads 8 to 15 are 0 to 7 at a text's first character, where nothing earlier counts."""

    def __init__(self) -> None:
        n = len(STATES)
        self.next = np.zeros((n, 16), np.uint8)
        self.starts = np.ones((n, 16), bool)
        for i, s in enumerate(STATES):
            for j, r in enumerate(READS):
                to, self.starts[i, j] = _step(s, r)
                self.next[i, j] = STATES.index(to)
        self.next[:, 8:] = self.next[0, :8]
        single = [tuple(self.next[:, r]) for r in range(16)]
        found = {tuple(range(n)): 0}
        order = [tuple(range(n))]
        for m in order:
            for g in single:
                if (c := tuple(g[x] for x in m)) not in found:
                    found[c] = len(order)
                    order.append(c)
        self.maps = np.array(order, np.uint8)
        self.after = np.array([[found[tuple(g[x] for x in m)] for g in single] for m in order], np.uint16)
        self.then = np.array([[found[tuple(b[x] for x in a)] for b in order] for a in order], np.uint16)
        # the same tables for flat look-ups: rows are element << 4 or state << 4, columns are reads
        self.after16 = (self.after << 4).reshape(-1)
        self.next16, self.starts16 = np.zeros(256, np.uint8), np.zeros(256, bool)
        self.next16[: n * 16], self.starts16[: n * 16] = (self.next << 4).reshape(-1), self.starts.reshape(-1)

    def piece_starts(self, reads: np.ndarray, width: int = 256) -> np.ndarray:
        """Positions at which pieces start. Associative scan over chunks of ``width`` reads."""
        n = len(reads)
        if not n:
            return np.zeros(0, np.int64)
        rows = -(-n // width)
        grid = np.zeros(rows * width, np.uint8)
        grid[:n] = reads
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        whole = np.zeros(rows, np.uint16)
        for line in grid:
            whole = self.after16.take(whole | line)
        whole >>= 4
        d = 1
        while d < rows:  # log-depth scan: whole[i] becomes the composition of chunks 0 to i
            whole = np.concatenate([whole[:d], self.then[whole[:-d], whole[d:]]])
            d *= 2
        state = np.zeros(rows, np.uint8)
        state[1:] = self.maps[whole[:-1], 0] << 4
        marks = np.empty(grid.shape, bool)
        for k, line in enumerate(grid):
            state |= line
            self.starts16.take(state, out=marks[k])
            state = self.next16.take(state)
        return np.flatnonzero(marks.T.reshape(-1)[:n])


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, from the general category; white space first."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def pieces_of(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts joined, the start of every piece in it, and the offset of every text (one more
    than texts). A piece never reaches over the end of its text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    joined = "".join(texts)
    n = len(joined)
    if not n:
        return joined, np.zeros(0, np.int64), offsets
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = classes()[codes]
    final = np.zeros(n, bool)
    final[offsets[1:][lengths > 0] - 1] = True
    space = kinds == SPACE
    before = np.zeros(n, bool)  # something other than white space follows in the same text
    before[:-1] = ~space[1:]
    before &= ~final
    reads = kinds.copy()
    reads[space] = 7
    last = space & before
    reads[last] = 6
    reads[last & (codes == 32)] = 5
    quote = np.flatnonzero((codes == 39) & ~final)
    if len(quote):
        one = codes[quote + 1]
        reads[quote[np.isin(one, [ord(c) for c in SHORT])]] = 3
        q = quote[~final[quote + 1]]
        pair = codes[q + 1].astype(np.uint64) << 32 | codes[q + 2]
        reads[q[np.isin(pair, np.array([ord(a) << 32 | ord(b) for a, b in LONG], np.uint64))]] = 4
    reads[offsets[:-1][lengths > 0]] += 8
    return joined, automaton().piece_starts(reads), offsets


class Ranks:
    """Pair merging by the ranks of a tiktoken file, for many pieces at once."""

    HEAP_FROM = 256  # bytes of a piece from which a heap takes over; the result is the same

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.rank.items()}
        get = self.rank.get
        pairs = [(a << 32 | b, r) for t, r in self.rank.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        keys = np.array([k for k, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array([r for _, r in pairs], np.int64)[order]
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.none = np.int64(1) << 30

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], self.none)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as bytes of little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) >= self.HEAP_FROM:
                out[i] = self._heap(p)
            else:
                todo.append(i)
        if todo:
            flat = self.single[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]
            owner = np.repeat(np.arange(len(todo)), [len(pieces[i]) for i in todo])
            done_ids, done_owner = [], []
            while len(flat):
                inner = owner[1:] == owner[:-1]
                made = np.full(len(flat), self.none)
                at = np.flatnonzero(inner)
                made[at] = self._pair(flat[at], flat[at + 1])
                begins = np.flatnonzero(np.concatenate([[True], ~inner]))
                best = np.minimum.reduceat(made << 32 | np.arange(len(flat)), begins)
                live = best >> 32 < self.none
                sizes = np.diff(np.append(begins, len(flat)))
                if not live.all():
                    rest = np.repeat(~live, sizes)
                    done_ids.append(flat[rest])
                    done_owner.append(owner[rest])
                where = best[live] & 0xFFFFFFFF
                keep = np.repeat(live, sizes)
                flat[where] = made[where]
                keep[where + 1] = False
                flat, owner = flat[keep], owner[keep]
            ids, own = np.concatenate(done_ids), np.concatenate(done_owner)
            order = np.argsort(own, kind="stable")
            raw = ids[order].astype("<u4").tobytes()
            ends = np.cumsum(np.bincount(own, minlength=len(todo))) * 4
            at = 0
            for i, e in zip(todo, ends.tolist(), strict=True):
                out[i] = raw[at:e]
                at = e
        return out

    def _heap(self, piece: bytes) -> bytes:
        """The same merges for one long piece in O(n log n)."""
        ids = [self.rank[bytes([b])] for b in piece]
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        token, get = self.token, self.rank.get
        pair = lambda i: get(token[ids[i]] + token[ids[nxt[i]]])
        heap = [(r, i) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or nxt[i] < 0 or pair(i) != r:
                continue
            j = nxt[i]
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (x := pair(i)) is not None:
                    heapq.heappush(heap, (x, i))
            if prv[i] >= 0 and (x := pair(prv[i])) is not None:
                heapq.heappush(heap, (x, prv[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryMerges:
    """Ids of pieces from a ``tokenizers`` file, by the library's own BPE model. A piece alone
    splits into itself, so the ids of a text are those of its pieces in order."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.letters = byte_letters()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        split, letters = self.model.tokenize, self.letters
        sizes_ids = [[x.id for x in split(p.decode("latin-1").translate(letters))] for p in pieces]
        raw = np.fromiter((i for x in sizes_ids for i in x), "<u4").tobytes()
        ends = np.cumsum([4 * len(x) for x in sizes_ids]).tolist() if pieces else []
        return [raw[a:z] for a, z in zip([0, *ends], ends)]


class Encoder:
    """Cached encoding, piece by piece.

    A piece of up to ``SHORT_PIECE`` code points is found by a 64-bit polynomial hash, computed for
    all pieces at once from running sums and looked up in an open-addressed table of arrays, and its
    code points are compared with those kept there; longer ones, and those whose hash belongs to
    another piece, are known by themselves in a dictionary. The cache is emptied beyond ``entries`` pieces,
    which bounds its memory and changes no result.
    """

    SHORT_PIECE, BITS = 32, 21  # workers keep the cache, so it is small
    BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64

    def __init__(self, merger: Ranks | LibraryMerges, entries: int = 600_000) -> None:
        self.merger, self.entries = merger, min(entries, 1 << self.BITS - 1)
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.found = np.full(1 << self.BITS, -1, np.int32)
        self.long: dict[str, int] = {}
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")
        self.points, self.point = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(codes)
        if n > len(self.powers):
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(0x1F3D5B79)) * self.powers[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)  # 0 marks an empty place

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, -1 if there is none."""
        at = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.found[at]
        there = self.keys[at]
        out[there != keys] = -1
        rest = np.flatnonzero((there != keys) & (there != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (1 << self.BITS) - 1
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.found[at[rest[hit]]]
            rest = rest[~hit & (there != 0)]
        return out

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            won = free[self.keys[at[free]] == keys[free]]
            self.found[at[won]] = numbers[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & (1 << self.BITS) - 1

    def _add(self, pieces: list[str]) -> np.ndarray:
        """Merge new pieces and keep their ids; their numbers."""
        made = self.merger.merge([p.encode("utf-8", "surrogatepass") for p in pieces])
        sizes = np.fromiter((len(x) >> 2 for x in made), np.int64, len(made))
        first = len(self.size)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.point = np.concatenate([self.point, len(self.points) + np.cumsum(lengths) - lengths])
        self.points = np.concatenate([self.points, np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)])
        return np.arange(first, first + len(pieces), dtype=np.int32)

    def _other(self, number: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, longer: np.ndarray) -> np.ndarray:
        """Which of the short pieces aren't the ones kept under their numbers: code points compared."""
        out = np.zeros(len(number), bool)
        short = np.flatnonzero(~longer)
        if not len(short):
            return out
        lengths = (ends - starts)[short]
        begin = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum()) - np.repeat(begin, lengths)
        kept = np.minimum(np.repeat(self.point[number[short]], lengths) + within, len(self.points) - 1)
        unlike = codes[np.repeat(starts[short], lengths) + within] != self.points[kept]
        past = np.append(self.point, len(self.points))[number[short] + 1]
        out[short] = (np.add.reduceat(unlike.astype(np.int64), begin) > 0) | (past - self.point[number[short]] != lengths)
        return out

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and the offset of each text in them (one more)."""
        joined, starts, offsets = pieces_of(texts)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        if len(self.size) > self.entries:
            self._empty()
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.append(starts[1:], len(joined))
        keys = self._hashes(codes, starts, ends)
        number = self._look_up(keys)
        longer = ends - starts > self.SHORT_PIECE
        missing = np.flatnonzero((number < 0) & ~longer)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[first]
            made = self._add([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self._insert(new, made)
            number[missing] = made[back]
        by_itself = np.flatnonzero(longer | self._other(number, codes, starts, ends, longer))
        if len(by_itself):
            texts_ = [joined[a:b] for a, b in zip(starts[by_itself].tolist(), ends[by_itself].tolist(), strict=True)]
            if fresh := [p for p in dict.fromkeys(texts_) if p not in self.long]:
                self.long.update(zip(fresh, self._add(fresh).tolist(), strict=True))
            number[by_itself] = [self.long[p] for p in texts_]
        sizes = self.size[number]
        upto = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.begin[number] - upto + sizes, sizes) + np.arange(upto[-1])]
        return flat, np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of little-endian unsigned 32-bit integers."""
        flat, at = self.encode_flat(texts)
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip((at[:-1] * 4).tolist(), (at[1:] * 4).tolist(), strict=True)]


class Decoder:
    """Bytes of ids, by the table of the rank file."""

    def __init__(self, ranks: Ranks) -> None:
        self.table = [ranks.token.get(i, b"") for i in range(max(ranks.token) + 1)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(4)
def rank_encoder(path: str) -> tuple[Encoder, Decoder]:
    ranks = Ranks(path)
    return Encoder(ranks), Decoder(ranks)


class LibraryEncoder(Encoder):
    """What the library's ``encode(text, add_special_tokens=False)`` gives: texts that hold an added
    token of the file go to the library whole, all others go piece by piece."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(LibraryMerges(path))
        self.whole = Tokenizer.from_file(path)
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]

    def encode(self, texts: list[str]) -> list[bytes]:
        special = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if not special:
            return super().encode(texts)
        rest = list(texts)
        for i in special:
            rest[i] = ""
        out = super().encode(rest)
        for i in special:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(4)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def map_ids(docs: DataFrame, vocabulary: str, schema: T.StructType, fn: Callable, columns: list[str], text: str = "text") -> DataFrame:
    """Encode column ``text`` and let ``fn(batch, ids, decoder)`` make the output columns."""

    def run(batches):
        encoder, decoder = rank_encoder(vocabulary)
        for b in batches:
            yield fn(b, encoder.encode(texts_of(b, text)), decoder)

    return map_batches(docs.select(*columns), run, schema, limit=1 << 20, text=text)


def encode_documents(docs: DataFrame, *, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int), in input order. Null texts have an empty array."""
    path = vocabulary or tokenizer_file("byte_bpe_multi_50k.tiktoken")

    def rows(b, ids, _):
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        return [column(b, key), pa.ListArray.from_arrays(ends, flat)]

    kind = docs.schema[key].dataType
    return map_ids(docs, path, T.StructType([field(key, kind), field("ids", "array<int>")]), rows, [key, text], text)


def decode_documents(encoded: DataFrame, *, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """``key``, ``bytes`` (binary) of each row's ``ids``; a null array has null bytes."""
    path = vocabulary or tokenizer_file("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        _, decoder = rank_encoder(path)
        for b in batches:
            yield [column(b, key), pa.array([None if x is None else decoder.decode(x) for x in column(b, "ids").to_pylist()], pa.binary())]

    kind = encoded.schema[key].dataType
    return map_batches(encoded.select(key, "ids"), run, T.StructType([field(key, kind), field("bytes", "binary")]), text=None)


def round_trip(docs: DataFrame, *, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass.

    ``key``, ``n_tokens`` long, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the bytes that the ids decode to), both lower-case hex.
    """
    path = vocabulary or tokenizer_file("byte_bpe_multi_50k.tiktoken")

    def rows(b, ids, decoder):
        lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
        return [
            column(b, key),
            pa.array([len(x) for x in lists], pa.int64()),
            pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in lists]),
            pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in lists]),
        ]

    kind = docs.schema[key].dataType
    schema = T.StructType([field(key, kind), field("n_tokens", "bigint"), field("ids_sha256", "string"), field("decoded_sha256", "string")])
    return map_ids(docs, path, schema, rows, [key, text], text)
