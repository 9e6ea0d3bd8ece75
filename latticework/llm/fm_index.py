"""Benchmark decontamination with an FM-index over each training shard.

A shard is a slice of a task's documents. Its words are numbered by the benchmark's vocabulary;
stretches of known words that are at least as long as the shortest phrase are joined (no phrase can
lie elsewhere), equal stretches once. Suffixes are sorted by prefix doubling, the Burrows-Wheeler
transform goes into a wavelet matrix, and all phrases are searched backward side by side. Their
occurrences are located by walking to sampled suffix positions, and overlapping spans are merged.

Phrases are all runs of ``window`` words of a benchmark item; an item of fewer words (but not none)
is one phrase. A-Z count as a-z; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The benchmark
goes to the tasks in blocks of bounded size, one in memory at a time; there is no shuffle.

Null texts have no words. Rows are judged one by one, so ties, repeated rows and null ids stay. An
empty benchmark leaves all documents clean; null item ids are left out of the lists of items.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, field, map_batches, own_name, texts_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WaveletMatrix:
    """Rank and access on a sequence of numbers below 2**levels."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.ones, self.zeros = levels, [], []
        for k in range(levels - 1, -1, -1):
            bit = values >> k & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        at, base = upto.copy(), np.zeros_like(upto)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = symbols >> self.levels - 1 - k & 1 == 1
            at = np.where(bit, zeros + ones[at], at - ones[at])
            base = np.where(bit, zeros + ones[base], base - ones[base])
        return at - base

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it occurs before."""
        symbol, base = np.zeros_like(at), np.zeros_like(at)
        at = at.copy()
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at] == 1
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
            base = np.where(bit, zeros + ones[base], base - ones[base])
        return symbol, at - base


def suffix_order(values: np.ndarray) -> np.ndarray:
    """The suffix array, by prefix doubling; each round sorts only what is still tied."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    first = np.concatenate([[True], values[order][1:] != values[order][:-1]])
    rank = np.empty(n, np.int64)  # how many suffixes are smaller, as far as known
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    k = 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        tied = order[sizes[rank[order]] > 1]  # in order of rank
        if not len(tied):
            return order
        after = tied + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(rank[tied] * (n + 1) + second)
        tied, second = tied[by], second[by]
        group = rank[tied]
        order[group + _within(group)] = tied
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        place = group + _within(group)
        rank[tied] = np.maximum.accumulate(np.where(new, place, 0))
        k *= 2


def _within(group: np.ndarray) -> np.ndarray:
    """Position of each element within its group of equal, adjacent values."""
    i = np.arange(len(group))
    return i - np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), i, 0))


class FMIndex:
    """Backward search over a text of numbers from 1; 0 ends it."""

    def __init__(self, values: np.ndarray, sample: int = 8) -> None:
        text = np.append(values, 0)
        sa = suffix_order(text)
        bwt = text[sa - 1]
        counts = np.bincount(text)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        self.bwt = WaveletMatrix(bwt, max(1, int(len(counts) - 1).bit_length()))
        marked = (sa % sample == 0) | (sa == len(text) - 1)
        self.rows = np.concatenate([[0], np.cumsum(marked)])
        self.samples, self.n = sa[marked], len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges (from, to) of phrases, one a row, padded on the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        top = len(self.below) - 1
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = live[high[live] > low[live]]
            now = live[lengths[live] > step]
            if not len(now):
                break
            c = phrases[now, lengths[now] - 1 - step]
            known = c < top
            high[now[~known]] = low[now[~known]]
            now, c = now[known], c[known]
            low[now] = self.below[c] + self.bwt.rank(c, low[now])
            high[now] = self.below[c] + self.bwt.rank(c, high[now])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one."""
        out, steps, at = np.full(len(rows), -1), np.zeros(len(rows), np.int64), rows.copy()
        left = np.arange(len(rows))
        while len(left):
            hit = self.rows[at[left] + 1] > self.rows[at[left]]
            done = left[hit]
            out[done] = self.samples[self.rows[at[done]]] + steps[done]
            left = left[~hit]
            c, before = self.bwt.access(at[left])
            at[left] = self.below[c] + before
            steps[left] += 1
        return out


@dataclass
class Phrases:
    """A block of the benchmark: its vocabulary, distinct phrases and the items of each."""

    number: dict[bytes, int]
    phrases: np.ndarray
    lengths: np.ndarray
    items: list[list]

    @classmethod
    def of(cls, rows: list[tuple[object, list[bytes]]], window: int) -> Phrases:
        number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict] = {}
        for item, words in rows:
            ids = [number.setdefault(w, len(number) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i : i + window]), {})[item] = None
        table = np.zeros((len(found), window), np.int64)
        for i, p in enumerate(found):
            table[i, : len(p)] = p
        return cls(number, table, np.fromiter(map(len, found), np.int64, len(found)), [list(x) for x in found.values()])

    def occurrences(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first word, length) of every occurrence; words count over all documents."""
        n = sum(map(len, docs))
        get = self.number.get
        ids = np.fromiter((get(w, 0) for ws in docs for w in ws), np.int64, n)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        new = np.ones(n + 1, bool)  # where a stretch of one document and of known words may begin
        new[1:n] = (ids[1:] == 0) | (ids[:-1] == 0)
        new[np.cumsum(sizes)] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        use = (ends - starts >= (self.lengths.min() if len(self.lengths) else n + 1)) & (starts < n)
        use &= ids[np.minimum(starts, max(n - 1, 0))] > 0 if n else False
        same: dict[bytes, list[int]] = {}
        for a, b in zip(starts[use].tolist(), ends[use].tolist(), strict=True):
            same.setdefault(ids[a:b].tobytes(), []).append(a)
        none = np.zeros(0, np.int64)
        if not same:
            return none, none, none
        runs = [np.frombuffer(k, np.int64) for k in same]
        begin = np.cumsum([0, *[len(r) + 1 for r in runs]])
        index = FMIndex(np.concatenate([np.append(r, len(self.number) + 1) for r in runs]))  # a number of its own ends a stretch
        low, high = index.search(self.phrases, self.lengths)
        hits = np.flatnonzero(high > low)
        many = (high - low)[hits]
        phrase = np.repeat(hits, many)
        at = index.locate(np.repeat(low[hits], many) + _within(phrase))
        run = np.searchsorted(begin, at, "right") - 1
        places = list(same.values())
        copies = np.array([len(p) for p in places])[run]
        where = np.concatenate([np.array(places[r]) for r in run.tolist()]) if len(run) else none
        phrase = np.repeat(phrase, copies)
        return phrase, where + np.repeat(at - begin[run], copies), self.lengths[phrase]


def blocks(benchmark: DataFrame, *, window: int, item: str, text: str, block_words: int) -> Iterator[Phrases]:
    """The benchmark in blocks of about ``block_words`` words."""
    rows, held = [], 0
    for r in benchmark.select(F.col(item).alias("a"), F.col(text).alias("b")).toLocalIterator():
        if words := words_of(r.b):
            rows.append((r.a, words))
            held += len(words)
            if held >= block_words:
                yield Phrases.of(rows, window)
                rows, held = [], 0
    if rows:
        yield Phrases.of(rows, window)


def find(docs: DataFrame, benchmark: DataFrame, *, carry: list[str] | None = None, window: int = 13, text: str = "text", item: str = "item_id", item_text: str = "text", share: int = 20, block_words: int = 2_000_000) -> DataFrame:
    """``carry`` (all columns if None) and a struct ``hits`` (or longer, if that name is taken):
    ``n_words``, ``n_hit``, ``spans`` (merged, first and past word), ``items`` (sorted, as strings)
    and ``contaminated``: a word is hit, and hits times ``share`` are at least all words."""
    carry = docs.columns if carry is None else carry
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(b) for b in blocks(benchmark, window=window, item=item, text=item_text, block_words=block_words)]
    inner = T.StructType([field("n_words", "bigint"), field("n_hit", "bigint"), field("spans", "array<struct<first:bigint,past:bigint>>"), field("items", "array<string>"), field("contaminated", "boolean")])
    schema = T.StructType([*[docs.schema[c] for c in carry], field(own_name(docs, "hits"), inner)])
    own = own_name(docs, "_text")

    def run(batches):
        for b in batches:
            split = [words_of(t) for t in texts_of(b, own)]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            ends = np.cumsum(sizes)
            delta = np.zeros(int(ends[-1]) + 1, np.int64)
            items: list[dict] = [{} for _ in split]
            for block in sent:
                phrases = block.value
                phrase, first, length = phrases.occurrences(split)
                if len(sent) > 1 and hasattr(block, "_value"):
                    del block._value  # one block in memory at a time
                np.add.at(delta, first, 1)
                np.add.at(delta, first + length, -1)
                for p, d in set(zip(phrase.tolist(), np.searchsorted(ends, first, "right").tolist(), strict=True)):
                    items[d].update((str(x), None) for x in phrases.items[p] if x is not None)
            hit = np.cumsum(delta)[:-1] > 0
            out = []
            for n, end, found in zip(sizes.tolist(), ends.tolist(), items, strict=True):
                mine = hit[end - n : end]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                n_hit = int(mine.sum())
                out.append({"n_words": n, "n_hit": n_hit, "spans": [{"first": a, "past": z} for a, z in edge.reshape(-1, 2).tolist()], "items": sorted(found), "contaminated": n_hit > 0 and share * n_hit >= n})
            yield [*[b.column(i) for i in range(len(carry))], pa.array(out, pa.struct([pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("spans", pa.list_(pa.struct([pa.field("first", pa.int64()), pa.field("past", pa.int64())]))), pa.field("items", pa.list_(pa.string())), pa.field("contaminated", pa.bool_())]))]

    return map_batches(docs.select(*carry, F.col(text).alias(own)), run, schema, text=own)


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.translate(_LOWER))]
    out, last = [], 0
    for first, past in spans:
        out.append(raw[last : at[first][0]])
        last = at[past - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def remove_spans(found: DataFrame, *, text: str = "text", hits: str = "hits") -> DataFrame:
    """The rows of ``find`` with the benchmark's passages cut out of the text."""
    schema = T.StructType([f for f in found.schema if f.name != hits])

    def run(batches):
        for b in batches:
            spans = [[(s["first"], s["past"]) for s in h["spans"]] for h in column(b, hits).to_pylist()]
            new = pa.array([cut_spans(t, s) for t, s in zip(column(b, text).to_pylist(), spans, strict=True)], pa.string())
            yield [new if f.name == text else column(b, f.name) for f in schema]

    return map_batches(found, run, schema, text=text)


def digests(found: DataFrame, key: str = "doc_id", hits: str = "hits") -> DataFrame:
    h = F.col(hits)
    return found.select(key, h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(h["items"], ",").cast("binary"), 256).alias("items_sha256"), h["contaminated"].alias("contaminated"))


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
