"""Language identification by a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features, hashed into a table of weights for
each language; transitions between the languages of neighbouring words are learned with them.
Forward-backward gives each word's posterior, and a document's language is the one with the largest
mean posterior over its words, weighted by their letters. So code-switched text is labelled word by
word, and the document by what most of it is written in.

Training takes at most ``per_language`` different labelled documents of each language, those with the
smallest hash of id and text, of at most ``most_languages`` languages, those with the most rows; they
are read whole. Their words carry the document's label, and stretches of documents of different
languages are spliced so that transitions are seen. Everything else covers all rows.

A text is one chain, however long. Chains of a batch go side by side, and long ones in stretches
whose transfer matrices tell each stretch what lies before and behind it.

Words are runs of letters (Unicode categories L), lower-cased; other signs part them. A text that is null or has
no letters is ``und`` with score 0. Rows are judged one by one, so ties, repeated rows and null ids
stay; without any labelled row every document is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_batches, own_name, texts_of

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    # numbers that aren't digits (as \u00bd) are word signs to the pattern, but no letters
    return [w for x in words for w in "".join([c if c.isalpha() else " " for c in x]).split()]


BUCKETS = 1 << 16
UNKNOWN = "und"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table rows, word numbers) of all features of all words: the word itself (the lexicon), its
    prefixes and suffixes of 1 to 4 letters, and n-grams of 1 to 3 signs of the marked word."""
    c = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(c)) - begins[owner]
    rows, of = [], []

    def add(h: np.ndarray, whose: np.ndarray, salt: int) -> None:
        rows.append((_mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(48)).astype(np.int64) % BUCKETS)
        of.append(whose)

    h = np.zeros(len(c), np.uint64)
    for n in (1, 2, 3):
        shifted = np.zeros(len(c), np.uint64)
        shifted[: len(c) - n + 1] = c[n - 1 :]
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + shifted)
        whole = place + n <= sizes[owner]
        add(h[whole], owner[whole], n)
    for sign, origin, salt in ((1, begins, 11), (-1, ends - 1, 22)):
        h = np.zeros(len(words), np.uint64)
        for n in range(1, 5):
            whole = np.flatnonzero(sizes - 2 >= n)
            h[whole] = _mix(h[whole] * np.uint64(0xD6E8FEB86659FD93) + c[origin[whole] + sign * n])
            add(h[whole], whole, salt + n)
    if len(words):
        add(np.add.reduceat(_mix(c * np.uint64(0xD6E8FEB86659FD93) + place.astype(np.uint64)), begins), np.arange(len(words)), 33)
    return np.concatenate(rows), np.concatenate(of)


def emissions(weights: np.ndarray, rows: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of words by language, and what each word's features are scaled by."""
    scale = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))
    return np.stack([np.bincount(of, weights=weights[rows, k], minlength=n) for k in range(weights.shape[1])], 1) * scale[:, None], scale


class Scores:
    """Emission scores of words, each computed once; emptied beyond ``entries`` words."""

    def __init__(self, weights: np.ndarray, entries: int = 200_000) -> None:
        self.weights, self.entries = weights, entries
        self.number: dict[str, int] = {}
        self.table = np.zeros((1024, weights.shape[1]), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.number) > self.entries:
            self.number.clear()
        number = self.number
        ids = list(map(number.get, words))
        if None in ids:
            new = list(dict.fromkeys([w for w, i in zip(words, ids, strict=True) if i is None]))
            first = len(number)
            number.update(zip(new, range(first, first + len(new))))
            while len(self.table) < len(number):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = emissions(self.weights, *features(new), len(new))[0]
            ids = list(map(number.__getitem__, words))
        return self.table[np.array(ids, np.int64)]


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, *, count: bool = False, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words of all sequences (one after the other in ``emit``), and if asked for
    the expected transitions. Sequences go side by side, longest first, so that step t needs a prefix
    of them. ``before`` and ``behind`` weigh each sequence's first and last label by what is around it."""
    n, k = emit.shape
    e = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float64)
    m = np.exp(trans - trans.max())
    by = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[by]
    sizes = lengths[by]
    steps = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(steps), "left")  # sequences longer than t
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    a = None
    for t in range(steps):
        at = begin[: live[t]] + t
        a = (e[at] if before is None else e[at] * before[by]) if t == 0 else (a[: live[t]] @ m) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    pairs = np.zeros((k, k))
    b = np.zeros((0, k))
    for t in range(steps - 1, -1, -1):
        more = live[t + 1] if t + 1 < steps else 0
        new = np.full((live[t], k), 1.0 / k) if behind is None else behind[by[: live[t]]]
        if more:
            right = b[:more] * e[begin[:more] + t + 1]
            new[:more] = right @ m.T
            if count:
                joint = alpha[begin[:more] + t][:, :, None] * m * right[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        new /= new.sum(1, keepdims=True)
        beta[begin[: live[t]] + t] = new
        b = new
    post = alpha * beta
    return post / post.sum(1, keepdims=True), pairs


STRETCH = 256


def stretches(lengths: np.ndarray) -> np.ndarray:
    """Lengths of the stretches of ``STRETCH`` words, the last one of a text shorter."""
    n = -(-lengths // STRETCH)
    out = np.full(int(n.sum()), STRETCH, np.int64)
    some = lengths > 0
    out[np.cumsum(n)[some] - 1] = lengths[some] - (n[some] - 1) * STRETCH
    return out


def posteriors(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """What ``forward_backward`` gives for whole texts, in few steps however long a text is: each
    stretch's transfer matrix carries the forward weights on to the next and the backward weights
    to the one before, then all stretches go side by side."""
    k, n, cut = emit.shape[1], -(-lengths // STRETCH), stretches(lengths)
    before, behind = np.ones((len(cut), k)), np.full((len(cut), k), 1.0 / k)
    many = np.flatnonzero(n > 1)
    if len(many):
        e, m = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float64), np.exp(trans - trans.max())
        top, begin = np.cumsum(n) - n, np.cumsum(cut) - cut
        need = np.concatenate([np.arange(top[i], top[i] + n[i]) for i in many])
        need = need[np.argsort(-cut[need], kind="stable")]
        at = np.zeros(len(cut), np.int64)
        at[need] = np.arange(len(need))
        x = np.repeat(np.eye(k)[None], len(need), 0)
        first = np.isin(need, top[many])
        for t in range(int(cut[need[0]])):
            here = int(np.searchsorted(-cut[need], -t, "left"))  # stretches with a word t
            step = x[:here] @ m
            if t == 0:
                step[first[:here]] = np.eye(k)  # no transition leads to a text's first word
            step *= e[begin[need[:here]] + t][:, None, :]
            x[:here] = step / step.sum((1, 2), keepdims=True)
        ahead, back = np.ones((len(n), k)), np.full((len(n), k), 1.0 / k)
        for j in range(int(n.max()) - 1):
            live = many[n[many] > j + 1]
            v = (ahead[live][:, None, :] @ x[at[top[live] + j]])[:, 0]
            ahead[live] = v / v.sum(1, keepdims=True)
            before[top[live] + j + 1] = ahead[live] @ m
        for j in range(int(n.max()) - 1, 0, -1):
            live = many[n[many] > j]
            v = (x[at[top[live] + j]] @ back[live][:, :, None])[:, :, 0]
            back[live] = behind[top[live] + j - 1] = v / v.sum(1, keepdims=True)
    return forward_backward(emit, cut, trans, before=before, behind=behind)[0]


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray) -> None:
        self.langs, self.trans = langs, trans
        self.scores = Scores(weights)

    def posteriors(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        words = [words_of(t) for t in texts]
        flat = [w for ws in words for w in ws]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not flat:
            return words, np.zeros((0, len(self.langs)))
        return words, posteriors(self.scores.of(flat), lengths, self.trans)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        words, post = self.posteriors(texts)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.fromiter((len(w) for ws in words for w in ws), np.float64, int(lengths.sum()))
        upto = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post * letters[:, None], 0)])
        ends = np.cumsum(lengths)
        mass = upto[ends] - upto[ends - lengths]
        out = []
        for n, x in zip(lengths.tolist(), mass, strict=True):
            i = int(x.argmax()) if n else 0
            out.append((self.langs[i], float(min(1.0, max(0.0, x[i] / x.sum())))) if n else (UNKNOWN, 0.0))
        return out


def sequences(rows: list[tuple[str, str]], langs: list[str], seed: int, stretch: int = 40) -> Iterator[tuple[list[str], list[int]]]:
    """Labelled word sequences: stretches of documents, every fourth spliced with one of another
    document."""
    rng = np.random.default_rng(seed)
    parts = []
    for text, lang in rows:
        words = words_of(text)
        parts += [(words[i : i + stretch], langs.index(lang)) for i in range(0, len(words), stretch)]
    order = rng.permutation(len(parts)).tolist()
    for k, i in enumerate(order):
        words, y = parts[i]
        labels = [y] * len(words)
        if k % 4 == 0:
            other, z = parts[order[(k + 1) % len(order)]]
            words, labels = words + other, labels + [z] * len(other)
        yield words, labels


def train(rows: list[tuple[str, str]], *, epochs: int = 2, batch: int = 256, rate: float = 0.5, seed: int = 1) -> Model | None:
    """Maximum likelihood by AdaGrad over batches of sequences."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    k = len(langs)
    weights, trans = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    seen_w, seen_t = np.full((BUCKETS, k), 1e-2, np.float32), np.full((k, k), 1e-2)
    for epoch in range(epochs):
        items = [s for s in sequences(rows, langs, seed + epoch) if s[0]]
        for at in range(0, len(items), batch):
            chosen = items[at : at + batch]
            words = [w for ws, _ in chosen for w in ws]
            y = np.fromiter((i for _, ys in chosen for i in ys), np.int64, len(words))
            distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
            flat, of = features(list(distinct))
            table, scale = emissions(weights, flat, of, len(distinct))
            ids = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
            lengths = np.fromiter((len(ws) for ws, _ in chosen), np.int64, len(chosen))
            post, pairs = forward_backward(table[ids], lengths, trans, count=True)
            post[np.arange(len(y)), y] -= 1  # now the gradient of the negative log likelihood
            by_word = np.stack([np.bincount(ids, weights=post[:, c], minlength=len(distinct)) for c in range(k)], 1)
            spread = (by_word * scale[:, None] / len(chosen))[of]
            grad = np.stack([np.bincount(flat, weights=spread[:, c], minlength=BUCKETS) for c in range(k)], 1)
            seen_w += grad**2
            weights -= (rate * grad / np.sqrt(seen_w)).astype(np.float32)
            inner = np.ones(len(y), bool)
            inner[np.cumsum(lengths) - lengths] = False
            at_ = np.flatnonzero(inner)
            real = np.zeros((k, k))
            np.add.at(real, (y[at_ - 1], y[at_]), 1)
            grad = (pairs - real) / len(chosen)
            seen_t += grad**2
            trans -= rate * grad / np.sqrt(seen_t)
    return Model(langs, weights, trans)


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 200, most_languages: int = 256) -> Model | None:
    """Train on at most ``per_language`` different rows of each language, whole texts, smallest hash
    first, of at most ``most_languages`` languages, those with the most rows. No more than that many
    rows come to the driver, whatever ids are null or repeated."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key).cast("string"), F.col(lang), F.col(text)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    # hashes are even, so a threshold from the counts lets through about twice what is wanted
    share = {r.lang: min(1.0, 2 * (per_language + 50) / max(1, r.different)) for r in counts}
    taken: list[tuple[str, str]] = []
    while share:
        limits = [(F.col("lang") == lang) & (F.col("h") <= F.lit(min(int(x * (1 << 64)) - (1 << 63), (1 << 63) - 1))) for lang, x in share.items()]
        # equal rows become one in each task before they meet
        few = rows.filter(reduce(Column.__or__, limits)).groupBy("lang", "h").agg(F.first("text").alias("text"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        found: dict[str, list] = {lang: [] for lang in share}
        for r in few.withColumn("at", place).filter(F.col("at") <= per_language).toLocalIterator():
            found[r.lang].append((r.h, r.text))
        for lang, got in found.items():
            if len(got) >= per_language or share[lang] >= 1:
                taken += [(text, lang) for _, text in sorted(got)]
                del share[lang]
            else:
                share[lang] = min(1.0, 4 * share[lang])
    return train(taken)


def identify(docs: DataFrame, model: Model | None, *, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """``carry`` (all columns if None) and a struct ``language`` (or longer, if that name is taken)
    of ``lang`` and ``score``."""
    carry = docs.columns if carry is None else carry
    inner = T.StructType([field("lang", "string"), field("score", "double")])
    schema = T.StructType([*[docs.schema[c] for c in carry], field(own_name(docs, "language"), inner)])
    own = own_name(docs, "_text")
    # the table of weights has a fixed number of rows
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores.weights, model.trans) if model else None)

    def run(batches):
        m = Model(*sent.value) if sent.value else None
        for b in batches:
            texts = texts_of(b, own)
            got = m.predict(texts) if m else [(UNKNOWN, 0.0)] * len(texts)
            yield [*[b.column(i) for i in range(len(carry))], pa.array([{"lang": a, "score": s} for a, s in got], pa.struct([("lang", pa.string()), ("score", pa.float64())]))]

    return map_batches(docs.select(*carry, F.col(text).alias(own)), run, schema, limit=1 << 20, text=own)


def word_labels(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``words``: each word in order with its most likely language and posterior."""
    kind = T._parse_datatype_string("array<struct<word:string,lang:string,score:double>>")
    schema = T.StructType([docs.schema[key], field("words", kind)])
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.scores.weights, model.trans))

    def run(batches):
        m = Model(*sent.value)
        for b in batches:
            words, post = m.posteriors(texts_of(b, text))
            best, at, out = post.argmax(1), 0, []
            for ws in words:
                out.append([{"word": w, "lang": m.langs[best[at + i]], "score": float(post[at + i, best[at + i]])} for i, w in enumerate(ws)])
                at += len(ws)
            yield [b.column(0), pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])))]

    return map_batches(docs.select(key, text), run, schema, text=text)


def held_out(key: str = "doc_id"):
    """The documents that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
