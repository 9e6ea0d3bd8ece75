"""Quality rules by n-gram perplexity under modified Kneser-Ney models, one for each language.

The n-grams are of five code points as they stand, and all of them are kept: Spark counts them over
the whole texts of all documents, and the model is a table of sorted 64-bit hashes in the shared
folder, partitioned by hash range, that grows with the corpus. Texts are split in halves by a hash,
and each is scored under the model of the other half, so that no text (nor an exact copy) speaks for
itself.

Texts are read where they lie, once to count and once to score, and never dealt out. The ``hot``
most frequent n-grams go to the tasks as sorted hash arrays, whose size that parameter bounds; what
a text has beyond them is sent, once a piece, to a sorted join with the whole model. Where the line
between the two lies changes no figure.

A document's figures are the log perplexity of its whole text and that of its upper-decile piece of
about 128 symbols. It is rejected when the first lies beyond the quartiles of its language (over all
documents that pass the base rules) by more than ``above`` or ``below`` interquartile ranges, or the
second beyond its own upper quartile by more than ``above_piece``; for texts shorter than
the language's median the bands widen with the root of the ratio, as such figures scatter more.

Words are ``[^\\x20\\x09-\\x0D]+``. Null texts have no words, and documents under ``min_words`` fail
the base rules. A null language is a language of its own. Rows are scored one by one, so ties,
repeated rows and repeated or null ids stay; an empty table gives an empty result. Columns of the
input may have any names: own ones are lengthened until they are free.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, field, map_batches, materialise, own_name, texts_of

WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
NO_LANG = "\ufdd0"  # a code point that no language value uses
REACH = 5
START = 2  # a control sign before the text
HOT = 1 << 19
PIECE = 128
HELD = 1 << 20  # distinct n-grams that a task holds before it sends their counts
BLOCK = 1 << 20  # symbols hashed at a time, within a text too
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each text's values; also of texts without any."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


WINDOW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def base_counts(texts: list[str], codes: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures of each text."""
    white = np.zeros(256, np.int64)
    white[[ord(c) for c in WHITE]] = 1
    sign = np.zeros(256, np.int64)
    sign[[ord(c) for c in SYMBOLS]] = 1
    low = np.where(codes < 256, codes, 255)
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # at ASCII white space only
    n_words = np.fromiter(map(len, split), np.int64, len(texts))
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((number[w] for ws in split for w in ws), np.uint64, int(n_words.sum()))
    return {
        "n_words": n_words,
        "word_chars": lengths - sums(white[low], lengths),
        "n_symbols": sums(sign[low], lengths),
        "n_dup_lines": np.array([repeated_lines(t) if "\n" in t else 0 for t in texts], np.int64),
        "n_repeat_words": repeated_words(ids, n_words),
    }


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def repeated_words(ids: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Words of each text in windows of eight that occur at least twice in it."""
    n = len(ids)
    ends = np.repeat(np.cumsum(n_words), n_words)
    h = (ids + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(32)
    span = 1
    while span < WINDOW:  # hashes of 2, 4 and 8 words
        later = np.zeros(n, np.uint64)
        later[: max(n - span, 0)] = h[span:]
        h = (h * np.uint64(0xD6E8FEB86659FD93) + later) * _MIX
        h ^= h >> np.uint64(29)
        span *= 2
    at = np.flatnonzero(np.arange(n) + WINDOW <= ends)
    key = h[at] + np.repeat(np.arange(len(n_words)), n_words)[at].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, at[twice], 1)
    np.add.at(delta, at[twice] + WINDOW, -1)
    return sums((np.cumsum(delta)[:n] > 0).astype(np.int64), n_words)


def padded_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' code points with signs for the start before each, the place of each symbol there,
    and the number of each text's symbols. NUL counts as U+FFFD."""
    codes, lengths = code_points(texts)
    at = np.arange(len(codes)) + (REACH - 1) * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    padded = np.full(len(codes) + (REACH - 1) * len(lengths), START, np.uint32)
    padded[at] = np.where(codes == 0, 0xFFFD, codes)
    return padded, at, lengths


def hashes(padded: np.ndarray, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hash of the five code points that end at each place, and of the language's ``salt``."""
    h = salt.copy()
    for k in range(REACH - 1, -1, -1):
        h = (h + padded[at - k] + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def salts(langs: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, where each occurs first, and each value's number."""
    coded = pa.array(h).dictionary_encode()
    number = coded.indices.to_numpy()
    top = np.maximum.accumulate(number) if len(number) else number
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(number)), bool), top[1:] != top[:-1]]))
    return coded.dictionary.to_numpy(zero_copy_only=False), first, number


def blocks(padded: np.ndarray, at: np.ndarray, owner: np.ndarray, salt: np.ndarray):
    """(text of each symbol, distinct hashes, symbol where each occurs first, each symbol's hash) of
    stretches of ``BLOCK`` symbols."""
    for lo in range(0, len(at), BLOCK):
        mine, of = at[lo : lo + BLOCK], owner[lo : lo + BLOCK]
        h, first, number = distinct(hashes(padded, mine, salt[of]))
        yield of, h, lo + first, number


def sources(docs: DataFrame, carry: list[str], text: str, lang: str) -> tuple[DataFrame, list[str]]:
    """``carry``, and the names of the text, the language and the half (by a hash of the text)."""
    own = [own_name(docs, "_text"), own_name(docs, "_lang"), own_name(docs, "_half")]
    return docs.select(*carry, F.col(text).alias(own[0]), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias(own[1]), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias(own[2])), own


def count_windows(rows: DataFrame, own: list[str]) -> DataFrame:
    """``lang, gram, m0, m1``: five code points and how often each half's model sees them (that is,
    the texts of the other half). Whole texts of all documents; a task sums what it can hold."""
    text, lang, half = own

    def summed(parts: list[tuple]) -> tuple:
        keys, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        wide, langs = (np.concatenate([p[i] for p in parts])[first] for i in (1, 2))
        m = [np.bincount(back, weights=np.concatenate([p[i] for p in parts]), minlength=len(keys)).astype(np.int64) for i in (3, 4)]
        return keys, wide, langs, *m

    def run(batches):
        number: defaultdict[str, int] = defaultdict(count().__next__)
        parts: list[tuple] = []

        def flushed():
            if parts:
                _, wide, langs, m0, m1 = summed(parts)
                names = pa.array(list(number), pa.string())
                for lo in range(0, len(wide), 1 << 17):
                    cut = slice(lo, lo + (1 << 17))
                    grams = np.ascontiguousarray(wide[cut]).view(f"<U{REACH}").reshape(-1).tolist()
                    yield [names.take(pa.array(langs[cut])), pa.array(grams, pa.string()), pa.array(m0[cut]), pa.array(m1[cut])]
            parts.clear()

        for b in batches:
            names, halves = column(b, lang).to_pylist(), column(b, half).to_numpy()
            padded, at, lengths = padded_texts(texts_of(b, text))
            langs, owner = np.array([number[x] for x in names], np.int64), np.repeat(np.arange(len(lengths)), lengths)
            for of, h, first, ids in blocks(padded, at, owner, salts(names)):
                wide = np.stack([padded[at[first] - k] for k in range(REACH - 1, -1, -1)], 1)
                all_ = np.bincount(ids, minlength=len(h))
                second = np.bincount(ids[halves[of] == 1], minlength=len(h))
                parts.append((h, wide, langs[owner[first]], second, all_ - second))
                if sum(len(p[0]) for p in parts) > 2 * HELD:
                    parts[:] = [summed(parts)]
                    if len(parts[0][0]) > HELD:
                        yield from flushed()
        yield from flushed()

    schema = T.StructType([field("lang", "string"), field("gram", "string"), field("m0", "bigint"), field("m1", "bigint")])
    parts = map_batches(rows.select(*own), run, schema, limit=1 << 20, text=text)
    return materialise(parts.groupBy("lang", "gram").agg(F.sum("m0").alias("m0"), F.sum("m1").alias("m1")), "counts")


def window_logs(counts: DataFrame) -> DataFrame:
    """``lang, gram, n, p0, p1``: the probability of each gram's last code point under the modified
    Kneser-Ney model of each half. All of it is joins on n-grams, sorted at every size, so the model
    grows with the corpus and nothing of it is collected; one row a language is broadcast."""
    table = {REACH: counts}
    for k in range(REACH - 1, 0, -1):  # lower orders count the distinct code points that come before
        more = [F.sum((F.col(f"m{j}") > 0).cast("bigint")).alias(f"m{j}") for j in (0, 1)]
        table[k] = materialise(table[k + 1].groupBy("lang", F.substring("gram", 2, REACH).alias("gram")).agg(*more), "order")
    lower = table[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p0")).select("lang", F.lit("").alias("suffix"), "p0", F.col("p0").alias("p1"))
    for k in range(1, REACH + 1):
        of_counts = table[k].groupBy("lang").agg(*[F.sum((F.col(f"m{j}") == c).cast("double")).alias(f"c{j}{c}") for j in (0, 1) for c in (1, 2, 3, 4)])
        cuts = []
        for j in (0, 1):
            c = [None, *[F.col(f"c{j}{i}") for i in (1, 2, 3, 4)]]
            usual = (c[1] > 0) & (c[2] > 0) & (c[3] > 0)
            y = F.try_divide(c[1], c[1] + 2 * c[2])
            for i in (1, 2, 3):
                d = i - (i + 1) * y * F.try_divide(c[i + 1], c[i])
                cuts.append(F.when(usual, F.least(F.greatest(d, F.lit(0.01)), F.lit(i - 0.01))).otherwise(F.lit(i / 2)).alias(f"d{j}{i}"))
        rows = table[k].join(F.broadcast(of_counts.select("lang", *cuts)), "lang")
        for j in (0, 1):
            m = F.col(f"m{j}")
            rows = rows.withColumn(f"cut{j}", F.when(m == 0, 0.0).when(m == 1, F.col(f"d{j}1")).when(m == 2, F.col(f"d{j}2")).otherwise(F.col(f"d{j}3")))
        rows = rows.select("lang", "gram", F.expr(f"substring(gram, 1, {k - 1})").alias("context"), F.substring("gram", 2, REACH).alias("suffix"), "m0", "m1", "cut0", "cut1")
        sums_ = rows.groupBy("lang", "context").agg(*[F.sum(f"{x}{j}").alias(f"{y}{j}") for j in (0, 1) for x, y in (("m", "all"), ("cut", "back"))])
        joined = rows.join(sums_.hint("merge"), ["lang", "context"]).join(lower.hint("merge"), ["lang", "suffix"])
        made = [F.when(F.col(f"all{j}") > 0, F.try_divide(F.col(f"m{j}") - F.col(f"cut{j}") + F.col(f"back{j}") * F.col(f"p{j}"), F.col(f"all{j}"))).otherwise(F.col(f"p{j}")).alias(f"p{j}") for j in (0, 1)]
        lower = joined.select("lang", F.col("gram").alias("suffix"), *([(F.col("m0") + F.col("m1")).alias("n")] if k == REACH else []), *made)
        if k < REACH:
            lower = materialise(lower, "lower")
    return lower.withColumnRenamed("suffix", "gram")


def sorted_hashes(logs: DataFrame) -> DataFrame:
    """The model as it is stored: ``key`` (hash of language and n-gram), ``n`` and the log
    probabilities ``l0`` and ``l1``, partitioned by ranges of the hash and sorted in each."""

    def run(batches):
        for b in batches:
            padded = np.frombuffer("".join(column(b, "gram").to_pylist()).encode("utf-32-le"), np.uint32)
            h = hashes(padded, np.arange(REACH - 1, len(padded), REACH), salts(column(b, "lang").to_pylist()))
            yield [pa.array(h.view(np.int64)), column(b, "n"), *[pa.array(np.log(column(b, f"p{j}").to_numpy()).astype(np.float32)) for j in (0, 1)]]

    schema = T.StructType([field("key", "bigint"), field("n", "bigint"), field("l0", "float"), field("l1", "float")])
    return materialise(map_batches(logs, run, schema, text=None).repartitionByRange("key").sortWithinPartitions("key"), "model")


def most_frequent(model: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log probabilities of at most ``hot`` n-grams: whole steps of frequency (an
    eighth of a doubling) from the top, as many as fit."""
    step = F.floor(8 * F.log2("n")).cast("int")
    least, room = None, hot
    for r in sorted(model.groupBy(step.alias("step")).count().collect(), reverse=True):  # 8 * 63 steps at most
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros((2, 0), np.float32)
    table = model.filter(step >= least).select("key", "l0", "l1").toArrow()
    keys = table["key"].to_numpy()
    by = np.argsort(keys)
    return keys[by], np.stack([table[f"l{j}"].to_numpy()[by] for j in (0, 1)])


def pieces_of(lengths: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many near-equal pieces of about ``piece`` symbols each text has, and each symbol's piece,
    counted over all texts."""
    n = np.where(lengths > 0, np.maximum(1, lengths // piece), 0)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return n, np.repeat(np.cumsum(n) - n, lengths) + place * np.repeat(n, lengths) // np.repeat(lengths, lengths)


def figures(logs: np.ndarray, sizes: np.ndarray, n_pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative log probability a symbol of each whole text, and of its upper-decile piece, so that
    a corrupt tenth shows, from the sums and sizes of all pieces; 0 without symbols."""
    mean = -logs / np.maximum(sizes, 1)
    by = np.lexsort((mean, np.repeat(np.arange(len(n_pieces)), n_pieces)))
    worst = np.zeros(len(n_pieces))
    some = n_pieces > 0
    worst[some] = mean[by[(np.cumsum(n_pieces) - n_pieces + n_pieces * 9 // 10)[some]]]
    return -sums(logs, n_pieces) / np.maximum(sums(sizes, n_pieces), 1), worst


def listed(values: pa.Array, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)


def score(rows: DataFrame, own: list[str], carry: list[str], hot: tuple[np.ndarray, np.ndarray], *, min_words: int, max_repeat_percent: int, piece: int) -> tuple[DataFrame, str]:
    """``carry`` and a struct: uid, half, the base figures, and by piece the size and the sum of log
    probabilities of the ``hot`` n-grams; ``cold`` counts the others. Written down, so uids stay."""
    cold = T._parse_datatype_string("array<struct<piece:int,key:bigint,n:bigint>>")
    inner = T.StructType([field("uid", "bigint"), field("half", "int"), *[field(c, "bigint") for c in COUNTS], field("base_failed", "boolean"), field("lang", "string"), field("n_symbols_scored", "bigint"), field("sizes", "array<int>"), field("logs", "array<double>"), field("cold", cold)])
    name, uid = own_name(rows, "_s"), own_name(rows, "_uid")
    schema = T.StructType([*[rows.schema[c] for c in carry], field(name, inner)])
    sent = rows.sparkSession.sparkContext.broadcast(hot)  # at most as many rows as the parameter says

    def run(batches):
        keys, values = sent.value
        for b in batches:
            texts, names, halves = texts_of(b, own[0]), column(b, own[1]).to_pylist(), column(b, own[2]).to_numpy()
            got = base_counts(texts, *code_points(texts))
            padded, at, lengths = padded_texts(texts)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            n_pieces, piece_of = pieces_of(lengths, piece)
            logs, far, lo = np.zeros(int(n_pieces.sum())), [], 0
            for of, h, _, ids in blocks(padded, at, owner, salts(names)):
                h = h.view(np.int64)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1) if len(keys) else np.zeros(len(h), np.int64)
                there = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                table = np.where(there, values[:, place], 0) if len(keys) else np.zeros((2, len(h)), np.float32)
                mine = piece_of[lo : lo + len(of)]
                logs += np.bincount(mine, weights=table[halves[of], ids], minlength=len(logs))
                lost = ~there[ids]
                far.append((mine[lost], h[ids[lost]]))
                lo += len(of)
            failed = (got["n_words"] < min_words) | (100 * got["n_repeat_words"] > max_repeat_percent * got["n_words"])
            where, key = (np.concatenate([x[i] for x in far] or [np.zeros(0, np.int64)]) for i in (0, 1))
            by = np.lexsort((key, where))
            where, key = where[by], key[by]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), (where[1:] != where[:-1]) | (key[1:] != key[:-1])]))
            n, where, key = np.diff(np.append(new, len(key))), where[new], key[new]
            text_of = np.repeat(np.arange(len(lengths)), n_pieces)
            begins = np.cumsum(n_pieces) - n_pieces
            far_ = pa.StructArray.from_arrays([pa.array((where - begins[text_of[where]]).astype(np.int32)), pa.array(key), pa.array(n.astype(np.int64))], ["piece", "key", "n"])
            cols = [column(b, uid), pa.array(halves), *[pa.array(got[c]) for c in COUNTS], pa.array(failed), pa.array(names, pa.string()), pa.array(lengths)]
            cols += [listed(pa.array(np.bincount(piece_of, minlength=len(logs)).astype(np.int32)), n_pieces), listed(pa.array(logs), n_pieces), listed(far_, np.bincount(text_of[where], minlength=len(lengths)))]
            yield [*[b.column(i) for i in range(len(carry))], pa.StructArray.from_arrays(cols, [f.name for f in inner])]

    return materialise(map_batches(rows.withColumn(uid, F.monotonically_increasing_id()), run, schema, limit=1 << 20, text=own[0]), "scored"), name


def perplexities(scored: DataFrame, name: str, model: DataFrame, piece: int) -> DataFrame:
    """``uid`` and the struct ``rules`` of each row: its base figures, ``log_ppl`` and
    ``log_ppl_piece``. What was not in the hot arrays is looked up in a sorted join."""
    s = F.col(name)
    far = scored.select(s["uid"].alias("uid"), s["half"].alias("half"), F.explode(s["cold"]).alias("c")).select("uid", "half", F.col("c.piece").alias("piece"), F.col("c.key").alias("key"), F.col("c.n").alias("m"))
    found = far.join(model.select(F.col("key").alias("k"), "l0", "l1").hint("merge"), F.col("key") == F.col("k"))
    more = found.groupBy("uid", "piece").agg(F.sum(F.col("m") * F.when(F.col("half") == 0, F.col("l0")).otherwise(F.col("l1")).cast("double")).alias("l"))
    more = more.groupBy(F.col("uid").alias("of")).agg(F.collect_list(F.struct("piece", "l")).alias("more"))  # one of a document's own pieces each
    slim = scored.select(s.alias("s"), (F.size(s["cold"]) > 0).alias("any")).select("any", F.col("s").dropFields("cold").alias("s"))
    joined = slim.filter("any").join(more.hint("merge"), F.col("s.uid") == F.col("of"), "left").select("s", "more")
    every = joined.unionByName(slim.filter("NOT any").select("s", F.lit(None).cast(joined.schema["more"].dataType).alias("more")))
    inner = T.StructType([*[field(c, "bigint") for c in COUNTS], field("base_failed", "boolean"), field("lang", "string"), field("n_symbols_scored", "bigint"), field("log_ppl", "double"), field("log_ppl_piece", "double")])

    def run(batches):
        for b in batches:
            s, more = column(b, "s"), column(b, "more")
            sizes, logs = (s.field(x) for x in ("sizes", "logs"))
            n = np.diff(sizes.offsets.to_numpy())
            total = np.array(logs.flatten().to_numpy(zero_copy_only=False))
            m = np.diff(more.offsets.to_numpy())
            m[np.array(more.is_null())] = 0
            flat = more.flatten()
            np.add.at(total, np.repeat(np.cumsum(n) - n, m) + flat.field("piece").to_numpy(zero_copy_only=False), flat.field("l").to_numpy(zero_copy_only=False))
            got = figures(total, sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            yield [s.field("uid"), pa.StructArray.from_arrays([*[s.field(f.name) for f in inner.fields[:-2]], *map(pa.array, got)], [f.name for f in inner])]

    schema = T.StructType([field("uid", "bigint"), field("rules", inner)])
    return materialise(map_batches(every, run, schema, text=None), "figures")


def judge(measured: DataFrame, *, rules: str = "rules", above: float = 2.5, below: float = 6.0, above_piece: float = 6.0) -> DataFrame:
    """Add ``kept`` to the struct ``rules``: not ``base_failed`` and within the language's bands.

    ``measured`` must be written down, as it is read twice."""
    r = F.col(rules)
    quartiles = lambda x: F.percentile_approx(r[x], F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000))
    middle_size = F.percentile_approx(r["n_symbols_scored"], F.lit(0.5), F.lit(10_000))
    q = measured.filter(~r["base_failed"]).groupBy(r["lang"].alias("_of")).agg(quartiles("log_ppl").alias("_q"), quartiles("log_ppl_piece").alias("_p"), middle_size.alias("_size"))
    iqr = lambda x: F.greatest(F.element_at(x, 2) - F.element_at(x, 1), F.lit(0.01))
    bands = q.select("_of", "_q", "_p", "_size", iqr("_q").alias("_iqr"), iqr("_p").alias("_ipr"))
    # one row a language
    joined = measured.join(F.broadcast(bands), r["lang"] == F.col("_of"), "left")
    wider = lambda size: F.sqrt(F.greatest(F.lit(1.0), size / F.greatest(r["n_symbols_scored"], F.lit(1))))
    reach = F.col("_iqr") * wider(F.col("_size"))
    fits = r["log_ppl"].between(F.element_at("_q", 1) - below * reach, F.element_at("_q", 2) + above * reach)
    fits &= r["log_ppl_piece"] <= F.element_at("_p", 2) + above_piece * F.col("_ipr") * wider(F.lit(PIECE))
    return joined.withColumn(rules, r.withField("kept", F.coalesce(~r["base_failed"] & fits, F.lit(False)))).drop("_of", "_q", "_p", "_size", "_iqr", "_ipr")


def quality_rules(docs: DataFrame, *, carry: list[str] | None = None, text: str = "text", lang: str = "lang", hot: int = HOT, min_words: int = 20, max_repeat_percent: int = 30, piece: int = PIECE, only_kept: bool = False, **bands) -> DataFrame:
    """``carry`` (all columns if None) and a struct ``rules`` (or longer, if that name is taken) of
    all figures and ``kept``, the last column; only the rows that stay if ``only_kept``."""
    carry = docs.columns if carry is None else carry
    rows, own = sources(docs, carry, text, lang)
    model = sorted_hashes(window_logs(count_windows(rows, own)))
    scored, name = score(rows, own, carry, most_frequent(model, hot), min_words=min_words, max_repeat_percent=max_repeat_percent, piece=piece)
    judged = judge(perplexities(scored, name, model, piece), **bands)
    of, kept = own_name(scored, "_of"), own_name(scored.select(*carry), "rules")
    judged = judged.select(F.col("uid").alias(of), F.col("rules").alias(own_name(scored, "_r")))
    if only_kept:
        judged = judged.filter(F.col(judged.columns[1])["kept"])
    # sorted at every size: both sides grow with the corpus
    joined = scored.select(*carry, F.col(name)["uid"].alias(own_name(scored, "_uid"))).join(judged.hint("merge"), F.col(own_name(scored, "_uid")) == F.col(of))
    return joined.select(*carry, F.col(judged.columns[1]).alias(kept))
