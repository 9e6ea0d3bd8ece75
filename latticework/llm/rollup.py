"""Token counts kept as a rollup of deltas.

A batch is a set of signed changes: an insert adds a document's tokens to the total of its source,
language and tokenizer version, a delete takes them away, a revision takes the old count away and
adds the new one. Each batch is summed by key before it is written, so the store grows with keys,
not with documents; totals are the sum over committed batches, in any order.

Commits are idempotent. A batch's sums go to a folder of their own attempt, then one marker file,
written aside and renamed to its name only if that is free, names the attempt that counts. A batch
committed twice, by a retry or by two writers, counts once, and an attempt without its marker counts
never. ``compact`` folds all committed batches into one that remembers their names, under a new
marker, so that no crash loses one; ``vacuum`` deletes what no marker names once it is old enough
that no reader or writer uses it.

Null keys are groups of their own; null counts add no tokens but the document counts. Empty batches
commit. A store without batches has no rows. Hot keys are summed within tasks first.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import library_encoder, rank_encoder
from .common import field, filesystem, map_batches, materialise, own_name, texts_of, tokenizer_file

KEYS = ("source", "lang", "tokenizer")


class RollupStore:
    """Totals of documents and tokens by ``keys`` in the folder ``path``, on any Hadoop store."""

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str] = KEYS) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _marker(self, batch: str) -> str:
        if not batch or batch[0] in "~._" or any(c in batch for c in "/\\:"):
            raise ValueError(f"not a batch name: {batch!r}")
        return f"{self.path}/commits/{batch}"

    def _read(self, path: str) -> str | None:
        fs, p = filesystem(self.spark, path)
        try:
            stream = fs.open(p)
        except Py4JJavaError:
            if fs.exists(p):
                raise
            return None
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _aside(self, content: str) -> str:
        """A file of this content under a name that readers skip."""
        path = f"{self.path}/commits/.{uuid.uuid4().hex}"
        fs, p = filesystem(self.spark, path)
        stream = fs.create(p, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        return path

    def _publish(self, path: str, content: str) -> bool:
        """Whether this call made the file. It is there with all its content or not at all."""
        aside = self._aside(content)
        jvm = self.spark._jvm
        fs, source = filesystem(self.spark, aside)
        target = jvm.org.apache.hadoop.fs.Path(path)
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never_over[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, never_over)
        except Py4JJavaError:
            fs.delete(source, False)
            if fs.exists(target):
                return False
            raise
        return True

    def committed(self) -> dict[str, str]:
        """Each marker that counts and its content: the attempt, and the batches folded into it."""
        fs, p = filesystem(self.spark, f"{self.path}/commits")
        while fs.exists(p):
            names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())
            found = {n: self._read(f"{self.path}/commits/{n}") for n in names if not n.startswith((".", "_"))}
            if None in found.values():
                continue  # a compaction went on meanwhile
            folded = {x for a in found.values() for x in a.split("\n")[1:]}
            return {n: a for n, a in found.items() if n not in folded}
        return {}

    def covered(self) -> set[str]:
        """Names of all batches that count, compacted ones included."""
        names = {x for name, content in self.committed().items() for x in [name, *content.split("\n")[1:]]}
        return {x for x in names if not x.startswith("~")}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` (keys, ``docs``, ``tokens``, both signed); False if the batch is there
        already, and then nothing changes."""
        marker = self._marker(batch)
        if batch in self.covered():
            return False
        attempt = uuid.uuid4().hex
        self._write(attempt, changes)
        # a compaction may have folded the batch of another writer, whose marker is gone then
        if batch not in self.covered() and self._publish(marker, attempt):
            return True
        self._drop(attempt)
        return False

    def _write(self, attempt: str, changes: DataFrame) -> None:
        sums = changes.groupBy(*self.keys).agg(F.sum("docs").cast("bigint").alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/deltas/{attempt}")

    def _drop(self, attempt: str) -> None:
        fs, p = filesystem(self.spark, f"{self.path}/deltas/{attempt}")
        fs.delete(p, True)

    def totals(self, *, zero: bool = False) -> DataFrame:
        """keys, ``n_docs``, ``n_tokens`` over all committed batches; keys without documents are
        left out unless ``zero``."""
        paths = [f"{self.path}/deltas/{c.split(chr(10))[0]}" for c in self.committed().values()]
        if not paths:
            kinds = ", ".join(f"{k} string" for k in self.keys)
            return self.spark.createDataFrame([], f"{kinds}, n_docs bigint, n_tokens bigint")
        out = self.spark.read.parquet(*paths).groupBy(*self.keys).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return out if zero else out.filter("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> str | None:
        """Fold all committed batches into one; readers see the old state or the new one, and what
        they have planned to read stays until ``vacuum``. One compaction at a time; commits may go on
        meanwhile."""
        old = self.committed()
        if len(old) < 2:
            return None
        attempt, name = uuid.uuid4().hex, f"~{uuid.uuid4().hex}"
        self._write(attempt, self.spark.read.parquet(*[f"{self.path}/deltas/{c.split(chr(10))[0]}" for c in old.values()]))
        folded = sorted({x for n, c in old.items() for x in [n, *c.split("\n")[1:]]})
        self._publish(f"{self.path}/commits/{name}", "\n".join([attempt, *folded]))
        # from here on the new marker covers the old ones, whether they are there or not
        for n in old:
            fs, p = filesystem(self.spark, f"{self.path}/commits/{n}")
            fs.delete(p, False)
        return name

    def vacuum(self, older_than: float = 7 * 24 * 3600) -> int:
        """Delete attempts and files aside that no marker names and that were made more than
        ``older_than`` seconds ago; how many."""
        live = {c.split("\n")[0] for c in self.committed().values()}
        gone = 0
        for folder, old in (("deltas", lambda n: n not in live), ("commits", lambda n: n.startswith("."))):
            fs, p = filesystem(self.spark, f"{self.path}/{folder}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if old(s.getPath().getName()) and s.getModificationTime() <= (time.time() - older_than) * 1000:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone


def inserts(rows: DataFrame, tokenizer: str, count: Column, *, source: str = "source", lang: str = "lang", sign: int = 1) -> DataFrame:
    """Changes that add (``sign`` 1) or take away (-1) each row and its count."""
    return rows.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("bigint").alias("docs"), (F.coalesce(count, F.lit(0)) * sign).cast("bigint").alias("tokens"))


def deletes(rows: DataFrame, tokenizer: str, count: Column, **how) -> DataFrame:
    return inserts(rows, tokenizer, count, sign=-1, **how)


def revisions(rows: DataFrame, tokenizer: str, before: Column, after: Column, *, source: str = "source", lang: str = "lang") -> DataFrame:
    """Changes of rows whose count goes from ``before`` to ``after``; the documents stay."""
    delta = F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))
    return rows.select(F.col(source).alias("source"), F.col(lang).alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("bigint").alias("docs"), delta.cast("bigint").alias("tokens"))


SIGNS = r"[#*$%&|<>]"


def bpe_counts(docs: DataFrame, *, versions: dict[str, str | None] | None = None, text: str = "text") -> DataFrame:
    """``doc_id, source, lang, counts``: for each tokenizer version the tokens of the whole text and,
    where it has markup signs, of the text without them. ``versions`` names the vocabulary files
    (by default the two public byte-level ones). Every text is read and encoded in one pass."""
    files = {k: v or tokenizer_file(k) for k, v in (versions or {"byte_bpe_50k.json": None, "byte_bpe_multi_50k.tiktoken": None}).items()}
    kinds = "array<struct<tokenizer:string,n:bigint,stripped:bigint>>"
    own = own_name(docs.select("doc_id", "source", "lang"), "_text")
    schema = T.StructType([docs.schema["doc_id"], docs.schema["source"], docs.schema["lang"], field("counts", kinds)])
    kind = to_arrow_schema(schema).field("counts").type

    def run(batches):
        encoders = {k: rank_encoder(f)[0] if f.endswith(".tiktoken") else library_encoder(f) for k, f in files.items()}
        for b in batches:
            texts = texts_of(b, own)
            marked = [i for i, t in enumerate(texts) if re.search(SIGNS, t)]
            stripped = [re.sub(SIGNS, "", texts[i]) for i in marked]
            out: list[list[dict]] = [[] for _ in texts]
            for name, encoder in encoders.items():
                n = [len(x) // 4 for x in encoder.encode(texts)]
                less = dict(zip(marked, [len(x) // 4 for x in encoder.encode(stripped)], strict=True))
                for i, mine in enumerate(out):
                    mine.append({"tokenizer": name, "n": n[i], "stripped": less.get(i)})
            yield [*[b.column(i) for i in range(3)], pa.array(out, kind)]

    return map_batches(docs.select("doc_id", "source", "lang", F.col(text).alias(own)), run, schema, limit=2 << 20, text=own)


def word_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The same of two tokenizers that SQL can express: words between ASCII white space; and runs of
    ASCII letters and digits or of other characters beyond ASCII, and single other signs."""
    patterns = {"words-1": r"[^\x20\x09-\x0D]+", "signs-1": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"}
    t = F.coalesce(F.col(text), F.lit(""))
    less = F.when(t.rlike(SIGNS), F.regexp_replace(t, SIGNS, ""))
    n = lambda x, p: F.regexp_count(x, F.lit(p)).cast("bigint")
    return docs.select("doc_id", "source", "lang", F.array(*[F.struct(F.lit(k).alias("tokenizer"), n(t, p).alias("n"), n(less, p).alias("stripped")) for k, p in patterns.items()]).alias("counts"))


def lifecycle(docs: DataFrame, labels: DataFrame, store: RollupStore, *, count: Callable[[DataFrame], DataFrame] = bpe_counts) -> DataFrame:
    """A corpus's life in batches: all documents come in under each tokenizer version, counts of
    texts with markup signs are revised to those without, labelled toxic documents are taken down,
    the store is compacted, and every batch is sent twice.

    Texts are counted once and the counts written down, summed by document id, so that a repeated id
    is one row in the join that takes documents down."""
    each = count(docs).select("doc_id", "source", "lang", F.explode("counts").alias("c")).select("doc_id", "source", "lang", F.col("c.tokenizer").alias("tokenizer"), F.col("c.n").alias("n"), F.coalesce("c.stripped", "c.n").alias("last"))
    counts = materialise(each.groupBy("doc_id", "source", "lang", "tokenizer").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("last").alias("last")), "counted")
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    down = counts.join(toxic.hint("merge"), F.col("doc_id") == F.col("id"))
    change = lambda rows, docs_, tokens: rows.select("source", "lang", "tokenizer", docs_.cast("bigint").alias("docs"), tokens.cast("bigint").alias("tokens"))
    batches = {
        "0001-inserted": change(counts, F.col("docs"), F.col("n")),
        "0002-revised": change(counts.filter("n <> last"), F.lit(0), F.col("last") - F.col("n")),
        "0003-taken-down": change(down, -F.col("docs"), -F.col("last")),
    }
    for again in (False, True):
        for name, changes in batches.items():
            store.commit(name, changes)
        if not again:
            store.compact()
    return store.totals()
