"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A window is `n`
consecutive words of an item; an item with fewer words (but some) is one window. Each document's
windows are looked up in the broadcast set by a 64-bit hash, hits are verified word by word, and every
document word inside an occurrence is hit.

Size of the broadcast: the item texts are measured first. Up to BLOCK_BYTES they go out in one set;
beyond it the items are dealt into blocks of at most about that size by item, and every block is held
against all documents, one after the other: each block's hits are written before the next block is sent
out, and are joined by the document's id and a hash of its text. Nothing is dropped either way.

Defined cases: null or wordless texts have no words and no hits; items without words or without id
are no items; rows with equal item ids count as one item; repeated documents are judged row by row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, begin, keyed_text, table, texts

WINDOW = 13
BLOCK_BYTES = 32 << 20
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _mix(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word number (splitmix's finisher)."""
    x = ids.astype(np.uint64) * _BASE
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _windows(mixed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values."""
    h = mixed[: len(mixed) - n + 1].copy()
    for k in range(1, n):
        h *= np.uint64(0x100000001B3)
        h += mixed[k : len(mixed) - n + 1 + k]
    return h ^ (h >> np.uint64(32))


class ItemSet:
    """Benchmark windows by length: hashes in order, their word numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[int, str]], n: int = WINDOW) -> None:
        self.n, self.vocab, by = n, {}, defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words((text or "").encode())]
            if ids and item is not None:
                size = min(n, len(ids))
                for i in range(len(ids) - size + 1):
                    by[size][tuple(ids[i : i + size])].add(item)
        self.sets = []
        for size, grams in sorted(by.items()):
            ids = np.array(list(grams), dtype=np.int64).reshape(-1, size)
            h = _windows_2d(_mix(ids))
            order = np.argsort(h, kind="stable")
            low = np.zeros(1 << 16, dtype=bool)
            low[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
            owners = list(grams.values())
            self.sets.append((size, h[order], ids[order], [owners[i] for i in order], low))


def _windows_2d(m: np.ndarray) -> np.ndarray:
    h = m[:, 0].copy()
    for k in range(1, m.shape[1]):
        h *= np.uint64(0x100000001B3)
        h += m[:, k]
    return h ^ (h >> np.uint64(32))


def find(items: ItemSet, docs: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set]]:
    """For each text: number of words, hit runs [start, end), and the items with occurring windows."""
    get, counts, parts = items.vocab.get, [], []
    for text in docs:
        w = words(text)
        counts.append(len(w))
        parts.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
    ids = np.concatenate([*parts, np.zeros(0, np.int64)])
    ends = np.cumsum(counts)
    starts = ends - counts
    out = [(n, [], set()) for n in counts]
    mixed, unknown = _mix(ids), np.concatenate([[0], np.cumsum(ids == 0)])
    for size, hashes, grams, owners, low in items.sets:
        if len(ids) < size:
            continue
        maybe = np.flatnonzero(unknown[size:] == unknown[: len(unknown) - size])  # every word is a benchmark word
        h = mixed[maybe].copy()
        for k in range(1, size):
            h *= np.uint64(0x100000001B3)
            h += mixed[maybe + k]
        h ^= h >> np.uint64(32)
        keep = low[(h & np.uint64(0xFFFF)).astype(np.int64)]
        maybe, h = maybe[keep], h[keep]
        at = np.searchsorted(hashes, h)
        keep = at < len(hashes)
        maybe, h, at = maybe[keep], h[keep], at[keep]
        keep = hashes[at] == h
        maybe, at = maybe[keep], at[keep]
        doc = np.searchsorted(ends, maybe, side="right")
        for p, a, d in zip(maybe.tolist(), at.tolist(), doc.tolist(), strict=True):
            if p + size > ends[d]:
                continue
            while a < len(hashes) and not np.array_equal(grams[a], ids[p : p + size]):  # equal hashes stand together
                a = a + 1 if a + 1 < len(hashes) and hashes[a + 1] == hashes[a] else len(hashes)
            if a < len(hashes):
                out[d][1].append((p - int(starts[d]), p - int(starts[d]) + size))
                out[d][2].update(owners[a])
    return [(n, merge(runs), found) for n, runs, found in out]


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


HITS = "doc_id long, n_words long, spans array<struct<start:int,stop:int>>, items array<long>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _scan(docs: DataFrame, items: ItemSet, extra: list[str]) -> DataFrame:
    """Hits of (doc_id, text, ...), and behind them the named columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    docs = docs.select("doc_id", "text", *(x for x in extra if x != "text"))
    at = [docs.columns.index(x) for x in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                b = batch.slice(k, 1000)
                got = find(shared.value, texts(b))
                cols = [b.column(0), pa.array([n for n, _, _ in got], pa.int64()), pa.array([[{"start": s, "stop": e} for s, e in r] for _, r, _ in got], _SPANS), pa.array([sorted(i) for _, _, i in got], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, *(b.column(x) for x in at)], names=[*"doc_id n_words spans items".split(), *extra])

    return docs.mapInArrow(run, HITS + "".join(f", {x} {docs.schema[x].dataType.simpleString()}" for x in extra))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, spans of hit words (disjoint, in order), items found."""
    docs = keyed_text(docs, id_col, text_col)
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    extra = ["text"] * with_text
    if blocks == 1:
        return _scan(docs, ItemSet([tuple(r) for r in bench.collect()], n), extra)
    scratch = scratch or Scratch(docs.sparkSession, "contamination")
    docs, found = docs.withColumn("_mark", F.xxhash64("text")), None
    for k in range(blocks):
        items = ItemSet([tuple(r) for r in bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()], n)
        if k + 1 < blocks:
            part = scratch.write(_scan(docs, items, ["_mark"]).where("size(spans) > 0").select("doc_id", "_mark", "spans", "items"), f"hits-{k}")
            found = part if found is None else found.unionByName(part)
    # the last block's scan carries all rows; equal rows have equal hits
    found = found.groupBy("doc_id", "_mark").agg(F.flatten(F.collect_set("spans")).alias("_spans"), F.flatten(F.collect_set("items")).alias("_items"))
    found = found.withColumnsRenamed({"doc_id": "_id", "_mark": "_text"})
    last = _scan(docs, items, ["_mark", *extra])
    both = last.join(found, last["doc_id"].eqNullSafe(found["_id"]) & (last["_mark"] == found["_text"]), "left")
    every = lambda a, b: F.concat(a, F.coalesce(b, F.array().cast(both.schema[b].dataType)))
    both = both.withColumn("spans", every("spans", "_spans")).withColumn("items", F.array_sort(F.array_distinct(every("items", "_items"))))
    return both.select("doc_id", "n_words", _merged("spans").alias("spans"), "items", *extra)


def _merged(col: str):
    """Disjoint runs in order from any runs: fold over the sorted ones."""
    return F.expr(f"""aggregate(array_sort({col}), cast(array() as array<struct<start:int,stop:int>>),
      (a, x) -> CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).stop
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, x.stop))))
        ELSE concat(a, array(x)) END)""")


def judged(hits: DataFrame) -> DataFrame:
    """hits with n_hit and contaminated: some word is hit, and at least one in twenty."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    hits = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT item_id, least(13, len(w)) AS size, w[i : i + least(13, len(w)) - 1] AS gram FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM g),
o AS (SELECT doc_id, i, size, w[i : i + size - 1] AS gram FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
h AS (SELECT o.doc_id, o.i, o.size, g.item_id FROM o JOIN g ON o.gram = g.gram AND o.size = g.size),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.names, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
