"""Substring dedup by recompression.

A text's words are renamed in rounds: first runs of one word, then, round after round, pairs (a, b) in
which a's name is of the left class and b's of the right (classes by a bit of the name's hash, so that
pairs never overlap). A name is a hash of the names it stands for: the same run or pair has the same
name everywhere, in every task, without a dictionary that has to be agreed on. Each symbol also carries
its context, the stretch of words that fixes it; a stretch that repeats gives the same symbols wherever
their context lies within.

Every window of 50 words has one representative: among the symbols whose context it holds, those of the
latest round, and of them the least name. It depends on the window's words alone, so equal windows have
equal representatives (a word is its own symbol, so there always is one). Spark finds the names that
documents share; only windows with a shared representative are verified, by hashes of all their words
(96 bits), and a window is removed where the least document that has it is a smaller one.

Defined cases: null ids neither lose words nor are sources; null, empty and short texts (under 50 words)
lose nothing; repeated rows and equal ids don't remove each other's words, and rows with one id but different texts are
each judged by their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, begin, hot_keys, keyed_text, skew_join, table, texts, with_mark
from .near_dedup import mix, word_hashes

WINDOW, ROUNDS = 50, 9
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_FAR = 1 << 40


class Parsed:
    """The words of some texts laid end to end, and each window's representative name."""

    def __init__(self, docs: list[list[bytes]], window: int = WINDOW, rounds: int = ROUNDS) -> None:
        self.window = window
        self.size = np.array([len(d) for d in docs], np.int64)
        self.stop = np.cumsum(self.size)
        self.start = self.stop - self.size
        self.words = word_hashes([w for d in docs for w in d])
        n = len(self.words)
        self.owner = np.repeat(np.arange(len(docs)), self.size)
        self.whole = np.arange(n) + window <= self.stop[self.owner] if n else np.zeros(0, bool)  # a window starts here
        self.name = np.zeros(n, np.uint64)
        if self.whole.any():
            self._choose(self._rounds(rounds))

    def _rounds(self, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(name, context start, context stop) of the symbols that each round forms, words first."""
        at = np.arange(len(self.words))
        name, cs, ce = mix(self.words), at, at + 1
        first, last = at == self.start[self.owner], at + 1 == self.stop[self.owner]
        out = [(name, cs, ce)]
        # runs: a symbol that differs from its neighbours is fixed by them too
        new = np.concatenate([[True], (name[1:] != name[:-1]) | first[1:]])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(name)))
        end = begin + count - 1
        is_first, is_last = first[begin], last[end]
        run_cs = np.where(is_first, -_FAR, begin - 1)
        run_ce = np.where(is_last, _FAR, end + 2)
        run = count > 1
        name = np.where(run, mix(name[begin] * _A + count.astype(np.uint64)), name[begin])
        cs, ce, first, last = run_cs, run_ce, is_first, is_last
        out.append((name[run], cs[run], ce[run]))
        for k in range(rounds):
            if len(name) < 2:
                break
            right = (mix(name + np.uint64(k)) & np.uint64(1)).astype(bool)
            pair = np.append(~right[:-1] & right[1:] & ~last[:-1], False)
            second = np.concatenate([[False], pair[:-1]])
            nxt_ce, prv_cs = np.append(ce[1:], _FAR), np.concatenate([[-_FAR], cs[:-1]])
            # a left one is alone if no right one follows, a right one if no left one stands before
            alone_ce = np.where(last, _FAR, np.maximum(ce, nxt_ce))
            alone_cs = np.where(first, -_FAR, np.minimum(cs, prv_cs))
            new_ce = np.where(pair, np.maximum(ce, nxt_ce), np.where(right, ce, alone_ce))
            new_cs = np.where(pair, cs, np.where(right, alone_cs, cs))
            joined = mix(name * _A + mix(np.append(name[1:], np.uint64(0)) + _B) + np.uint64(k))
            keep = ~second
            name, cs, ce = np.where(pair, joined, name)[keep], new_cs[keep], new_ce[keep]
            first, last = first[keep], np.where(pair, np.append(last[1:], False), last)[keep]
            out.append((name[pair[keep]], cs[pair[keep]], ce[pair[keep]]))
        return out

    def _choose(self, rounds: list) -> None:
        open_, n = self.whole.copy(), len(self.words)
        for name, cs, ce in reversed(rounds):
            fit = ce - cs <= self.window
            name, cs, ce = name[fit], cs[fit], ce[fit]
            if not len(name):
                continue
            w = np.flatnonzero(open_)
            if not len(w):
                return
            # contexts that begin before w, and those that end by w + window: both ends rise with the symbols
            lo = np.concatenate([[0], np.cumsum(np.bincount(cs, minlength=n + 1))])[w]
            hi = np.cumsum(np.bincount(ce, minlength=n + 1))[w + self.window]
            some = hi > lo
            w, lo, hi = w[some], lo[some], hi[some]
            best = name[lo] if len(lo) else lo
            step, live = 1, np.flatnonzero(hi - lo > 1)
            while len(live):
                best[live] = np.minimum(best[live], name[lo[live] + step])
                step += 1
                live = live[hi[live] - lo[live] > step]
            self.name[w] = best
            open_[w] = False

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A long and an int for the words of each window: a polynomial in two bases, put together from those of
        1, 2, 4, ... words."""
        out = []
        for base in (int(_A), int(_B)):
            h, held, run, size, left = np.zeros(len(self.words), np.uint64), 0, self.words, 1, self.window
            while True:
                if left & 1:
                    h = run * np.uint64(pow(base, held, 1 << 64)) + _ahead(h, size)
                    held += size
                left >>= 1
                if not left:
                    break
                run = run * np.uint64(pow(base, size, 1 << 64)) + _ahead(run, size)
                size *= 2
            out.append(mix(h[at]))
        return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """x from place k on, then zeros."""
    out = np.zeros_like(x)
    out[: max(0, len(x) - k)] = x[k:]
    return out


def _words(text: bytes) -> list[bytes]:
    return text.split()


def _blocks(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text."""
    size = [len(x) for x in texts(batch)]
    begin, total = 0, 0
    for k, n in enumerate(size):
        if total and total + n > most:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if begin < len(size):
        yield batch.slice(begin)


def _names(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for b in _blocks(batch):
                p = Parsed([_words(t) for t in texts(b)], window, rounds)
                at = np.flatnonzero(p.whole)
                turn = np.concatenate([[True], (p.name[at][1:] != p.name[at][:-1]) | (p.owner[at][1:] != p.owner[at][:-1])]) if len(at) else np.zeros(0, bool)
                at = at[turn]
                got = np.unique(np.stack([p.owner[at], p.name[at].view(np.int64)], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 1]), b.column(0).take(pa.array(got[:, 0])), b.column(2).take(pa.array(got[:, 0]))], names=["name", "doc_id", "mark"])

    return run


def _windows(window: int, rounds: int):
    """Of (doc_id, text, mark, names): the windows whose representative is among the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for b in _blocks(batch):
                p = Parsed([_words(t) for t in texts(b)], window, rounds)
                shared = [np.array(x, np.int64).view(np.uint64) for x in b.column(3).to_pylist()]
                at = [s + np.flatnonzero(p.whole[s:e] & np.isin(p.name[s:e], x)) for s, e, x in zip(p.start, p.stop, shared, strict=True)]
                at = np.concatenate([np.zeros(0, np.int64), *at])
                h, check = p.hashes(at)
                own = pa.array(p.owner[at])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(check), b.column(0).take(own), b.column(2).take(own), pa.array((at - p.start[p.owner[at]]).astype(np.int32))], names=["h", "chk", "doc_id", "mark", "pos"])

    return run


def _cut(window: int, with_text: bool):
    """Of (doc_id, text, starts): words, removed words, and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for b in _blocks(batch):
                n, gone, left = [], [], []
                for t, starts in zip(texts(b), b.column(2).to_pylist(), strict=True):
                    w = _words(t)
                    n.append(len(w))
                    if starts:
                        mark = np.zeros(len(w) + 1, np.int64)
                        np.add.at(mark, starts, 1)
                        np.add.at(mark, np.array(starts) + window, -1)
                        keep = np.cumsum(mark)[:-1] == 0
                        w = [x for x, k in zip(w, keep.tolist(), strict=True) if k]
                    gone.append(n[-1] - len(w))
                    left.append(b" ".join(w))
                sha = [hashlib.sha256(x).hexdigest() for x in left]
                cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
                if with_text:
                    cols.append(pa.array([x.decode() for x in left], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])

    return run


def removal_starts(docs: DataFrame, window: int, rounds: int, scratch: Scratch) -> DataFrame:
    """(doc_id, mark, starts): first words of the windows to remove, of the documents (doc_id, text, mark) that
    lose any."""
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    names = scratch.write(some.mapInArrow(_names(window, rounds), "name long, doc_id long, mark long"), "names")
    shared = names.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("name")
    by_doc = skew_join(names, scratch.write(shared, "shared"), "name").groupBy("doc_id", "mark").agg(F.collect_set("name").alias("names"))
    found = some.join(by_doc, ["doc_id", "mark"]).select("doc_id", "text", "mark", "names").mapInArrow(_windows(window, rounds), "h long, chk int, doc_id long, mark long, pos int")
    found = scratch.write(found, "windows")
    scratch.drop("names", "shared")
    least = found.groupBy("h", "chk").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "chk", "lo")
    least = scratch.write(least, "least")
    later = _later(found, least)
    starts = scratch.write(later.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("starts")), "starts")
    scratch.drop("windows", "least")
    return starts


def _kept_rows(window: int, at: int):
    """Rows with, behind their columns, removal starts: the text at column `at` without the removed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for b in batches:
            left = []
            for t, starts in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if starts:
                    w = _words(t.encode())
                    mark = np.zeros(len(w) + 1, np.int64)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, np.array(starts) + window, -1)
                    t = b" ".join([x for x, n in zip(w, np.cumsum(mark).tolist(), strict=False) if not n]).decode()
                left.append(t)
            cols = list(b.columns[:-1])
            cols[at] = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """docs with later repeats taken out of the text (the words left are joined by one space); a text that
    loses nothing stays as it is, and so do all other columns and rows."""
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    keyed = with_mark(keyed_text(docs, id_col, text_col))
    starts = removal_starts(keyed, window, rounds, scratch).select(F.col("doc_id").alias("_repeat_id"), F.col("mark").alias("_repeat_mark"), F.col("starts").alias("_repeat_starts"))
    own = docs[id_col].cast("long") == starts["_repeat_id"]
    text_hash = F.xxhash64(docs[text_col].cast("string"))
    rows = docs.join(starts, own & starts["_repeat_mark"].isin(F.lit(0), text_hash), "left").drop("_repeat_id", "_repeat_mark")
    return rows.mapInArrow(_kept_rows(window, docs.columns.index(text_col)), docs.schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and with with_text kept, one row a document."""
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    docs = with_mark(keyed_text(docs, id_col, text_col))
    starts = removal_starts(docs, window, rounds, scratch)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return docs.join(starts, ["doc_id", "mark"], "left").select("doc_id", "text", "starts").mapInArrow(_cut(window, with_text), schema)


def _later(found: DataFrame, least: DataFrame) -> DataFrame:
    """Windows that a smaller document has: hot windows meet their least document by broadcast."""
    hot = found.sparkSession.createDataFrame(hot_keys(found, "h").collect(), found.select("h").schema)
    few = F.broadcast(least.join(F.broadcast(hot), "h", "left_semi"))
    rest = found.join(F.broadcast(hot), "h", "left_anti").join(least, ["h", "chk"])
    both = found.join(few, ["h", "chk"]).unionByName(rest)
    return both.where("lo < doc_id").select("doc_id", "mark", "pos")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i : i + 49] AS gram FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
m AS (SELECT gram, min(doc_id) AS lo FROM g GROUP BY gram),
h AS (SELECT g.doc_id, g.i FROM g JOIN m ON g.gram = m.gram WHERE m.lo < g.doc_id),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM h, unnest(range(i, i + 50)) AS t(p) GROUP BY doc_id),
k AS (SELECT d.doc_id, p, w[p] AS word FROM d LEFT JOIN c USING (doc_id), unnest(range(1, len(w) + 1)) AS t(p) WHERE c.gone IS NULL OR NOT list_contains(c.gone, p)),
s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(c.gone), 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""
