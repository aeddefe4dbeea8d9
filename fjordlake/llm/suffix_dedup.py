"""Suffix-array dedup: repeated byte strings from merged shard Burrows-Wheeler transforms.

Removes each byte covered by a string of `length` bytes that starts at two places or more (the same
document included). Sorting all suffixes of a corpus would compare mostly text that repeats nowhere, so:

1. Anchors. A window of `length` bytes is named by the least hash among its 64-byte strings (a function
   of its bytes). Consecutive windows of one name form a segment, a phrase of the text. Equal windows
   have equal names, so a window repeats nowhere if its name belongs to one segment only and stands
   once in it (it stands twice where the text is periodic).
2. Phrases. Equal segments (by 96 bits of hash) repeat in all their windows; one copy stands for all.
3. Merged transforms. What is left are different segments of one name, about the ends of repeats. They
   are dealt to buckets by name; each bucket's shards get a suffix order and its transform (the blocks
   before each suffix), and the shards are merged by refining the interleave: a stable sort of the
   current interleave by preceding symbol gives the interleave by a longer prefix, WIDTH bytes a round,
   without comparing suffixes across shards. The round in which a row comes to stand alone gives its
   common prefix; intervals that still hold several rows at `length` bytes are the repeats.
4. Names with over `hot` different segments (a passage that a good part of all documents quote) don't
   fit a bucket: blocks of their windows are counted by hash instead (a block's core, then its whole, then
   single windows where the two disagree), pre-aggregated, so no task holds them whole.

Defined cases: null and empty texts lose nothing; a repeated row is another document, so rows of at
least `length` bytes that are equal lose everything; equal ids are told apart by their texts, null ids
are kept as they are and take part in nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, keyed_text, skew_join, table, texts, with_mark
from .near_dedup import mix
from .substring_dedup import _blocks

LENGTH, GRAM, HOT, BUCKET_BYTES, RUN, START, WIDTH, STEP = 200, 64, 2000, 1 << 20, 512, 14, 31, 16
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MOD = 1 << 64


def _letters(base: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


class Rolling:
    """Hashes of any stretch of a text in two bases, from sums of scaled letters."""

    def __init__(self, text: np.ndarray) -> None:
        self.sums, self.back = [], []
        for base in _BASES:
            power = np.full(len(text) + 1, base, np.uint64)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint64)
            inverse = np.full(len(text) + 1, pow(base, -1, _MOD), np.uint64)
            inverse[0] = 1
            self.back.append(np.cumprod(inverse, dtype=np.uint64))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters(base)[text] * power[:-1], dtype=np.uint64)]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (mix((s[stop] - s[start]) * back[start]) for s, back in zip(self.sums, self.back, strict=True))
        return a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours (van Herk: prefix and suffix minima of blocks)."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = np.full(-(-len(x) // width) * width, x.max(), x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(docs: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, name, h, check, whether the name stands twice in it) of the segments
    of some texts."""
    size = np.array([len(d) for d in docs], np.int64)
    text = np.frombuffer(b"".join(docs), np.uint8)
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none, none, none, none.astype(np.int32), none.astype(bool)
    stop = np.cumsum(size)
    begin = stop - size
    h, k = gram_hashes(text, gram), gram
    name = sliding_least(h, length - k + 1)
    owner = np.repeat(np.arange(len(docs)), size)[: len(name)]
    at = np.flatnonzero(np.arange(len(name)) + length <= stop[owner])
    if not len(at):
        return none, none, none, none, none, none.astype(np.int32), none.astype(bool)
    past = np.zeros(length - k, name.dtype)  # near the ends fewer windows reach
    names = np.flatnonzero(h == ~sliding_least(~np.concatenate([past, name, past]), length - k + 1))  # least of some window
    twin = (h[names[1:]] == h[names[:-1]]) & (np.diff(names) <= length - k + 1)
    twins, pairs = names[:-1][twin], names[1:][twin]
    name, owner = name[at], owner[at]
    turn = np.concatenate([[True], (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])])
    run = np.maximum.accumulate(np.where(turn, np.arange(len(at)), 0))
    turn |= (np.arange(len(at)) - run) % RUN == 0  # a long run of one name is cut
    first = np.flatnonzero(turn)
    count = np.diff(np.append(first, len(at)))
    inner = np.searchsorted(pairs, at[first] + count - 1 + length - k, "right") > np.searchsorted(twins, at[first])
    rolling = Rolling(text)
    a, b = rolling.of(at[first], at[first] + count + length - 1)
    return owner[first], at[first] - begin[owner[first]], count, name[first].view(np.int64), a, b, inner


# Burrows-Wheeler transforms -------------------------------------------------------------------------


class Shard:
    """Rows (one a byte position) of some texts in suffix order to `start` bytes (at most START, which two
    numbers hold). The merge refines the order further, so a shard's own need not go deeper."""

    def __init__(self, parts: list[bytes], start: int = START) -> None:
        size = np.array([len(p) for p in parts], np.int64)
        stop = np.cumsum(size)
        n = int(stop[-1])
        self.start, half = start, start // 2
        self.code = np.zeros(n + start, np.int64)
        text = np.frombuffer(b"".join(parts), np.uint8)
        self.roll = Rolling(text)
        self.code[:n] = text
        self.code[:n] += 1  # 0: past the end
        part = np.repeat(np.arange(len(parts), dtype=np.int32), size)
        at = (np.arange(n) - (stop - size)[part]).astype(np.int32)
        left = size[part] - at
        keys = [self.string(n, skip, width, left) for skip, width in ((0, half), (half, start - half))]
        self.order = np.lexsort((keys[1], keys[0]))
        self.row = np.empty(n, np.int32)
        self.row[self.order] = np.arange(n, dtype=np.int32)
        self.keys, self.part, self.at = [k[self.order] for k in keys], part[self.order], at[self.order]

    def string(self, n: int, skip: int, width: int, left: np.ndarray) -> np.ndarray:
        """Each position's next `width` bytes behind `skip` as one number; what lies past its text's end is 0."""
        out = np.zeros(n, np.int64)
        for k in range(skip, skip + width):
            out *= 257
            out += np.where(left > k, self.code[k : k + n], 0)
        return out

    def transform(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of `width` bytes before each row, named by a hash, and the row it leads to (-1: none).
        Blocks are the transform's symbols; any fixed order of them serves."""
        back = np.maximum(self.order - width, 0)
        return self.roll.of(back, np.minimum(back + width, len(back)))[0], np.where(self.at >= width, self.row[back], -1)


def stable_order(rank: np.ndarray) -> np.ndarray:
    """Stable order of numbers under 2**32, by 16 bits at a time (which are sorted by radix)."""
    order = np.argsort((rank & 0xFFFF).astype(np.uint16), kind="stable")
    high = (rank >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def merge(shards: list[Shard], length: int = LENGTH) -> np.ndarray:
    """For each row of the shards (end to end): the bytes it shares with the row beside it in the merged
    transform, in steps of WIDTH from the shards' start (0: fewer) up to `length`.

    The first interleave merges the shards' orders. Each round then interleaves the rows by WIDTH bytes
    more: a stable sort of the last interleave by preceding symbols, each row replaced by the row that its
    symbol leads to. Borders separate different prefixes. A row alone between borders is settled, and so
    are all rows before it in its text (their prefix holds its prefix), so it leaves the interleave; what
    stays are the intervals that still repeat."""
    off = np.cumsum([0, *(len(s.part) for s in shards)])
    one, two = (np.concatenate([s.keys[k] for s in shards]) for k in (0, 1))
    rows = np.lexsort((two, one))  # of runs in order: a merge
    one, two = one[rows], two[rows]
    border = np.ones(len(rows), np.int32)
    border[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    block = np.cumsum(border, dtype=np.int32)
    several = np.bincount(block)[block] > 1
    rows, block = rows[several], block[several]
    shared = np.zeros(off[-1], np.int32)
    shared[rows] = h = width = shards[0].start
    while h < length and len(rows):
        if width != min(WIDTH, length - h):
            width = min(WIDTH, length - h)
            both = [s.transform(width) for s in shards]
            rank = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)[1].astype(np.uint32)
            before = np.concatenate([np.where(x >= 0, x + o, -1) for (_, x), o in zip(both, off, strict=False)])
        led = before[rows] >= 0
        kept, inner = rows[led], block[led]
        sym = rank[kept]
        order = stable_order(sym)
        kept, inner, sym = kept[order], inner[order], sym[order]
        border = np.ones(len(kept), np.int32)
        border[1:] = (sym[1:] != sym[:-1]) | (inner[1:] != inner[:-1])
        block = np.cumsum(border, dtype=np.int32)
        rows = before[kept]
        several = np.bincount(block, minlength=1)[block] > 1
        rows, block = rows[several], block[several]
        h += width
        shared[rows] = h
    return shared


def repeated(parts: list[bytes], windows: list[int], shards: int = 4, length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its first `windows` starts begin a string that starts elsewhere, too."""
    dealt = [Shard(parts[k::shards], min(START, length)) for k in range(min(shards, len(parts)))]
    hit = merge(dealt, length) >= length
    part = np.concatenate([s.part * len(dealt) + k for k, s in enumerate(dealt)])
    at = np.concatenate([s.at for s in dealt])
    out = [np.zeros(n, bool) for n in windows]
    hit &= at < np.array(windows)[part]
    for k, p in zip(part[hit].tolist(), at[hit].tolist(), strict=True):
        out[k][p] = True
    return out


# Spark stages ----------------------------------------------------------------------------------------


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks(batch):
                data = texts(b)
                doc, start, count, name, h, check, inner = segments(data, length, gram)
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(h), pa.array(check), b.column(0).take(own), b.column(2).take(own), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(inner)], names="name h chk doc_id mark pos n inner".split())

    return run


def _extract(length: int):
    """Of (doc_id, text, mark, list of (name, pos, n, known, wide)): the segments' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks(batch):
                out = []
                for i, t, mark, wanted in zip(b.column(0).to_pylist(), texts(b), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    out += [(w["name"], i, mark, w["pos"], w["n"], w["known"], w["wide"], t[w["pos"] : w["pos"] + w["n"] + length - 1]) for w in wanted]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names="name doc_id mark pos n known wide bytes".split())

    return run


def _bucket(length: int):
    def run(t: pa.Table) -> pa.Table:
        parts, n, known = t.column("bytes").to_pylist(), t.column("n").to_pylist(), t.column("known").to_pylist()
        ids, pos = list(zip(t.column("doc_id").to_pylist(), t.column("mark").to_pylist(), strict=True)), t.column("pos").to_pylist()
        out = []
        for i, p, k, hit in zip(ids, pos, known, repeated(parts, n, length=length), strict=True):
            if not k and hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                out += [(*i, p + s, e - s) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        kinds = {"doc_id": pa.int64(), "mark": pa.int64(), "pos": pa.int32(), "n": pa.int32()}
        return pa.table({c: pa.array([x[k] for x in out], kind) for k, (c, kind) in enumerate(kinds.items())})

    return run


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each string of `gram` bytes (a power of two), by doubling."""
    h, k = _letters(_BASES[0])[text], 1
    while 2 * k <= gram:
        h = mix(h[:-k] * np.uint64(pow(3, 2 * k, _MOD) | 1) + h[k:])
        k *= 2
    return h


def _stretches(length: int, gram: int):
    """Of segments of hot names: blocks of up to STEP windows, by where the name first stands in a window
    (equal windows are in equal blocks). Each block gives the hash of its core, which all its windows hold
    (if that stands nowhere else, none repeats), and of the whole (if that stands elsewhere, all repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(10)]
            for r in b.to_pylist():
                text, at = np.frombuffer(r["bytes"], np.uint8), np.arange(r["n"])
                stand = np.flatnonzero(gram_hashes(text, gram).view(np.int64) == r["name"])
                q = stand[np.searchsorted(stand, at)]
                key = q * length + (q - at) // STEP
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                count = np.diff(np.append(first, len(at)))
                roll = Rolling(text)
                last = q[first] - (q - at)[first] // STEP * STEP  # the block's last possible start
                core = roll.of(last, last - STEP + 1 + length)
                whole = roll.of(first, first + count + length - 1)
                for col, x in zip(out, (np.full(len(first), r["doc_id"]), np.full(len(first), r["mark"]), np.full(len(first), r["pos"]), first + r["pos"], count, *core, *whole, np.full(len(first), r["known"])), strict=True):
                    col.append(x)
            kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int32, np.int64, np.int32, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, k), *c]).astype(k)) for c, k in zip(out, kinds, strict=True)], names="doc_id mark seg pos n core core_chk h chk known".split())

    return run


def _hashes(length: int):
    """Each window's hash, of blocks (pos, n, known) of segments: (doc_id, mark, seg, bytes, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[np.zeros(0, k)] for k in (np.int64, np.int32, np.int64, np.int64, np.int32, bool)]
            for r in b.to_pylist():
                roll = Rolling(np.frombuffer(r["bytes"], np.uint8))
                for w in r["wanted"]:
                    at = np.arange(w["n"]) + w["pos"] - r["seg"]
                    for col, x in zip(cols, (*roll.of(at, at + length), np.full(len(at), r["doc_id"]), np.full(len(at), r["mark"]), (at + r["seg"]).astype(np.int32), np.full(len(at), w["known"])), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names="h chk doc_id mark pos known".split())

    return run


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _blocks(batch):
                rows = []
                for t, found in zip(texts(b), b.column(2).to_pylist(), strict=True):
                    spans: list[list[int]] = []
                    for s, e in sorted((x["pos"], x["pos"] + x["n"] + length - 1) for x in found or ()):
                        if spans and s <= spans[-1][1]:
                            spans[-1][1] = max(e, spans[-1][1])
                        else:
                            spans.append([s, min(e, len(t))])
                    edges = [0, *(x for s in spans for x in s), len(t)]
                    kept = b"".join(t[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_text)
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) and with with_text kept (bytes)."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    docs = with_mark(keyed_text(docs, id_col, text_col))
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    segs = scratch.write(some.mapInArrow(_segments(length, gram), "name long, h long, chk int, doc_id long, mark long, pos int, n int, inner boolean"), "segs")
    kinds = scratch.write(segs.groupBy("name", "h", "chk", "n").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "mark", "pos")).alias("first"), F.max("inner").alias("inner")), "kinds")
    copied = kinds.where("copies > 1").select("h", "chk", "n")
    # phrases that are equal
    equal = _matching(segs.select("h", "chk", "n", "doc_id", "mark", "pos"), copied, ["h", "chk", "n"]).select("doc_id", "mark", "pos", "n")
    equal = scratch.write(equal, "equal")
    scratch.drop("segs")
    # different phrases of one name
    names = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.max(F.expr("inner AND copies = 1")).alias("inner")).where("kinds > 1 OR inner").select("name", "kinds")
    fine = skew_join(kinds.select("name", "first", "n", (F.col("copies") > 1).alias("known")), names, "name")
    fine = fine.select("first.doc_id", "first.mark", F.struct("name", "first.pos", "n", "known", (F.col("kinds") > hot).alias("wide")).alias("w"))
    fine = fine.groupBy("doc_id", "mark").agg(F.collect_list("w").alias("wanted"))
    parts = some.join(fine, ["doc_id", "mark"]).select("doc_id", "text", "mark", "wanted").mapInArrow(_extract(length), "name long, doc_id long, mark long, pos int, n int, known boolean, wide boolean, bytes binary")
    parts = scratch.write(parts, "parts")
    scratch.drop("kinds")
    total = parts.where("NOT wide").agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))
    merged = parts.where("NOT wide").dropDuplicates(["doc_id", "mark", "pos", "n", "name"]).groupBy(F.pmod(F.xxhash64("name"), F.lit(buckets)).alias("bucket")).applyInArrow(_bucket(length), "doc_id long, mark long, pos int, n int")
    wide = _hot_repeats(parts.where("wide"), length, gram, scratch)
    spans = scratch.write(equal.unionByName(merged).unionByName(wide).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("pos", "n")).alias("found")), "spans")
    scratch.drop("equal", "parts", "wide", "blocks", "live", "wholes")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return docs.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "found").mapInArrow(_cut(length, with_text), schema)


def _hot_repeats(parts: DataFrame, length: int, gram: int, scratch: Scratch) -> DataFrame:
    """(doc_id, mark, pos, n) of the windows that repeat in segments of hot names: whole blocks, then the single
    windows of blocks whose core repeats while the whole doesn't (one copy of each whole beside them)."""
    blocks = scratch.write(parts.mapInArrow(_stretches(length, gram), "doc_id long, mark long, seg int, pos int, n int, core long, core_chk int, h long, chk int, known boolean"), "blocks")
    cores = blocks.groupBy(F.col("core").alias("h"), F.col("core_chk").alias("chk")).count().where("count > 1").select("h", "chk")
    by_core = blocks.select("doc_id", "mark", "seg", "pos", "n", F.col("core").alias("h"), F.col("core_chk").alias("chk"), "known", F.struct("h", "chk").alias("whole"))
    live = scratch.write(_matching(by_core, cores, ["h", "chk"]).select("doc_id", "mark", "seg", "pos", "n", "whole.h", "whole.chk", "known"), "live")
    sizes = live.groupBy("h", "chk", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "mark", "seg", "pos")).alias("first"))
    sizes = scratch.write(sizes, "wholes")
    whole = _matching(live.where("NOT known"), sizes.where("c > 1").select("h", "chk", "n"), ["h", "chk", "n"]).select("doc_id", "mark", "pos", "n")
    alone = _matching(live, sizes.where("c = 1").select("h", "chk", "n"), ["h", "chk", "n"]).select("doc_id", "mark", "seg", "pos", "n", "known")
    one = sizes.where("c > 1").select("first.*", "n", F.lit(True).alias("known"))
    wanted = alone.unionByName(one).groupBy("doc_id", "mark", "seg").agg(F.collect_list(F.struct("pos", "n", "known")).alias("wanted"))
    rows = parts.select("doc_id", "mark", F.col("pos").alias("seg"), "bytes").dropDuplicates(["doc_id", "mark", "seg"]).join(wanted, ["doc_id", "mark", "seg"])
    rows = rows.select("doc_id", "mark", "seg", "bytes", "wanted")
    windows = scratch.write(rows.mapInArrow(_hashes(length), "h long, chk int, doc_id long, mark long, pos int, known boolean"), "wide")
    often = windows.groupBy("h", "chk").agg(F.count("*").alias("c")).where("c > 1").select("h", "chk")
    single = _matching(windows.where("NOT known").select("h", "chk", "doc_id", "mark", "pos"), often, ["h", "chk"]).select("doc_id", "mark", "pos", F.lit(1).alias("n"))
    return whole.unionByName(single)


def _matching(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among the keys; hot ones are told by broadcast."""
    hot = rows.sparkSession.createDataFrame(hot_keys(rows, "h").collect(), rows.select("h").schema)
    few = F.broadcast(keys.join(F.broadcast(hot), "h", "left_semi"))
    return rows.join(few, on, "left_semi").unionByName(rows.join(F.broadcast(hot), "h", "left_anti").join(keys, on, "left_semi"))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
