"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word (white space around, ASCII punctuation at its ends taken off, lower case) enters as [its word
embedding, the mean of its character n-gram embeddings, two evidence values]: the log-odds of the word
and the largest log-odds among its character n-grams (word ends marked), counted on the training
sample. A training text meets the log-odds without its own share, so evidence is as reliable there as
on new texts. Windows of WINDOW words start every STRIDE words over the whole text; a text's logit is
its highest window's (the window that training learns from, too). The logit is shifted from the
sample's balance to that of all labelled rows.

Training sample: at most `per_class` labelled documents of each class (in the order of a hash of their
id), a fixed bound on what the task that trains holds; the driver gets the parameters. `labels` gives the
classes and nothing else enters.

Defined cases: null, empty and wordless texts score 0; labels that are null or name
no document teach nothing, a document labelled twice counts as its higher label; without any label of
one class the score is that class's absence (0.0 or 1.0 for all); repeated rows score alike.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import begin, keyed_text, strings, table, worker_cache

WINDOW, STRIDE, HIDDEN, DIM = 48, 24, 8, 6
WORDS, GRAMS, EVIDENCE, LENGTHS = 1 << 13, 1 << 15, 1 << 20, (3, 5, 7)
PER_CLASS, EPOCHS, LEAST_STEPS, BATCH, RATE = 1500, 12, 200, 64, 0.01
THRESHOLD = 0.3
CACHE = 150_000
PIECE = 1 << 13
SIZE = 2 * DIM + 2


def words_of(text: str) -> list[str]:
    return text.lower().split()


def starts(n: int) -> np.ndarray:
    """First words of the windows over n words; the last window reaches the end."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Coded:
    """Hashes of words and of their n-grams (bytes of ^word$), laid end to end."""

    def __init__(self, words: list[str]) -> None:
        parts = [self._piece(words[k : k + PIECE]) for k in range(0, max(1, len(words)), PIECE)]
        self.word, self.grams, self.size = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.cut = np.cumsum(self.size) - self.size

    @staticmethod
    def _piece(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word hashes, n-gram hashes, n-grams of each word) of some words; what it takes is bounded by PIECE."""
        marked = [b"^" + w.strip(_PUNCTUATION).encode() + b"$" for w in words]
        size = np.array([len(w) for w in marked], np.int64)
        text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
        begin = np.cumsum(size) - size
        word = np.array([zlib.crc32(w) & (EVIDENCE - 1) for w in marked], np.int64)
        owner, of, at = np.repeat(np.arange(len(words)), size), [], []
        last = np.repeat(begin + size, size)
        for k in LENGTHS:
            n = len(text) - k + 1
            if n <= 0:
                continue
            h = np.full(n, k, np.uint32)
            for j in range(k):
                h = (h ^ text[j : j + n]) * np.uint32(0x01000193)
            ok = np.arange(n) + k <= last[:n]
            of.append(owner[:n][ok])
            at.append(((h ^ (h >> 15)) & np.uint32(EVIDENCE - 1))[ok].astype(np.int64))
        short = np.flatnonzero(size < min(LENGTHS))  # the empty word has no n-gram of its own
        of.append(short)
        at.append(np.zeros(len(short), np.int64))
        of, at = np.concatenate(of), np.concatenate(at)
        order = np.argsort(of, kind="stable")
        return word, at[order].astype(np.int32), np.bincount(of, minlength=len(words))

    def evidence(self, word_lo: np.ndarray, gram_lo: np.ndarray) -> np.ndarray:
        return np.stack([word_lo[self.word], np.maximum.reduceat(gram_lo[self.grams], self.cut)], 1) / np.float32(3)

    def picked(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of some words laid end to end, and where each begins."""
        size = self.size[rows]
        cut = np.cumsum(size) - size
        return self.grams[np.repeat(self.cut[rows] - cut, size) + np.arange(size.sum())], cut

    def embedded(self, p: dict, rows: np.ndarray) -> np.ndarray:
        flat, cut = self.picked(rows)
        chars = np.add.reduceat(p["grams"][flat & (GRAMS - 1)], cut) / self.size[rows][:, None]
        return np.concatenate([p["words"][self.word[rows] & (WORDS - 1)], chars.astype(np.float32)], 1)


_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def log_odds(seen: np.ndarray, n: np.ndarray, own: int | None = None) -> np.ndarray:
    """Of buckets seen[label] in n[label] documents, without one document of the class `own` that holds
    them; what hardly any document holds says nothing."""
    seen = seen.astype(np.float32)
    n = n.astype(np.float32)
    if own is not None:
        seen[own], n[own] = np.maximum(seen[own] - 1, 0), max(n[own] - 1, 0)
    lo = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return np.where(seen.sum(0) >= 2, lo, 0).clip(-6, 6).astype(np.float32)


class Features:
    """Rows of word features by word; at most CACHE words are kept. Row 0 stands for none."""

    def __init__(self, p: dict) -> None:
        self.p, self.known = p, {}
        self.rows = np.zeros((1024, SIZE), np.float32)

    def index(self, words: list[str]) -> np.ndarray:
        fresh = {w for w in words if w not in self.known}
        if len(self.known) + len(fresh) > CACHE and self.known:
            self.known, fresh = {}, set(words)
        if fresh:
            at, fresh = len(self.known) + 1, sorted(fresh)
            need = at + len(fresh)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), SIZE), np.float32)])
            coded = Coded(fresh)
            self.rows[at:need] = np.concatenate([coded.embedded(self.p, np.arange(len(fresh))), coded.evidence(self.p["word_lo"], self.p["gram_lo"])], 1)
            self.known.update(zip(fresh, range(at, need), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def fresh_parameters(word_lo, gram_lo, seed: int = 7) -> dict:
    r = np.random.default_rng(seed)
    f = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
    p = {"words": f(WORDS, DIM, k=0.05), "grams": f(GRAMS, DIM, k=0.05), "word_lo": word_lo, "gram_lo": gram_lo, "att": f(2 * HIDDEN, 2 * HIDDEN), "query": f(2 * HIDDEN), "out": f(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"w{d}": f(SIZE, 3 * HIDDEN), f"u{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def recur(p: dict, d: str, gates: np.ndarray, idx: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States [T, B, H] of one direction. gates: rows of input projections; idx [T, B]: row, 0 for none
    (the state then stays). keep: gets what the way back needs."""
    steps, n = idx.shape
    h, out, u = np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, HIDDEN), np.float32), p[f"u{d}"]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = gates[idx[t]]
        zr = sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
        on = (idx[t] > 0)[:, None]
        new = np.where(on, h + z * (c - h), h)
        if keep is not None:
            keep.append((t, h, z, r, c, on))
        h = out[t] = new
    return out


def pooled(p: dict, h: np.ndarray, idx: np.ndarray):
    """Attention over the words: (logit, weights [T, B], tanh part, context)."""
    a = np.tanh(h @ p["att"])
    s = np.where(idx > 0, a @ p["query"], -1e9)
    w = np.exp(s - s.max(0))
    w = np.where(idx > 0, w, 0)
    w /= np.maximum(w.sum(0), 1e-9)
    ctx = (w[:, :, None] * h).sum(0)
    return ctx @ p["out"] + p["bias"][0], w, a, ctx


def logits(p: dict, rows: np.ndarray, idx: np.ndarray, block: int = 4096) -> np.ndarray:
    """Of windows idx [B, T] of feature rows."""
    used, back = np.unique(idx, return_inverse=True)
    x, small = rows[used], back.reshape(idx.shape)
    if used[0] != 0:  # row 0 has to stand for none
        x, small = np.concatenate([np.zeros((1, SIZE), np.float32), x]), small + 1
    gates = {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"}
    out = [np.zeros(0, np.float32)]
    for k in range(0, len(small), block):
        i = np.ascontiguousarray(small[k : k + block].T)
        out.append(pooled(p, np.concatenate([recur(p, d, gates[d], i) for d in "fb"], 2), i)[0])
    return np.concatenate(out)


def windows(index: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(windows [B, T] of rows, document of each) for documents laid end to end."""
    idx, owner, base = [], [], 0
    padded = np.concatenate([index, np.zeros(WINDOW, np.int64)])
    for k, n in enumerate(counts):
        s = starts(n)
        at = s[:, None] + np.arange(WINDOW)
        idx.append(np.where(at < n, padded[np.minimum(base + at, len(padded) - 1)], 0))
        owner.append(np.full(len(s), k))
        base += n
    return np.concatenate(idx), np.concatenate(owner)


def gradient(p: dict, x: np.ndarray, idx: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean cross-entropy over windows idx [T, B] of rows x, and that for x."""
    gates, keeps, hs = {}, {}, {}
    for d in "fb":
        gates[d] = x @ p[f"w{d}"] + p[f"c{d}"]
        hs[d] = recur(p, d, gates[d], idx, keeps.setdefault(d, []))
    h = np.concatenate([hs["f"], hs["b"]], 2)
    logit, w, a, ctx = pooled(p, h, idx)
    dl = (sigmoid(logit) - y) / len(y)
    g = {"out": ctx.T @ dl, "bias": np.array([dl.sum()], np.float32)}
    dctx = dl[:, None] * p["out"]
    dw = (h * dctx).sum(2)
    ds = w * (dw - (w * dw).sum(0))
    da = ds[:, :, None] * p["query"] * (1 - a * a)
    g["query"] = (ds[:, :, None] * a).sum((0, 1))
    g["att"] = np.einsum("tbi,tbj->ij", h, da)
    dh_all = w[:, :, None] * dctx + da @ p["att"].T
    dx = np.zeros_like(x)
    for d, part in (("f", dh_all[:, :, :HIDDEN]), ("b", dh_all[:, :, HIDDEN:])):
        u, dg, du = p[f"u{d}"], np.zeros((*idx.shape, 3 * HIDDEN), x.dtype), np.zeros_like(p[f"u{d}"])
        dh = np.zeros(part.shape[1:], np.float32)
        for t, h0, z, r, c, on in reversed(keeps[d]):
            dh = dh + part[t]
            live = np.where(on, dh, 0)
            dc = live * z * (1 - c * c)
            drh = dc @ u[:, 2 * HIDDEN :].T
            dz, dr = live * (c - h0) * z * (1 - z), drh * h0 * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            du[:, : 2 * HIDDEN] += h0.T @ dzr
            du[:, 2 * HIDDEN :] += (r * h0).T @ dc
            dg[t] = np.concatenate([dzr, dc], 1)
            dh = np.where(on, live * (1 - z) + drh * r + dzr @ u[:, : 2 * HIDDEN].T, dh)
        flat, own = dg.reshape(-1, 3 * HIDDEN), x[idx.ravel()]
        g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = du, own.T @ flat, flat.sum(0)
        np.add.at(dx, idx.ravel(), flat @ p[f"w{d}"].T)
    return g, dx


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> dict:
    """Parameters from labelled texts; the same texts give the same parameters."""
    r = np.random.default_rng(seed)
    number: dict[str, int] = {}
    index = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    coded = Coded([*number, ""])
    total, n = len(number) + 1, np.bincount(y, minlength=2)
    seen = np.zeros((2, EVIDENCE), np.int32), np.zeros((2, EVIDENCE), np.int32)
    for rows, label in zip(index, y, strict=True):
        rows = np.unique(rows)
        seen[0][label, np.unique(coded.word[rows])] += 1
        seen[1][label, np.unique(coded.picked(rows)[0])] += 1
    p = fresh_parameters(log_odds(seen[0], n), log_odds(seen[1], n), seed)
    own = np.concatenate([coded.evidence(log_odds(seen[0], n, k), log_odds(seen[1], n, k)) for k in (0, 1)])
    index = [x + label * total for x, label in zip(index, y, strict=True)]  # a row for each word and own class
    rows_of = lambda used: np.concatenate([np.zeros((1, SIZE), np.float32), np.concatenate([coded.embedded(p, used % total), own[used]], 1)])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items() if k not in ("words", "grams", "word_lo", "gram_lo")}
    step, chosen = 0, [None] * len(index)
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(index) // BATCH)))
    for epoch in range(epochs):
        order = r.permutation(len(index))
        pace = rate * (1 - epoch / epochs)
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            if epoch % 3 == 0:  # which window speaks for each text is settled anew
                used, small = np.unique(np.concatenate([index[i] for i in batch]), return_inverse=True)
                x = rows_of(used)
                idx, owner = windows(small + 1, [len(index[i]) for i in batch])
                score = logits(p, x, idx)
                full = np.concatenate([[-1], used])
                for j, i in enumerate(batch):
                    mine = np.flatnonzero(owner == j)
                    chosen[i] = full[idx[mine[score[mine].argmax()]]]
            best = np.stack([chosen[i] for i in batch])
            used, small = np.unique(np.append(best, -1), return_inverse=True)
            x, used = rows_of(used[1:]), used[1:]
            g, dx = gradient(p, x, np.ascontiguousarray(small[:-1].reshape(best.shape).T), y[batch].astype(np.float32))
            words = used % total
            step += 1
            for name, (m, v) in moments.items():
                m += 0.1 * (g[name] - m)
                v += 0.001 * (g[name] ** 2 - v)
                p[name] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            moved = np.flatnonzero(np.abs(dx[1:]).sum(1) > 0)  # embeddings take plain steps
            flat, _ = coded.picked(words[moved])
            size = coded.size[words[moved]]
            np.add.at(p["words"], coded.word[words[moved]] & (WORDS - 1), -10 * pace * dx[1:][moved, :DIM])
            np.add.at(p["grams"], flat & (GRAMS - 1), np.repeat(-10 * pace * dx[1:][moved, DIM : 2 * DIM] / size[:, None], size, axis=0))
    return p


_features: dict[str, Features] = worker_cache("toxicity")


def worker_features(key: str, p: dict) -> Features:
    if key not in _features:
        _features.clear()
        _features[key] = Features(p)
    return _features[key]


def score_texts(feats: Features, shift: float, got: list[str]) -> np.ndarray:
    docs = [words_of(t) for t in got]
    flat = [w for d in docs for w in d]
    idx, owner = windows(feats.index(flat), [len(d) for d in docs])
    most = np.full(len(docs), -np.inf)
    np.maximum.at(most, owner, logits(feats.p, feats.rows, idx))
    return np.where([len(d) > 0 for d in docs], sigmoid(most + shift), 0.0)


def blocks(got: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in runs of about `most` characters (a longer text alone)."""
    run, size = [], 0
    for t in got:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most per_class documents a class, and the count of each label."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    ids = []
    for label in (0, 1):
        ids += known.where(F.col("y") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    few = spark.createDataFrame(ids, "doc_id long, y int")
    # an id that stands in several rows teaches by its least text, so one row an id is held
    rows = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.select("doc_id", "text", "y"), counts


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, shape, data) of each parameter that a sample (doc_id, text, y) teaches; first the count of each label."""
    begin("toxicity")
    sample = sorted((i, t or "", y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
    y = np.array([r[2] for r in sample], dtype=np.int64).reshape(-1)
    n = np.bincount(y, minlength=2)
    yield pa.RecordBatch.from_pylist([{"name": "", "shape": n.tolist(), "data": b""}], _LEARNT)
    for name, x in (train([r[1] for r in sample], y) if n.all() else {}).items():
        yield pa.RecordBatch.from_pylist([{"name": name, "shape": list(x.shape), "data": x.astype(np.float32).tobytes()}], _LEARNT)


_LEARNT = pa.schema([("name", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.binary())])


def learnt(sample: DataFrame) -> tuple[list[int], dict]:
    """(documents of each label in the sample, parameters). A task trains on the sample, whose size is bounded, so
    the driver holds parameters (about 10 MB) and no texts."""
    rows = {r["name"]: r for r in sample.coalesce(1).mapInArrow(learn, "name string, shape array<long>, data binary").collect()}
    p = {k: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for k, r in rows.items() if k}
    return list(rows[""]["shape"]) if rows else [0, 0], p


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_id="doc_id", label_col="toxic", held_out=None, per_class: int = PER_CLASS, with_row: bool = False) -> DataFrame:
    """(doc_id, score): labels for which `held_out` (a condition on doc_id) holds teach nothing. With
    with_row, all columns of docs and then _score."""
    spark = docs.sparkSession
    mine = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).alias("toxic"))
    if held_out is not None:
        mine = mine.where(~held_out)
    sample, counts = training_sample(keyed_text(docs, id_col, text_col), mine, per_class)
    n, p = learnt(sample)
    both = all(n)
    shift = float(np.log(counts[1] / counts[0]) - np.log(n[1] / n[0])) if both else 0.0
    constant = 1.0 if n[1] and not n[0] else 0.0
    shared, key = spark.sparkContext.broadcast(p), f"{uuid.uuid4()}-{spark.sparkContext.applicationId}"
    del p
    source = docs if with_row else keyed_text(docs, id_col, text_col)
    at = source.columns.index(text_col if with_row else "text")
    name = "_score" if with_row else "score"
    schema = StructType([*source.schema.fields, StructField(name, DoubleType())]) if with_row else "doc_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        feats = worker_features(key, shared.value) if both else None
        for b in batches:
            got = strings(b, at)
            score = np.concatenate([score_texts(feats, shift, x) for x in blocks(got)]) if both and got else np.full(len(got), constant)
            cols = [*b.columns] if with_row else [b.column(0)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score, pa.float64())], names=[*(b.schema.names if with_row else ["doc_id"]), name])

    return source.mapInArrow(run, schema)


def is_held_out(col):
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=is_held_out(F.col("doc_id")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
