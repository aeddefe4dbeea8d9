"""Token counts: map-side two-tier lookup of pre-token lengths, without any shuffle of pre-tokens.

The model is a sentencepiece BPE. A space is the mark that opens a piece, and no piece of such a
vocabulary has the mark after another character (checked when the model is loaded), so merges never
cross from a word into the next word's marks: a text's count is the sum over its pre-tokens (a run of
spaces and the word behind it). Where a vocabulary breaks that rule, whole texts are encoded.

Tier one is a broadcast table of the corpus's frequent pre-tokens and their lengths. It is found by
one pass that keeps a bounded Misra-Gries summary in each task; only the summaries (at most `per_task`
rows a task) meet. Every pre-token is counted in that pass; the table (`table_size` rows of at most
`max_chars` characters) is only a cache, so what it holds decides speed and never a count. Tier two
encodes misses with the library and keeps them in the worker's bounded cache.

Defined cases: null and empty texts have no tokens; repeated rows are counted row by row.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
TABLE_SIZE, PER_TASK, MAX_CHARS, CACHE = 16384, 1024, 32, 300_000
_MARK = "▁"
_PRE = re.compile(" *[^ ]+| +")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokens(text: str) -> list[str]:
    """Without the one space that every pre-token opens with (the model adds it to the first)."""
    if not text:
        return []
    if _MARK in text:
        text = text.replace(_MARK, " ")
    if "  " in text or text[-1] == " " or text[0] == " ":
        return [x[1:] for x in _PRE.findall(" " + text)]
    return text.split(" ")


_models: dict[str, tuple] = {}


def model(path: str) -> tuple:
    """(processor, whether pre-tokens are independent); one of each in a worker."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        free = all(_MARK not in sp.id_to_piece(i).lstrip(_MARK) for i in range(sp.get_piece_size()))
        _models[path] = sp, free and sp.encode("a b") == sp.encode("a") + sp.encode("b")
    return _models[path]


def prune(counts: Counter, keep: int) -> None:
    """Misra-Gries: take the (keep+1)-th largest count from all and drop what is used up."""
    if len(counts) > keep:
        cut = sorted(counts.values(), reverse=True)[keep]
        for k in [k for k, v in counts.items() if v <= cut]:
            del counts[k]
        for k in counts:
            counts[k] -= cut


def frequent_pretokens(docs: DataFrame, table_size: int = TABLE_SIZE, per_task: int = PER_TASK, max_chars: int = MAX_CHARS) -> DataFrame:
    """(pretoken, n): the most frequent pre-tokens of all texts, by merged Misra-Gries summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(pretokens(text or ""))
                if len(counts) > 32 * per_task:
                    prune(counts, 16 * per_task)
        prune(counts, per_task)
        rows = [(k, v) for k, v in counts.items() if len(k) <= max_chars]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())], names=["pretoken", "n"])

    part = docs.select("text").mapInArrow(run, "pretoken string, n long")
    return part.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(table_size)


class _Lengths(dict):
    """Tier two: misses are encoded by the library and kept, up to `most` entries."""

    def __init__(self, first: dict, sp, most: int) -> None:
        super().__init__(first)
        self.first, self.sp, self.most = first, sp, most

    def __missing__(self, pre: str) -> int:
        n = len(self.sp.encode(pre)) if pre else len(self.sp.encode("a ")) - len(self.sp.encode("a"))  # a lone mark
        if len(self) >= self.most:
            self.clear()
            self.update(self.first)
        if len(pre) <= 256:
            self[pre] = n
        return n


_caches: dict[str, _Lengths] = {}


def worker_cache(key: str, first, sp, most: int) -> _Lengths:
    """One cache in a worker, kept from task to task of the same job."""
    if key not in _caches:
        _caches.clear()
        _caches[key] = _Lengths(first.value, sp, most)
    return _caches[key]


def count_tokens(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text", limit: int = LIMIT, table_size: int = TABLE_SIZE, cache: int = CACHE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row a document."""
    path, docs = path or model_path(), keyed_text(docs, id_col, text_col)
    sp, free = model(path)
    lengths = {r[0]: _Lengths({}, sp, 10)[r[0]] for r in frequent_pretokens(docs, table_size).collect()} if free else {}
    shared = docs.sparkSession.sparkContext.broadcast(lengths)
    run_id = f"{uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, free = model(path)
        get = worker_cache(run_id, shared, sp, cache).__getitem__
        for b in batches:
            got = b.column(1).to_pylist()
            size = [len(x.encode()) if x else 0 for x in got]
            n = [sum(map(get, pretokens(x))) if free else len(sp.encode(x)) for x in (x or "" for x in got)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return count_tokens(table(spark, sf_dir, "documents"))
