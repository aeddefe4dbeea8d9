"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

Encoding. A merge list decides each token by what stands to its left and by a bounded stretch to its
right: whether rule (a, b) fires at a place can only be upset from the right if some right edge of b,
before it is consumed, is taken by a rule of higher priority with what follows, and so on; priorities
rise strictly along such a chain. `lookahead` follows all chains through the merge list (a dynamic
programme in order of rank) and gives the number of symbols behind a token after which it is stable.
The transducer holds a buffer of a few lookaheads, merges it, emits the tokens that end a lookahead
before its end, and reads on; so its memory does not grow with the text. A text is normalised and cut
into words slice by slice (slices end at a blank or line feed, which nothing composes with), so beside the
text itself only a slice, or a longer run without blanks, is held.

Decoding. A state machine over bytes takes token by token: bytes go to an incremental UTF-8 state that
emits characters once complete; a word-end mark emits a space before the next token's first byte.

The file's normaliser (NFC, white space, lower case), split pattern, word-end suffix and special
strings are followed as the library has them. `decode` with the file's decoder unset joins token
strings by one space, as the library does; `restore` gives the text through the byte machine.

Defined cases: null and empty texts have no tokens and decode to the empty text; very long words go
through the bounded buffer; repeated rows are encoded row by row.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import begin, keyed_text, table, worker_cache

TOKENIZER = "word_bpe_49k.json"
CACHE, BLOCK = 240_000, 4096
_SPACE = "\t-\r \x85\xa0  -     　"
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split() takes these as white space, the pattern doesn't


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable Latin-1, else 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Merges:
    """Merge list, vocabulary, and the lookahead after which a token is stable."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], suffix: str = "</w>") -> None:
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.vocab, self.suffix = vocab, suffix
        self.lookahead = self._lookahead(merges)

    def _size(self, symbol: str) -> int:
        return len(symbol.removesuffix(self.suffix)) if self.suffix else len(symbol)

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        made: dict[str, tuple[int, str, str]] = {}
        ranks: dict[str, list[int]] = {}  # by left symbol: ranks of its rules ...
        reach: dict[str, list[int]] = {}  # ... and the farthest that any of them so far looks

        def far(symbol: str, before: int) -> int:
            at = bisect.bisect_left(ranks.get(symbol, ()), before)
            return reach[symbol][at - 1] if at else 0

        def edge(symbol: str, before: int) -> int:
            """How far right of `symbol` lies what can upset it, or a right edge of it while it is made."""
            most = far(symbol, before)
            while symbol in made:
                before, _, symbol = made[symbol]
                most = max(most, far(symbol, before))
            return most

        for i, (a, b) in enumerate(merges):
            x = self._size(b) + edge(b, i)
            ranks.setdefault(a, []).append(i)
            seen = reach.setdefault(a, [])
            seen.append(max(x, seen[-1] if seen else 0))
            made.setdefault(a + b, (i, a, b))
        return max([1, *(edge(s, len(merges)) for s in {*made, *ranks})])

    def merge(self, symbols: list[str]) -> list[str]:
        """The merge list applied to a short run: lowest rank first, leftmost first."""
        rank = self.rank.get
        none = len(self.rank)
        s = symbols
        r = list(map(rank, zip(s, s[1:]), repeat(none)))
        while r:
            low = min(r)
            if low == none:
                break
            i = r.index(low)
            s[i : i + 2] = [s[i] + s[i + 1]]
            del r[i]
            if i < len(r):
                r[i] = rank((s[i], s[i + 1]), none)
            if i:
                r[i - 1] = rank((s[i - 1], s[i]), none)
        return s

    @property
    def hold(self) -> int:
        """The symbols that the buffer holds."""
        return 4 * self.lookahead + 16

    def stream(self, symbols: Iterator[str]) -> Iterator[str]:
        """Tokens of a run of any length; at most a few lookaheads of symbols are held. A run that ends within
        the buffer is merged at once."""
        hold, buffer = self.hold, []
        while True:
            buffer += islice(symbols, hold - len(buffer))
            if len(buffer) < hold:
                yield from self.merge(buffer)
                return
            done, stable = 0, len(buffer) - self.lookahead
            for token in self.merge(buffer.copy()):
                if done + self._size(token) > stable:
                    break
                done += self._size(token)
                yield token
            del buffer[:done]


class ByteText:
    """Decoder state: pending bytes of a character, and whether a word has just ended."""

    def __init__(self, piece: dict[str, bytes], suffix: str) -> None:
        self.piece, self.suffix = piece, suffix
        self.utf8, self.gap = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, token: str) -> str:
        out = (self.utf8.decode(b"", True) + " " if self.gap else "") + self.utf8.decode(self.piece[token])
        self.gap = token.endswith(self.suffix)
        return out

    def special(self, content: str) -> str:
        out = self.utf8.decode(b"", True) + " " * self.gap + content
        self.gap = True
        return out

    def end(self) -> str:
        self.gap = False
        return self.utf8.decode(b"", True)


class Codec:
    """Encoder and decoder of one tokenizer file of byte-level BPE with word ends."""

    def __init__(self, path: str) -> None:
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["end_of_word_suffix"] is None or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("only byte-level BPE with word ends, without decoder, is supported")
        self.merges = Merges([tuple(m) for m in model["merges"]], model["vocab"], model["end_of_word_suffix"])
        self.vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens = {i: t for t, i in (*self.vocab.items(), *self.specials.items())}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}"))
        self.chunks = re.compile(f"[^{_SPACE}]+")
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.spelled = {b: c for b, c in enumerate(self.letters) if c != chr(b)}
        self._known: dict[str, tuple[tuple[int, ...], str]] = {}
        self._old: dict[str, tuple[tuple[int, ...], str]] = {}
        self._short: dict[str, tuple[int, ...]] = {}
        self._rare: dict[str, tuple[int, ...]] = {}
        self.piece = {t: bytes(self.bytes_of[c] for c in t.removesuffix(self.merges.suffix)) for t in self.vocab}
        # by id: its digits, its token, its bytes with the space behind a word's end
        self.ends = {i for i, t in self.tokens.items() if t in self.specials or t.endswith(self.merges.suffix)}
        self.digits = {i: str(i).encode() for i in self.tokens}
        self.names = {i: t.encode() for i, t in self.tokens.items()}
        self.spaced = {i: (t.encode() if t in self.specials else self.piece[t]) + b" " * (i in self.ends) for i, t in self.tokens.items()}

    def symbols(self, word: str) -> Iterator[str]:
        data = word.encode()
        for b in data[:-1]:
            yield self.letters[b]
        yield self.letters[data[-1]] + self.merges.suffix

    def word_tokens(self, word: str) -> Iterator[str]:
        return self.merges.stream(self.symbols(word))

    def slices(self, text: str, most: int = 1 << 16) -> Iterator[str]:
        """The special strings of a text and what lies between them, in slices of about `most` characters that
        end before a blank or line feed."""
        last = 0
        cuts = [(m.start(), m.end()) for m in self.special_re.finditer(text)] if "<|" in text else []
        for start, stop in (*cuts, (len(text), len(text))):
            while start - last > most:
                end = max(text.rfind(" ", last + 1, last + most), text.rfind("\n", last + 1, last + most))
                if end < 0:
                    end = min((x for x in (text.find(" ", last + most, start), text.find("\n", last + most, start)) if x >= 0), default=start)
                yield text[last:end]
                last = end
            if last < start:
                yield text[last:start]
            if start < stop:
                yield text[start:stop]
            last = stop

    def normal_chunks(self, text: str) -> list[str]:
        """Runs without white space of a normalised slice."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letter by letter, so no final sigma
                text = text.replace("Σ", "σ")
        text = text.lower()
        return self.chunks.findall(text) if _ODD_SPACE.search(text) else text.split()

    def encode(self, text: str) -> Iterator[tuple[int, str]]:
        """(id, token) in order; nothing is held but the current chunk's buffer."""
        for part in self.slices(text):
            if part in self.specials:
                yield self.specials[part], part
                continue
            for chunk in self.normal_chunks(part):
                for word in self.words.finditer(chunk):
                    for token in self.word_tokens(word[0]):
                        yield self.vocab[token], token

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with the file's decoder unset: token strings joined by one space."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def restore(self, ids: list[int]) -> str:
        """The text through the byte machine: words separated by one space."""
        state, out = ByteText(self.piece, self.merges.suffix), []
        for i in ids:
            token = self.tokens[i]
            out.append(state.special(token) if token in self.specials else state.feed(token))
        return "".join(out) + state.end()

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word through the transducer; those of short words are kept while they recur."""
        got = self._short.get(word)
        if got is None:
            got = self._rare.get(word)
            if got is None:
                data = word.encode()
                if len(data) < self.merges.hold:  # spelled in one go
                    run = list(data.decode("latin-1").translate(self.spelled))
                    run[-1] += self.merges.suffix
                    got = tuple(map(self.vocab.__getitem__, self.merges.stream(iter(run))))
                else:
                    got = tuple([self.vocab[t] for t in self.word_tokens(word)])
            if len(word) <= 64:
                if len(self._short) >= CACHE:
                    self._rare, self._short = self._short, {}
                self._short[word] = got
        return got

    def _chunk(self, chunk: str) -> tuple[tuple[int, ...], str]:
        """(ids, words joined by a space) of a run without white space."""
        got = self._old.get(chunk)
        if got is None:
            words = (chunk,) if chunk.isascii() and chunk.isalpha() else self.words.findall(chunk)
            if len(words) == 1:
                got = self._word(words[0]), words[0]
            else:
                got = tuple([i for w in words for i in self._word(w)]), " ".join(words)
        if len(chunk) <= 64:
            if len(self._known) >= CACHE:
                self._old, self._known = self._known, {}
            self._known[chunk] = got
        return got

    def emitted(self, text: str, most: int = BLOCK) -> Iterator[tuple[list[int], str]]:
        """(ids, the words they stand for joined by a space) in order, in blocks that end once `most` ids are full."""
        ids, words, known = [], [], self._known.get
        for part in self.slices(text):
            if part in self.specials:
                ids.append(self.specials[part])
                words.append(part)
                continue
            for c in self.normal_chunks(part):
                got = known(c) or self._chunk(c)
                if got[0]:
                    ids += got[0]
                    words.append(got[1])
                    if len(ids) >= most:
                        yield ids, " ".join(words)
                        ids, words = [], []
        if ids:
            yield ids, " ".join(words)

    def digest(self, text: str, with_ids: bool = True) -> tuple[int, str, str, bool, list[int]]:
        """(tokens, SHA-256 of the ids, SHA-256 of the decoded text, restored, ids if asked for). What is decoded
        and restored comes from the emitted ids alone; restored tells whether it is the text's words."""
        n, out, coded, decoder, restored, gap = 0, [], hashlib.sha256(), Decoder(self), True, ""
        for ids, words in self.emitted(text):
            coded.update(gap.encode() + b" ".join([self.digits[i] for i in ids]))
            restored &= decoder.feed(ids) == gap + words
            n += len(ids)
            if with_ids:
                out += ids
            gap = " "
        return n, coded.hexdigest(), decoder.decoded.hexdigest(), restored and not decoder.end(), out


class Decoder:
    """Incremental decoder of ids: a hash of the library's decode so far, and the byte machine's text. Its
    state is that of ByteText (pending bytes, whether a word has just ended), block by block."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.decoded, self.first, self.gap = codec, hashlib.sha256(), True, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        """The text that is complete after these ids."""
        c = self.codec
        self.decoded.update(b" " * (not self.first) + b" ".join([c.names[i] for i in ids]))
        data = b" " * self.gap + b"".join([c.spaced[i] for i in ids])
        self.first, self.gap = False, ids[-1] in c.ends
        return self.utf8.decode(data[: len(data) - self.gap])

    def end(self) -> str:
        return self.utf8.decode(b"", True)


_codecs: dict[str, Codec] = worker_cache("bpe_codec")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids array<int>) of whole texts."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe_codec")
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                ids = [[i for i, _ in c.encode(t or "")] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(doc_id, decoded, restored): the library's decode, and the text of the byte machine."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe_codec")
        c = codec(path)
        for b in batches:
            ids = [x or [] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x) for x in ids], pa.string()), pa.array([c.restore(x) for x in ids], pa.string())], names=["doc_id", "decoded", "restored"])

    return encoded.select(id_col, ids_col).mapInArrow(run, "doc_id long, decoded string, restored string")


def digests(docs: DataFrame, path: str | None = None, id_col="doc_id", text_col="text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, restored) and with with_ids ids of whole texts, by one
    pass that keeps the transducer's results of recent chunks (bounded)."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe_codec")
        c = codec(path)
        for batch, at in ((x, k) for x in batches for k in range(0, x.num_rows, 500)):
            b = batch.slice(at, 500)
            rows = [c.digest(t or "", with_ids) for t in b.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            if with_ids:
                flat = np.concatenate([np.array(r[4], np.int32) for r in rows])
                ends = np.cumsum([0, *(r[0] for r in rows)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "restored", *["ids"] * with_ids])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, restored boolean" + ", ids array<int>" * with_ids)


def op5_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
