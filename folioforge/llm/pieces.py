"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch, a word being white space and what follows it, are joined to one text, of which a suffix array
is built. Every piece of the vocabulary is searched in it by bisection; its range holds all its occurrences, which
are the edges of the words' lattices. Edges are sorted by position, and relaxed best score first: two neighbouring
symbols join if an edge spans both, the best edge of each word at a time, leftmost first, as byte-pair merging asks.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import bytes_of, read, row_blocks, text_column

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words longer than this are relaxed one by one with a heap; characters indexed at once; words remembered by a task.
LONG, INDEXED, REMEMBERED = 48, 600_000, 800_000
#: Bytes of text encoded at once: fewer would search all pieces more often.
AT_ONCE = 2 << 20
_LOADED: dict = {}


class Vocabulary:
    """Pieces, scores and byte ids of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = [sp.id_to_piece(i) for i in plain]
        self.ids = np.array(plain, np.int32)
        self.score = np.array([sp.get_score(i) for i in plain], np.float64)
        self.longest = max(map(len, self.text))
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.one = {t: i for t, i in zip(self.text, plain) if len(t) == 1}
        # For decoding: the bytes of every id, white space as such.
        raw = [b""] * n
        for i, t in zip(plain, self.text):
            raw[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.padded = np.array(self.text, dtype=f"<U{self.longest + 1}")
        self.above = np.array([t + "\U0010ffff" for t in self.text], dtype=f"<U{self.longest + 1}")


def vocabulary(model: str = MODEL) -> Vocabulary:
    if model not in _LOADED:
        _LOADED[model] = Vocabulary(model)
    return _LOADED[model]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first depth codes at least, by prefix doubling."""
    rank, width = codes.astype(np.int64) + 1, 1
    order = np.argsort(rank)
    while width < depth:
        second = np.zeros(len(rank), np.int64)
        second[: max(0, len(rank) - width)] = rank[width:]
        key = rank * (rank.max() + 1) + second
        order = np.argsort(key)
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[order][1:] != key[order][:-1]]))
        width *= 2
    return order


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[k] .. starts[k] + lengths[k] - 1 of all k, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else starts, lengths)
    return np.arange(total) + shift


def lattice(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start of each word in the joined text, and the edges: keys start * 64 + length in order, scores, piece ids."""
    text = "\0".join(words) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    order = suffix_array(codes, vocab.longest)
    width = vocab.longest + 1
    padded = np.concatenate([codes, np.zeros(width, np.uint32)])
    window = np.lib.stride_tricks.sliding_window_view(padded, width)[order]
    suffixes = np.ascontiguousarray(window).view(f"<U{width}").ravel()
    lo, hi = np.searchsorted(suffixes, vocab.padded), np.searchsorted(suffixes, vocab.above)
    # A piece's range also ends where its own text ends: compare with it followed by the last code point.
    found = gather(lo, hi - lo)
    piece = np.repeat(np.arange(len(lo)), hi - lo)
    start = order[found]
    lengths = np.array([len(t) for t in vocab.text])[piece]
    key = start * 64 + lengths
    by = np.argsort(key)
    begins = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]])
    return begins, key[by], vocab.score[piece[by]], vocab.ids[piece[by]]


def relax_long(a: int, n: int, edge: dict[int, tuple[float, int]]) -> list[tuple[int, int]]:
    """(start, length) of the symbols of one word, by a heap."""
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    size = [1] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (e := edge.get((a + i) * 64 + size[i] + size[j] if size[i] + size[j] < 64 else -1)):
            heapq.heappush(heap, (-e[0], i, size[i], size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, si, sj = heapq.heappop(heap)
        j = right[i]
        if size[i] != si or j >= n or size[j] != sj:
            continue
        size[i] += sj
        size[j] = 0
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    out, i = [], 0
    while i < n:
        out.append((a + i, size[i]))
        i = right[i]
    return out


def segment(words: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """The ids of each word."""
    begins, keys, scores, ids = lattice(words, vocab)
    sizes = np.array([len(w) for w in words])
    short = np.flatnonzero(sizes <= LONG)
    # Symbols of all short words, each a (start, length), relaxed together: one join per word and round.
    start = gather(begins[short], sizes[short])
    word = np.repeat(short, sizes[short])
    length = np.ones(len(start), np.int64)
    done_start, done_length, done_word = [], [], []

    def score_of(k: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where(keys[at] == k, scores[at], -np.inf) if len(keys) else np.full(len(k), -np.inf)

    pair = np.full(len(start), -np.inf)
    if len(start) > 1:
        same = word[1:] == word[:-1]
        pair[:-1][same] = score_of(start[:-1][same] * 64 + 2)
    while len(start):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.maximum.reduceat(pair, first)
        per = np.diff(np.append(first, len(start)))
        alive = np.repeat(best > -np.inf, per)
        if not alive.all():
            done_start.append(start[~alive])
            done_length.append(length[~alive])
            done_word.append(word[~alive])
            start, length, word, pair = start[alive], length[alive], word[alive], pair[alive]
            if not len(start):
                break
            best, per = best[best > -np.inf], per[best > -np.inf]
            first = np.concatenate([[0], np.cumsum(per)[:-1]])
        hit = np.flatnonzero(pair == np.repeat(best, per))
        hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
        length[hit] += length[hit + 1]
        keep = np.ones(len(start), bool)
        keep[hit + 1] = False
        at = np.cumsum(keep) - 1
        start, length, word, pair = start[keep], length[keep], word[keep], pair[keep]
        touched = at[hit]
        for t in (touched, touched - 1):
            t = t[t >= 0]
            mate = np.minimum(t + 1, len(word) - 1)
            fits = (t + 1 < len(word)) & (word[mate] == word[t]) & (length[t] + length[mate] < 64)
            pair[t] = np.where(fits, score_of(start[t] * 64 + length[t] + length[mate]), -np.inf)
    spans = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_word, done_start, done_length)]
    far = np.flatnonzero(sizes > LONG)
    if len(far):
        edge = {}
        for w in far.tolist():
            lo, hi = np.searchsorted(keys, (begins[w] * 64, (begins[w] + sizes[w]) * 64))
            edge = dict(zip(keys[lo:hi].tolist(), zip(scores[lo:hi].tolist(), ids[lo:hi].tolist())))
            got = np.array(relax_long(int(begins[w]), int(sizes[w]), edge), np.int64)
            spans = [np.concatenate([s, x]) for s, x in zip(spans, (np.full(len(got), w), got[:, 0], got[:, 1]))]
    by = np.argsort(spans[1], kind="stable")
    word, start, length = (s[by] for s in spans)
    k = start * 64 + np.minimum(length, 63)
    at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
    known = keys[at] == k if len(keys) else np.zeros(len(k), bool)
    out_id = np.where(known, ids[at] if len(keys) else 0, -1)
    bounds = np.searchsorted(word, np.arange(len(words) + 1))
    out = []
    blank = np.flatnonzero(~known)
    has_blank = np.zeros(len(words), bool)
    has_blank[word[blank]] = True
    for w, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        own = out_id[a:b]
        if has_blank[w]:  # characters that no piece has: their bytes
            mixed: list[int] = []
            for i, s in zip(own.tolist(), (start[a:b] - begins[w]).tolist()):
                mixed.extend([i] if i >= 0 else vocab.byte[list(words[w][s].encode())].tolist())
            own = np.array(mixed, np.int32)
        out.append(own.astype(np.int32))
    return out


def encoder_of(model: str) -> "Encoder":
    """One encoder per worker process, so that tasks that follow each other share the words."""
    if ("encoder", model) not in _LOADED:
        _LOADED["encoder", model] = Encoder(model)
    return _LOADED["encoder", model]


class Encoder:
    """Ids of texts; words met before, up to REMEMBERED, are not matched again."""

    def __init__(self, model: str = MODEL):
        self.vocab = vocabulary(model)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        flats, sizes = [self.flat], []
        at, size = 0, 0
        for k in range(len(words) + 1):
            if k == len(words) or size > INDEXED:
                if k > at:
                    found = segment(words[at:k], self.vocab)
                    flats.extend(found)
                    sizes.extend(len(f) for f in found)
                at, size = k, 0
            if k < len(words):
                size += len(words[k]) + 1
        for w in words:
            self.index[w] = len(self.index)
        self.flat = np.concatenate(flats)
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(sizes, dtype=np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offsets of each text's."""
        if len(self.index) > REMEMBERED:
            self.forget()
        cut = [WORD.findall(SPACE + t.replace(" ", SPACE).replace("\0", "�")) if t else [] for t in texts]
        new = dict.fromkeys(w for ws in cut for w in ws if w not in self.index)
        if new:
            self.learn(list(new))
        index = self.index
        u = np.array([index[w] for ws in cut for w in ws], np.int64)
        per = np.array([len(ws) for ws in cut], np.int64)
        n = self.off[u + 1] - self.off[u]
        ids = self.flat[gather(self.off[u], n)] if len(u) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.concatenate([[0], np.cumsum(per)])]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """The bytes that the ids of one text stand for, without the space put before the first word."""
    n = vocab.raw_off[ids + 1] - vocab.raw_off[ids]
    out = vocab.raw[gather(vocab.raw_off[ids], n)].tobytes() if len(ids) else b""
    return out[1:] if out.startswith(b" ") else out


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts. Null text counts as empty and has no ids; NUL is read as U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            texts = text_column(batch)
            _, off = bytes_of(texts)
            for a, b in row_blocks(off, AT_ONCE):
                ids, o = encoder.encode(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids count as none; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            texts = [decode_ids(np.array(x or [], np.int64), vocab).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_crc32 and round_trip.

    The ids are decoded again: round_trip says whether that gives the text's bytes. Null text: no ids. Repeated
    rows are rows; columns other than doc_id and text are not looked at; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            texts = text_column(batch)
            data, off = bytes_of(texts)
            for a, b in row_blocks(off, AT_ONCE):
                ids, o = encoder.encode(texts.slice(a, b - a).to_pylist())
                rows = []
                for k in range(b - a):
                    own = ids[o[k] : o[k + 1]]
                    back = decode_ids(own, encoder.vocab)
                    rows.append((len(own), zlib.crc32(own.astype("<u4").tobytes()), zlib.crc32(back), back == data[off[a + k] : off[a + k + 1]].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLE: dict = {}
