"""Encoding and decoding with a SentencePiece BPE model, by vectorised merge rounds.

The result is that of the model's greedy merges: of all neighbouring symbols
whose concatenation is a piece, the pair with the best score is merged, leftmost
first among equal scores, until no pair remains.

* Texts are cut where no piece of the vocabulary can reach across (before blanks
  that follow a non-blank; around characters that occur in no longer piece, such
  as digits and line ends), so merges on both sides do not touch each other.  Of
  a batch's equal parts only one is encoded; the parts are further cut between
  characters that no piece has side by side.  These are the *words*.
* All words' symbols lie in one flat array.  A round takes each word's least
  pair rank (segmented minimum), merges all its pairs of that rank that do not
  overlap, leftmost first, looks up the ranks of the new pairs, and drops
  finished words.  This equals one merge at a time as long as no new pair
  ranks as low as the merged one; the words in which one does (runs of blanks,
  mostly) are finished one merge at a time with a heap, which is exact for any
  word and takes time in proportion to its length, whatever its shape.
* Characters without a piece become their UTF-8 bytes' pieces.

Texts are read where the scan puts them: nothing is shuffled, and a task holds a
chunk of 2 MB or one text if that is longer.  The vocabulary (a megabyte or so, at
most ``MAX_MODEL_BYTES``) is broadcast as the model file's bytes.

NULL counts as the empty text, which has no ids; equal rows give equal ids; NULLs
in other columns are kept; an empty table gives an empty result; result columns
whose names the input has get underscores in front.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .names import col, free_name
from .textops import CHUNK_BYTES, text_buffer

MAX_MODEL_BYTES = 64 << 20
BLANK = "▁"
NEVER = np.int32(2 ** 31 - 1)
# fixed values: kinds of pieces in the model format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


# ------------------------------------------------------------------ vocabulary

def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {5: 4, 1: 8}[kind]
        yield key >> 3, buf[at:at + size]
        at += size


class Vocabulary:
    """Pieces, pair ranks and cut rules of a model file's bytes."""

    def __init__(self, model: bytes):
        pieces, trainer, rules = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only BPE models with byte fallback and blanks in front of words")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only models without text normalisation, user-defined and unused pieces")
        self.prefix = bool(rules.get(3, 1))
        self.size = n = len(pieces)
        self.unknown = trainer.get(44, b" \xe2\x81\x87 ")
        self.kind = np.array([k for _, _, k in pieces], np.int8)
        own = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        if BLANK not in own:
            raise ValueError("the model has no piece for blanks")
        # a character's symbol: its piece, else n + code point
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        for p, i in own.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[0x20] = own[BLANK]
        self.byte = np.zeros(256, np.int64)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
        # rank of a score, 0 the best; equal scores have equal ranks
        scores = np.array([-s for _, s, _ in pieces])
        rank = np.searchsorted(np.unique(scores), scores)
        symbol_of = lambda t: int(self.symbol[ord(t)]) if len(t) == 1 else own.get(t)
        pairs, neighbours, lone = {}, set(), np.ones(128, bool)
        for p, i in own.items():
            for a in range(1, len(p)):
                left, right = symbol_of(p[:a]), symbol_of(p[a:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
                neighbours.add(int(self.symbol[ord(p[a - 1])]) << 32 | int(self.symbol[ord(p[a])]))
            if len(p) > 1:
                for ch in p:
                    if ord(ch) < 128:
                        lone[ord(ch)] = False
        blank = own[BLANK]
        self.cut_blanks = not any(k & 0xFFFFFFFF == blank and k >> 32 != blank for k in neighbours)
        lone[0x20] = False
        self.lone = np.zeros(256, bool)
        self.lone[:128] = lone
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = rank[self.merged].astype(np.int32)
        self.near = np.array(sorted(neighbours), np.int64)
        # decoded bytes of every id
        texts = [b"" if k == CONTROL else self.unknown if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE
                 else p.replace(BLANK, " ").encode() for p, _, k in pieces]
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.text_at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.opens = np.array([k == NORMAL and p.startswith(BLANK) for p, _, k in pieces])

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of symbol pairs; ``NEVER`` where none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.merged[at]


_known: dict[int, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a model, built once a process."""
    key = hash(model)
    if key not in _known:
        _known.clear()
        _known[key] = Vocabulary(model)
    return _known[key]


# ---------------------------------------------------------------------- merges

def spans(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places ``first[i] .. first[i] + sizes[i] - 1`` for all i, in turn."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - sizes), sizes) + np.arange(total)


def _one_by_one(v: Vocabulary, symbols: list[int]) -> list[int]:
    """All merges of one word, the best pair first, leftmost among equals."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    sym = list(symbols)
    rank, new = v.pair(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64))
    heap = [(r, i, sym[i], sym[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), new.tolist())) if r != NEVER]
    heapq.heapify(heap)
    table: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i: int) -> None:
        j = after[i]
        if j < n:
            key = (sym[i], sym[j])
            if key not in table:
                r, m = v.pair(np.array([key[0]], np.int64), np.array([key[1]], np.int64))
                table[key] = int(r[0]), int(m[0])
            r, m = table[key]
            if r != NEVER:
                heapq.heappush(heap, (r, i, sym[i], sym[j], m))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue                           # one of the two is gone
        sym[i], sym[j] = m, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [s for s in sym if s >= 0]


def merge_words(v: Vocabulary, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges in all words at once: flat symbols and each word's first place
    (one more than words) before and after."""
    words = len(first) - 1
    sizes = np.diff(first)
    done_at, done_symbols = [], []             # per step: word numbers with sizes; symbols
    sym, word = symbols, np.repeat(np.arange(words), sizes)
    rank, new = np.full(len(sym), NEVER), np.zeros(len(sym), np.int64)
    if len(sym) > 1:
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], new[inner] = v.pair(sym[inner], sym[inner + 1])
    while len(sym):
        start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.append(start, len(sym)))
        least = np.minimum.reduceat(rank, start)
        idle = least == NEVER
        if idle.any():                         # finished words leave
            out = np.repeat(idle, size)
            done_at.append(np.stack((word[start[idle]], size[idle])))
            done_symbols.append(sym[out])
            stay = ~out
            sym, word, rank, new = sym[stay], word[stay], rank[stay], new[stay]
            size, least = size[~idle], least[~idle]
            if len(sym) == 0:
                break
        best = rank == np.repeat(least, size)
        # of pairs that overlap, every other from the left
        head = best.copy()
        head[1:] &= ~best[:-1]
        places = np.flatnonzero(best)
        since = places - np.maximum.accumulate(np.where(head, np.arange(len(sym)), 0))[places]
        at = places[since % 2 == 0]
        made, bound = new[at], rank[at]
        # would a new pair rank as low, seen when the pairs to the right are still apart?
        n = len(sym)
        right = np.minimum(at + 2, n - 1)
        low = (at + 2 < n) & (word[right] == word[at])
        low[low] = v.pair(made[low], sym[right[low]])[0] <= bound[low]
        merged = sym.copy()
        merged[at] = made
        gone = np.zeros(n, bool)
        gone[at + 1] = True
        left = np.maximum(at - 1, 0)
        left = np.where(gone[left], np.maximum(left - 1, 0), left)
        more = (at > 0) & (word[left] == word[at]) & (left < at)
        more[more] = v.pair(merged[left[more]], made[more])[0] <= bound[more]
        low |= more
        if low.any():                          # these words go on alone
            alone = np.isin(word, np.unique(word[at[low]]))
            begin = np.flatnonzero(alone & np.concatenate(([True], word[1:] != word[:-1])))
            for a in begin.tolist():
                b = a + int(np.searchsorted(word[a:], word[a], side="right"))
                final = _one_by_one(v, sym[a:b].tolist())
                done_at.append(np.array([[word[a]], [len(final)]]))
                done_symbols.append(np.array(final, np.int64))
            stay = ~alone
        else:
            stay = np.ones(n, bool)
        changed = np.zeros(n, bool)
        changed[at] = True
        changed[left[(at > 0)]] = True
        stay &= ~gone
        sym, word, rank, new, changed = merged[stay], word[stay], rank[stay], new[stay], changed[stay]
        where = np.flatnonzero(changed)
        rank[where] = NEVER
        where = where[where + 1 < len(sym)]
        where = where[word[where] == word[where + 1]]
        rank[where], new[where] = v.pair(sym[where], sym[where + 1])
    if not done_at:
        return symbols, first
    done = np.concatenate(done_at, axis=1)
    flat = np.concatenate(done_symbols)
    order = np.argsort(done[0], kind="stable")
    begins = np.concatenate(([0], np.cumsum(done[1])[:-1]))
    counts = np.zeros(words, np.int64)
    counts[done[0]] = done[1]
    return flat[spans(done[1][order], begins[order])], np.concatenate(([0], np.cumsum(counts)))


def _to_bytes(v: Vocabulary, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without a piece replaced by their UTF-8 bytes' pieces."""
    plain = symbols >= v.size
    if not plain.any():
        return symbols, first
    code, which = np.unique(symbols[plain] - v.size, return_inverse=True)
    texts = [chr(c).encode() for c in code.tolist()]
    size = np.ones(len(symbols), np.int64)
    size[plain] = np.array([len(t) for t in texts])[which]
    place = np.concatenate(([0], np.cumsum(size)))
    out = np.repeat(symbols, size)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    out[np.repeat(plain, size)] = v.byte[raw[spans(size[plain], starts[which])]]
    return out, place[first]


def encode_parts(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of byte strings (valid UTF-8) and each string's first id."""
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    symbols = v.symbol[code]
    char_at = np.cumsum(np.concatenate(([0], (data & 0xC0) != 0x80)))[off]
    cut = np.ones(len(symbols) + 1, bool)
    if len(symbols) > 1:
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(v.near, key), len(v.near) - 1)
        cut[1:-1] = v.near[at] != key
    cut[char_at] = True
    word_first = np.flatnonzero(cut)
    out, first = _to_bytes(v, *merge_words(v, symbols, word_first))
    return out, first[np.searchsorted(word_first, char_at)]


def encode_texts(v: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts given as one UTF-8 buffer with offsets: flat ids and each
    text's first id (one more than texts)."""
    full = np.flatnonzero(np.diff(off) > 0)
    if v.prefix and len(full):                 # one blank in front of each text
        data = np.insert(data, off[full], 0x20)
        off = off + np.concatenate(([0], np.cumsum(np.diff(off) > 0)))
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = v.lone[data]
    cut[1:] |= cut[:-1].copy()
    if v.cut_blanks:
        # byte 0x81 may end a blank's own character
        cut[1:] |= (data[1:] == 0x20) & (data[:-1] != 0x20) & (data[:-1] != 0x81)
    cut[off[:-1][np.diff(off) > 0]] = True
    cut[0] = True
    at = np.append(np.flatnonzero(cut), len(data))
    parts = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    coded = parts.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    ids, first = encode_parts(v, *text_buffer(coded.dictionary))
    size = np.diff(first)[which]
    flat = ids[spans(size, first[:-1][which])]
    ends = np.concatenate(([0], np.cumsum(size)))
    return flat, ends[np.searchsorted(at, off)]


# -------------------------------------------------------------------- decoding

def _repair(v: Vocabulary, ids: list[int]) -> bytes:
    """Decoded bytes of one text whose byte pieces are no valid UTF-8: each byte
    outside a valid character becomes U+FFFD."""
    out, run = [], bytearray()

    def flush() -> None:
        at = 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                part = bytes(run[at:at + size])
                try:
                    part.decode()
                except UnicodeDecodeError:
                    continue
                out.append(part)
                at += size
                break
            else:
                out.append("�".encode())
                at += 1
        run.clear()

    for i in ids:
        if v.kind[i] == BYTE:
            run += bytes(v.text[v.text_at[i]:v.text_at[i + 1]])
        else:
            flush()
            out.append(bytes(v.text[v.text_at[i]:v.text_at[i + 1]]))
    flush()
    return b"".join(out)


def decode_ids(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of flat ids: pieces joined, blanks restored, the added one removed."""
    size = np.diff(v.text_at)[ids]
    data = v.text[spans(size, v.text_at[:-1][ids])]
    ends = np.concatenate(([0], np.cumsum(size)))
    off = ends[first]
    if v.prefix and len(ids):
        # the first id of a text that stands for text
        shown = np.append(np.flatnonzero(v.kind[ids] != CONTROL), len(ids))
        lead = shown[np.searchsorted(shown, first[:-1])]
        some = np.flatnonzero(lead < first[1:])
        some = some[v.opens[ids[lead[some]]]]
        stay = np.ones(len(data), bool)
        stay[ends[lead[some]]] = False
        lost = np.zeros(len(off), np.int64)
        lost[some + 1] = 1
        data, off = data[stay], off - np.cumsum(lost)
    # bytes of one character may only meet where neither a text nor a control id is between
    whole = not (v.kind[ids] == CONTROL).any()
    if whole and len(data):
        begin = off[:-1][np.diff(off) > 0]
        whole = not (data[begin] & 0xC0 == 0x80).any()
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            whole = False
    if whole:
        return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
    texts = []
    for k in range(len(first) - 1):
        own = ids[first[k]:first[k + 1]]
        fixed = _repair(v, own.tolist())
        lead = own[v.kind[own] != CONTROL][:1]
        texts.append((fixed[1:] if v.prefix and v.opens[lead].any() else fixed).decode())
    return pa.array(texts, pa.string())


# ------------------------------------------------------------------- operators

def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the model has over {MAX_MODEL_BYTES} bytes")
    Vocabulary(model)                          # an unfit model fails here, not in a task
    return df.sparkSession.sparkContext.broadcast(model)


def encode_pieces(df: DataFrame, text: str, model: str, ids: str = "ids", decoded: str | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if None) plus ``ids`` (array of int)
    and, if ``decoded`` is given, the text that these ids decode to.  ``model`` is
    the path of the model file on the driver."""
    shared = _model(df, model)
    kept = list(df.columns if keep is None else keep)
    names = [free_name(df, c) for c in ([ids] if decoded is None else [ids, decoded])]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(names[0], T.ArrayType(T.IntegerType()))]
                          + [T.StructField(c, T.StringType()) for c in names[1:]])
    source = df.select(*[col(c) for c in kept], col(text).alias(free_name(df, "_text")))

    def run(batches):
        v = vocabulary(shared.value)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data, off = text_buffer(batch.column(len(kept)))
            a, n = 0, batch.num_rows
            while a < n:
                b = int(np.searchsorted(off, off[a] + CHUNK_BYTES, side="right")) - 1
                b = min(max(b, a + 1), n)
                flat, first = encode_texts(v, data[off[a]:off[b]], off[a:b + 1] - off[a])
                part = batch.slice(a, b - a)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat.astype(np.int32)))
                more = [] if decoded is None else [decode_ids(v, flat, first)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], lists, *more], [*kept, *names])
                a = b

    return source.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, ids: str, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if None) plus ``text``, decoded from
    the array column ``ids`` (NULL: empty; a NULL id or one outside the vocabulary
    is an error)."""
    shared = _model(df, model)
    kept = list(df.columns if keep is None else keep)
    name = free_name(df, text)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.StringType())])
    source = df.select(*[col(c) for c in kept], col(ids).cast("array<int>").alias(free_name(df, "_ids")))

    def run(batches):
        v = vocabulary(shared.value)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(len(kept))
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id is NULL")
            flat = flat.to_numpy().astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= v.size):
                raise ValueError("an id is outside the vocabulary")
            texts = decode_ids(v, flat, np.concatenate(([0], np.cumsum(size))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], texts], [*kept, name])

    return source.mapInArrow(run, schema)
