"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

Which tokens may follow one another is a local property of a merge table: a sequence of tokens
is the encoding of its bytes exactly when every two neighbours are the encoding of theirs. So
a nondeterministic transducer reads bytes along a trie of the tokens, may end a token at any
node that is one, and needs only the last token to judge the next. Its subset construction is
done on demand: a state is the set of (pending tokens, trie node) still possible, an arc on a
byte gives the next state and the tokens on which all possibilities agree, and arcs are
kept once computed. A token is emitted as soon as no rival is left, after a look-ahead bounded
by the longest overlap of tokens.

Decoding concatenates token bytes and runs an incremental UTF-8 state machine over them, one
step for each token, computed by bytes at its first use, so a text can be cut anywhere.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.blocks import STORES, array_of, ready

STATES = 100_000
PIECES = 280_000
PIECE_CHARS = 40
FLUSH_IDS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes one match of the splitting pattern at a time.

    Tokens are known by their ranks. A possibility is a pair of the tokens not yet emitted and a
    trie node; possibilities stand in the order in which their unfinished token began, the one at
    the root last. At every place there is exactly one at the root: the encoding so far.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs: dict[int, bool] = {}
        # the two tokens that a token was merged from; single bytes are not merged
        self.halves: dict[int, tuple[int, int]] = {}
        # trie nodes are numbers: children by byte, and the token that ends there
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self.merged(token)
                if len(parts) != 2:  # merging never makes it; it only stands for itself
                    continue
                self.halves[rank] = ranks[parts[0]], ranks[parts[1]]
            node = 0
            for b in token:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.ends):
                    self.children.append({}), self.ends.append(-1)
            self.ends[node] = rank
        self.bytes = {r: t for t, r in ranks.items()}
        self.forget()

    def forget(self) -> None:
        """Start the determinised part anew, which bounds its memory."""
        self.number: dict[tuple, int] = {}
        self.subsets: list[tuple] = []
        self.arcs: list[dict[int, tuple[int, tuple]]] = []
        self.start = self.state((((), 0),), -1)

    def merged(self, token: bytes) -> list[bytes]:
        """What merging makes of a token's bytes before its own rank: the pair of lowest rank first,
        the leftmost among equals."""
        parts = [token[i : i + 1] for i in range(len(token))]
        ranks, own = self.ranks, self.ranks[token]
        while len(parts) > 2:
            low, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
            if low >= own:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together.

        Seen backwards in time: at each moment the token at the right edge of ``left`` and the one at
        the left edge of ``right`` face each other until the younger of the two came to be. They
        merge across the border if their union has a rank that comes before that moment.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > 2 * STATES:
            self.pairs.clear()
        a, b, until, apart = left, right, 1 << 60, True
        # until: the union must come before it; on a tie of ranks the left place wins
        while True:
            union = self.ranks.get(self.bytes[a] + self.bytes[b])
            if union is not None and union < until:
                apart = False
                break
            x, y = (a if a in self.halves else -1), (b if b in self.halves else -1)
            if x < 0 and y < 0:
                break
            if x > y:
                until, a = x, self.halves[a][1]
            else:
                # a union of the same rank as the right token starts further left, so it goes first
                until, b = y + 1, self.halves[b][0]
        self.pairs[key] = apart
        return apart

    def state(self, subset: tuple, last: int) -> int:
        """Number of the state with these possibilities after the emitted token ``last``."""
        if subset[0][0]:  # no possibility asks for the last token any more
            last = -1
        key = (subset, last)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.subsets)
            self.subsets.append(key), self.arcs.append({})
        return number

    def step(self, number: int, byte: int) -> tuple[int, tuple]:
        """The arc on a byte: the next state, and the tokens that are now certain."""
        subset, last = self.subsets[number]
        children, ends, pairs = self.children, self.ends, self.pairs
        found, root = [], None
        for pending, node in subset:
            child = children[node].get(byte)
            if child is None:
                continue
            if children[child]:
                found.append((pending, child))
            if root is None:
                token = ends[child]
                if token >= 0:
                    before = pending[-1] if pending else last
                    apart = before < 0 or pairs.get(before << 20 | token)
                    if apart is None:
                        apart = self.follow(before, token)
                    if apart:
                        root = (*pending, token)
        # what all possibilities begin with is certain
        shared = found[0][0] if found else root
        if shared:
            for pending, _ in (*found, (root, 0)):
                while shared != pending[: len(shared)]:
                    shared = shared[:-1]
            n = len(shared)
            if n:
                found = [(pending[n:], node) for pending, node in found]
                root, last = root[n:], shared[-1]
        found.append((root, 0))
        arc = self.state(tuple(found), last), shared
        self.arcs[number][byte] = arc
        return arc

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.subsets) > STATES:
            self.forget()
        out: list[int] = []
        number, arcs = self.start, self.arcs
        for byte in piece:
            arc = arcs[number].get(byte) or self.step(number, byte)
            number = arc[0]
            if arc[1]:
                out += arc[1]
        out += self.subsets[number][0][-1][0]
        return out


class PieceIds(dict):
    """Ids of matches of the pattern as 32-bit numbers, kept in two generations of bounded size."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.old = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self) > PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """``text -> ids as bytes``; one per worker process, kept from task to task."""
    # states are many small objects without cycles, so the collector need not walk them all the time
    gc.set_threshold(100_000, 50, 1000)
    ids_of = PieceIds(Transducer(read_ranks(path))).__getitem__
    split = regex.compile(pattern).findall
    return lambda text: b"".join(map(ids_of, split(text)))


# Kinds of byte in UTF-8, and the states between characters: fixed by the format.
# State: (continuation bytes still due, least and greatest value of the next one).
IDLE, BROKEN = (0, 0, 0), (-1, 0, 0)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int]:
    due, low, high = state
    if due < 0:
        return BROKEN
    if due:
        return (due - 1, 0x80, 0xBF) if low <= byte <= high and due > 1 else IDLE if low <= byte <= high else BROKEN
    if byte < 0x80:
        return IDLE
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return BROKEN


class StreamDecoder:
    """Bytes out of token ids, a stretch at a time, checked to be UTF-8.

    ``state`` carries over from stretch to stretch. Tokens of whole characters leave the machine idle,
    so it only has to take steps at the others; each step goes through the token's bytes.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.part = np.array([self.after(IDLE, t) != IDLE for t in range(len(tokens))])
        self.state = IDLE

    def after(self, state: tuple[int, int, int], token: int) -> tuple[int, int, int]:
        for byte in self.tokens[token]:
            state = utf8_step(state, byte)
        return state

    def feed(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the next ids; raises where they cannot be UTF-8."""
        expected = 0
        for i in np.flatnonzero(self.part[ids]).tolist():
            if self.state != IDLE and i != expected:
                raise ValueError("token ids do not form UTF-8")
            self.state, expected = self.after(self.state, ids[i]), i + 1
            if self.state == BROKEN:
                raise ValueError("token ids do not form UTF-8")
        if self.state != IDLE and expected != len(ids) and len(ids):
            raise ValueError("token ids do not form UTF-8")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[places]

    def close(self) -> None:
        """The end of a text, which must not be inside a character."""
        if self.state != IDLE:
            raise ValueError("token ids end inside a character")

    def decode(self, ids: np.ndarray) -> np.ndarray:
        self.state = IDLE
        out = [self.feed(ids[i : i + FLUSH_IDS]) for i in range(0, len(ids), FLUSH_IDS)]
        self.close()
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.empty(0, np.uint8)


    def decode_rows(self, ids: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some texts whose ids begin at the places ``where``, and where each text's bytes begin.

        All go through the machine as one stretch at a time, which has to be idle wherever a text ends.
        """
        inside = self.part[ids]
        cut = np.zeros(len(ids) + 1, bool)
        cut[where] = True
        # a text may not end inside a character: the token before a cut that is part of one must close it
        self.state, expected = IDLE, 0
        for i in np.flatnonzero(inside).tolist():
            if self.state != IDLE and (i != expected or cut[i]):
                raise ValueError("token ids do not form UTF-8")
            self.state, expected = self.after(self.state, ids[i]), i + 1
            if self.state == BROKEN:
                raise ValueError("token ids do not form UTF-8")
        self.close()
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        for a in range(0, len(ids), FLUSH_IDS):  # bounded places, also for a very long text
            b = min(a + FLUSH_IDS, len(ids))
            out.append(self.bytes[np.repeat(self.starts[ids[a:b]] - ends[a:b], sizes[a:b]) + np.arange(ends[a], ends[b])])
        return (np.concatenate(out) if len(out) != 1 else out[0]) if out else np.empty(0, np.uint8), ends[where]


@lru_cache(maxsize=2)
def decoder(path: str) -> StreamDecoder:
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return StreamDecoder(tokens)


STORES.extend([encoder, decoder])


def texts_of(column: pa.Array, at_once: int = 256) -> Iterator[str]:
    """The texts of a column, few of them at a time as Python objects."""
    for lo in range(0, len(column), at_once):
        yield from column.slice(lo, at_once).to_pylist()


def encoding(path: str, pattern: str, payload: int):
    """Batches of ``payload`` columns and a text to the same columns and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for batch in batches:
            rows, lo, total = [], 0, 0
            last = len(batch) - 1
            for i, text in enumerate(texts_of(batch.column(payload))):
                rows.append(encode(text))
                total += len(rows[-1])
                if total > FLUSH_IDS or i == last:  # bytes: four an id
                    where = np.cumsum([0, *map(len, rows)]) // 4
                    own = [batch.column(j).slice(lo, i + 1 - lo) for j in range(payload)]
                    yield pa.record_batch([*own, array_of(np.frombuffer(b"".join(rows), np.int32), where, pa.int32())], names=[*batch.schema.names[:payload], "ids"])
                    rows, lo, total = [], i + 1, 0

    return run


def decoding(path: str, payload: int):
    """Batches of ``payload`` columns and ids to the same columns, the ids and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(path).decode_rows
        for batch in batches:
            where = batch.column(payload).offsets.to_numpy()
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(where, where[lo] + FLUSH_IDS // 4, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                data, ends = decode(part.column(payload).flatten().to_numpy(), where[lo : hi + 1] - where[lo])
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.record_batch([*part.columns, decoded.cast(pa.binary())], names=[*part.schema.names, "decoded"])
                lo = hi

    return run


def _with_column(df: DataFrame, carry: list[str], given, run, more: str) -> DataFrame:
    """The columns ``carry`` and those that ``run`` makes from them and ``given``, whatever their names."""
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    fields = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    made = df.select(*own, given).mapInArrow(run, ", ".join([*fields, more]))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *made.columns[len(carry) :])


def encode_texts(docs: DataFrame, ranks: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) and ``ids``, the token ids of the whole text.

    ``ranks`` is a file of base64 tokens with their ranks, ``pattern`` splits a text into the
    stretches that are encoded by themselves. Null and empty texts have no ids. A column ``ids``
    is replaced. Rows are encoded one by one, so repeated rows and empty tables are nothing special.
    """
    ready(docs)
    carry = [c for c in (carry or docs.columns) if c != "ids"]
    given = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("given")
    return _with_column(docs, carry, given, encoding(ranks, pattern, len(carry)), "ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``encode_texts`` and ``decode_ids`` in one pass: the columns ``carry``, ``ids`` and ``decoded``.

    Each task has one Python worker for both then, which halves their memory.
    """
    ready(docs)
    carry = [c for c in (carry or docs.columns) if c not in ("ids", "decoded")]
    given = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("given")
    there, back = encoding(ranks, pattern, len(carry)), decoding(ranks, len(carry))
    return _with_column(docs, carry, given, lambda batches: back(there(batches)), "ids array<int>, decoded binary")


def decode_ids(docs: DataFrame, ranks: str) -> DataFrame:
    """All columns, and ``decoded``: the bytes of the column ``ids``, checked to be UTF-8; null ids give no bytes."""
    ready(docs)
    carry = [c for c in docs.columns if c not in ("ids", "decoded")]
    given = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return _with_column(docs, carry, given, decoding(ranks, len(carry)), "ids array<int>, decoded binary")
