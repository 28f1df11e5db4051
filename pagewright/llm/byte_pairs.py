"""Byte-level pair encoding of texts, and back, in whole arrays of code points.

Pre-tokens are found by a finite automaton instead of a regular expression. Every code point becomes a symbol (its class and a
little of what follows); a symbol is a function from states to states. Functions compose, and composition is associative, so a
stretch is cut into blocks whose products are taken side by side, the products of the blocks give the state at the start of each,
and a second pass gives the state before every code point. State and symbol together say whether a pre-token begins there.
The products that can arise are few and are numbered beforehand, so that composing is one look-up in a table.

The slices between those places are told apart by Arrow; only distinct ones that are no token themselves are merged pair by
pair, and the results are kept for later batches of the worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of so many bytes are worked on together, and so many bytes are scanned at once.
BATCH_BYTES = 4 << 20
SCAN_BYTES = 1 << 20
# Code points in a block of the scan.
BLOCK = 256
# Longest slice that is kept, and number of slices kept by a worker.
KEPT_BYTES, KEPT_SLICES = 64, 1 << 18

LETTER, NUMBER, SPACE, OTHER = range(4)
# Symbols: a letter, one that ends a contraction, one that begins the ending "re", "ve" or "ll", a number, any other
# visible character, an apostrophe, a blank before something visible, other white space before it, white space before more or the end.
(A_LETTER, A_TAIL, A_PAIR, A_NUMBER, AN_OTHER, AN_APOSTROPHE, A_LEAD, A_LAST, A_GAP) = range(9)
SYMBOLS = 9
# States: nothing open; within letters, numbers, others; after an apostrophe that began a pre-token; within and after a contraction;
# after a blank that joins what follows; within white space.
(DONE, LETTERS, NUMBERS, OTHERS, QUOTE, INSIDE, SHORT, JOINED, GAP) = range(9)
STATES = 9


def default_ranks() -> str:
    """The rank file that the registered query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def class_ranges() -> tuple[np.ndarray, np.ndarray]:
    """First code point and class of every run of code points of one class.

    The classes are asked of the library whose results are to be met, so that both follow one version of Unicode.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], "<u4").tobytes().decode("utf-32-le")
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        encoding = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        members = encoding.decode_bytes(encoding.encode_ordinary(every)).decode()
        classes[np.frombuffer(members.encode("utf-32-le"), "<u4")] = kind
    starts = np.concatenate([[0], np.nonzero(np.diff(classes))[0] + 1])
    return starts, classes[starts]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a pre-token begins, for every state and symbol; symbols from `SYMBOLS` on begin a text."""
    goes = np.empty((STATES, SYMBOLS), np.uint8)
    cuts = np.ones((STATES, SYMBOLS), bool)
    for symbol, state, joins in (
        (A_LETTER, LETTERS, (LETTERS, JOINED)), (A_TAIL, LETTERS, (LETTERS, JOINED)), (A_PAIR, LETTERS, (LETTERS, JOINED)),
        (A_NUMBER, NUMBERS, (NUMBERS, JOINED)), (AN_OTHER, OTHERS, (OTHERS, QUOTE, JOINED)),
        (AN_APOSTROPHE, QUOTE, ()), (A_LEAD, JOINED, ()), (A_LAST, DONE, ()), (A_GAP, GAP, (GAP,)),
    ):
        goes[:, symbol] = state
        cuts[list(joins), symbol] = False
    for state in (OTHERS, QUOTE, JOINED):
        goes[state, AN_APOSTROPHE], cuts[state, AN_APOSTROPHE] = OTHERS, False
    goes[QUOTE, A_TAIL], cuts[QUOTE, A_TAIL] = SHORT, False
    goes[QUOTE, A_PAIR], cuts[QUOTE, A_PAIR] = INSIDE, False
    for symbol in (A_LETTER, A_TAIL, A_PAIR):
        goes[INSIDE, symbol], cuts[INSIDE, symbol] = SHORT, False
    fresh = np.broadcast_to(goes[DONE], goes.shape)
    return np.hstack([goes, fresh]), np.hstack([cuts, np.ones_like(cuts)])


GOES, CUTS = _automaton()


def _products() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols compose to: their values, the number of each symbol's, and the table of products."""
    known: dict[tuple[int, ...], int] = {tuple(range(STATES)): 0}
    order = list(known)
    letters = [tuple(GOES[:, s].tolist()) for s in range(2 * SYMBOLS)]
    for function in order:
        for letter in letters:
            made = tuple(letter[v] for v in function)
            if made not in known:
                known[made] = len(order)
                order.append(made)
    values = np.array(order, np.uint8)
    table = np.array([[known[tuple(values[b][values[a]].tolist())] for b in range(len(order))] for a in range(len(order))], np.uint16)
    return values, np.array([known[x] for x in letters], np.uint16), table


VALUES, NUMBERS_OF, TABLE = _products()


def states_before(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """State before each of `symbols` (function numbers of blocks or single symbols), and after the last."""
    return _scan(NUMBERS_OF[symbols], state)


def _scan(functions: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    if len(functions) <= BLOCK:
        out = np.empty(len(functions), np.uint8)
        for i, f in enumerate(functions.tolist()):
            out[i] = state
            state = int(VALUES[f, state])
        return out, state
    count = -(-len(functions) // BLOCK)
    padded = np.zeros(count * BLOCK, np.uint16)  # number 0 changes nothing
    padded[: len(functions)] = functions
    columns = np.ascontiguousarray(padded.reshape(count, BLOCK).T)
    flat, width = TABLE.ravel(), np.uint32(len(TABLE))
    product = columns[0]
    for column in columns[1:]:
        product = flat[product * width + column]
    before, last = _scan(product, state)
    out, apply = np.empty((BLOCK, count), np.uint8), VALUES.ravel()
    for i, column in enumerate(columns):
        out[i] = before
        before = apply[column * np.uint32(STATES) + before]
    return out.T.reshape(-1)[: len(functions)], last


class Boundaries:
    """Finds where pre-tokens begin."""

    def __init__(self, ranges: tuple[np.ndarray, np.ndarray]):
        starts, classes = ranges
        kinds = np.repeat(classes, np.diff(np.append(starts, 0x110000)))
        self.alone = np.array([A_LETTER, A_NUMBER, A_GAP, AN_OTHER], np.uint8)[kinds]
        self.alone[ord("'")] = AN_APOSTROPHE
        self.alone[[ord(c) for c in "stmd"]] = A_TAIL

    def _symbols(self, points: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
        """Symbols of the first `size` of `points`; `first` marks the first code point of a text."""
        symbol = self.alone[points]
        gap, ends = symbol == A_GAP, np.append(first[1:], True)
        visible = np.append(~gap[1:], False) & ~ends & gap
        following = np.where(ends, 0, np.append(points[1:], 0))
        pair = (following == ord("e")) & ((points == ord("r")) | (points == ord("v"))) | (following == ord("l")) & (points == ord("l"))
        symbol[pair] = A_PAIR
        symbol[visible] = np.where(points[visible] == ord(" "), A_LEAD, A_LAST)
        return (symbol + SYMBOLS * first)[:size]

    def find(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Byte offsets in UTF-8 `data` of all pre-tokens; `texts` are the offsets at which its texts begin."""
        begins = np.zeros(len(data) + 1, bool)
        begins[texts] = True
        lead = (data & 0xC0) != 0x80
        found, state, at = [], DONE, 0
        while at < len(data):
            end = min(len(data), at + SCAN_BYTES)
            while end < len(data) and not lead[end]:
                end += 1
            ahead = end  # one code point more
            while ahead < len(data) and (ahead == end or not lead[ahead]):
                ahead += 1
            points = np.frombuffer(data[at:ahead].tobytes().decode().encode("utf-32-le"), "<u4")
            places = at + np.nonzero(lead[at:ahead])[0]
            size = len(points) - (ahead > end)
            symbols = self._symbols(points, begins[places], size)
            before, state = states_before(symbols, state)
            found.append(places[:size][CUTS[before, symbols]])
            at = end
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all neighbours the pair of least rank is merged, the leftmost first, until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = len(piece)
    ends, before = list(range(1, size + 1)), list(range(-1, size))
    waiting = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(waiting)
    while waiting:
        _, i, end = heappop(waiting)
        middle = ends[i]
        if not 0 < middle < size or ends[middle] != end:
            continue  # one of the two has been merged since
        ends[i], ends[middle] = end, 0
        if end < size:
            before[end] = i
            rank = ranks.get(piece[i : ends[end]])
            if rank is not None:
                heappush(waiting, (rank, i, ends[end]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(piece[left:end])
            if rank is not None:
                heappush(waiting, (rank, left, end))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return ids


def _gathered(sizes: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each of `codes`, entry i of `flat` having `sizes[i]` values; and their numbers."""
    counts = sizes[codes]
    shift = (np.cumsum(sizes) - sizes)[codes] - (np.cumsum(counts) - counts)
    return counts, flat[np.repeat(shift, counts) + np.arange(counts.sum())]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends."""
    binary = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    held = binary.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Codec:
    """Encodes and decodes batches of texts with the ranks of a file's content."""

    def __init__(self, content: bytes, ranges: tuple[np.ndarray, np.ndarray]):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.tokens = pa.array(tokens, pa.binary())
        self.boundaries = Boundaries(ranges)
        self.kept: dict[bytes, list[int]] = {}

    def _slices(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each distinct slice, and all ids."""
        single = pc.index_in(distinct, self.tokens)
        rest = np.nonzero(single.is_null().to_numpy(zero_copy_only=False))[0]
        parts = []
        for piece in distinct.take(pa.array(rest)).to_pylist():
            ids = self.kept.get(piece)
            if ids is None:
                ids = merged(piece, self.ranks)
                if len(piece) <= KEPT_BYTES:
                    if len(self.kept) >= KEPT_SLICES:
                        self.kept.clear()
                    self.kept[piece] = ids
            parts.append(ids)
        sizes = np.ones(len(distinct), np.int64)
        sizes[rest] = [len(x) for x in parts]
        flat = np.repeat(single.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32), sizes)
        flat[np.repeat(np.isin(np.arange(len(distinct)), rest), sizes)] = [i for x in parts for i in x]
        return sizes, flat

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each text, all ids, and the byte of its text at which each id begins; a null text is empty."""
        data, offsets = _bytes_of(texts)
        begins = self.boundaries.find(data, offsets[:-1])
        places = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
        slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, places, pa.py_buffer(data)])
        coded = slices.dictionary_encode()
        sizes, flat = self._slices(coded.dictionary.cast(pa.binary()))
        counts, ids = _gathered(sizes, flat, coded.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        starts = ends[:-1]
        upto = np.searchsorted(starts, offsets)
        return np.diff(upto), ids.astype(np.int32), (starts - np.repeat(offsets[:-1], np.diff(upto))).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that `ids` stand for."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes)):
            raise ValueError("id outside of the vocabulary")
        step = BATCH_BYTES // 4
        return b"".join(_gathered(self.sizes, self.flat, ids[a : a + step])[1].tobytes() for a in range(0, len(ids), step))


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """`texts`, so many at once that they have `BATCH_BYTES` together, at least one."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = lengths[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(lengths, done + BATCH_BYTES, "right")))
        yield texts.slice(at, end - at)
        at = end


@lru_cache(maxsize=2)
def _codec(content: bytes, starts: bytes, classes: bytes) -> Codec:
    return Codec(content, (np.frombuffer(starts, np.int64), np.frombuffer(classes, np.uint8)))


class ByteBpe:
    """Column expressions for one vocabulary. The rank file is read by the driver and travels with the plan (under a MB for 50,000 ranks)."""

    def __init__(self, ranks: str | None = None):
        with open(ranks or default_ranks(), "rb") as file:
            content = file.read()
        starts, classes = class_ranges()
        self._made_of = content, starts.astype(np.int64).tobytes(), classes.tobytes()

    def encode(self, text: Column) -> Column:
        """`(ids, starts)` of a text: its ids, and the byte of the UTF-8 text at which each begins. Null is empty."""
        made_of = self._made_of

        @F.arrow_udf("ids array<int>, starts array<int>")
        def of(texts: pa.Array) -> pa.Array:
            codec = _codec(*made_of)
            parts = [codec.encode(some) for some in _portions(texts)]
            counts = np.concatenate([[0], *(p[0] for p in parts)])
            offsets = pa.array(np.cumsum(counts), pa.int32())
            columns = [np.concatenate([np.zeros(0, np.int32), *(p[k] for p in parts)]) for k in (1, 2)]
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(c, pa.int32())) for c in columns], ["ids", "starts"])

        return of(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids; null for null. An id that the vocabulary lacks is an error."""
        made_of = self._made_of

        @F.arrow_udf("binary")
        def of(lists: pa.Array) -> pa.Array:
            codec = _codec(*made_of)
            return pa.array([None if not x.is_valid else codec.decode(x.values.to_numpy(zero_copy_only=False)) for x in lists], pa.binary())

        return of(ids)

    def digest(self, text: Column) -> Column:
        """`(n_tokens, ids_sha256, decoded_sha256)` of a text that is encoded and decoded; only digests leave the worker."""
        made_of = self._made_of

        @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def of(texts: pa.Array) -> pa.Array:
            codec, counts, coded, back = _codec(*made_of), [], [], []
            for some in _portions(texts):
                number, ids, _ = codec.encode(some)
                counts.append(number)
                for end, n in zip(np.cumsum(number).tolist(), number.tolist()):
                    own = ids[end - n : end]
                    coded.append(sha256(own.astype("<u4").tobytes()).hexdigest())
                    back.append(sha256(codec.decode(own)).hexdigest())
            number = pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())
            return pa.StructArray.from_arrays([number, pa.array(coded, pa.string()), pa.array(back, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

        return of(text)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """`(key, ids, starts)` for every row of `docs`, repeated rows and null keys included.

    A null or empty text has no ids. Other columns of `docs` are not read, so their names cannot clash. Rows are worked on in
    place, without a shuffle; a text is cut into stretches that end anywhere, as the automaton's state carries over.
    """
    made = docs.select(F.col(key), ByteBpe(ranks).encode(F.col(text)).alias("s"))
    return made.select(key, "s.ids", "s.starts")


def decoded(coded: DataFrame, ranks: str | None = None) -> DataFrame:
    """`coded`, which has `ids`, with the column `decoded`: the bytes of each row's text."""
    return coded.withColumn("decoded", ByteBpe(ranks).decode(F.col("ids")))


def byte_bpe_digest(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to: `(doc_id, n_tokens, ids_sha256, decoded_sha256)`."""
    return docs.select("doc_id", ByteBpe(ranks).digest(F.col("text")).alias("s")).select("doc_id", "s.*")
