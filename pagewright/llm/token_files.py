"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of its documents, one after another, in blocks of `BLOCK` ids. A block stores its
smallest id, the bits of all differences from it up to a width chosen among percentiles of their
lengths, as bit planes, and the few wider differences as exceptions (place, difference). After the blocks
stand the start of every block, the id and the number of tokens of every document, and a footer.
All numbers are little-endian:

    magic | blocks | block starts u64 | document keys i64, null flags u8, lengths u64 | footer
    block:  least u32, width u8, exceptions u16, ids u16 | planes | places u16, differences u32
    footer: blocks u64, documents u64, ids u64, place of the block starts u64, magic
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.files import located, new_file
from pagewright.session import materialize, new_folder

BLOCK = 1024
# Blocks that are packed or unpacked together.
GROUP = 256
PERCENTILES = (90, 95, 99, 100)
MAGIC = b"PFORIDS1"
HEAD, HEAD_BYTES = "<IBHH", struct.calcsize("<IBHH")
FOOT, FOOT_BYTES = "<QQQQ8s", struct.calcsize("<QQQQ8s")
END_ID = 2
# Bytes of text that are encoded together.
BATCH_BYTES = 12 << 20


def _lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(ids: np.ndarray) -> list[bytes]:
    """Blocks for `ids`; only the last may be short."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    bits = _lengths(rest)
    upto = np.cumsum(np.stack([np.count_nonzero(bits == w, axis=1) for w in range(33)], axis=1), axis=1)
    cost = np.full((blocks, 33), np.iinfo(np.int64).max, np.int64)
    for percent in PERCENTILES:
        width = np.argmax(upto * 100 >= percent * BLOCK, axis=1)
        wider = BLOCK - upto[np.arange(blocks), width]
        cost[np.arange(blocks), width] = width * (BLOCK // 8) + wider * 6
    chosen = cost.argmin(axis=1)
    out: list[bytes] = [b""] * blocks
    for width in np.unique(chosen).tolist():
        at = np.nonzero(chosen == width)[0]
        part = rest[at]
        planes = [np.packbits((part >> np.uint32(j) & np.uint32(1)).astype(np.uint8), axis=1) for j in range(width)]
        packed = np.stack(planes, axis=1) if planes else np.zeros((len(at), 0, BLOCK // 8), np.uint8)
        over = bits[at] > width
        for k, i in enumerate(at.tolist()):
            places = np.nonzero(over[k])[0]
            size = min(BLOCK, len(ids) - i * BLOCK)
            out[i] = b"".join((
                struct.pack(HEAD, int(least[i]), width, len(places), size), packed[k].tobytes(),
                places.astype("<u2").tobytes(), part[k, places].astype("<u4").tobytes(),
            ))
    return out


def _unpack(data: bytes, starts: list[int]) -> np.ndarray:
    """Ids of the blocks that begin at `starts` in `data`."""
    heads = [struct.unpack_from(HEAD, data, s) for s in starts]
    rows = np.empty((len(starts), BLOCK), np.uint32)
    widths = np.array([h[1] for h in heads])
    for width in np.unique(widths).tolist():
        at = np.nonzero(widths == width)[0]
        planes = np.frombuffer(
            b"".join(data[starts[i] + HEAD_BYTES : starts[i] + HEAD_BYTES + width * BLOCK // 8] for i in at), np.uint8
        ).reshape(len(at), width, BLOCK // 8)
        part = np.zeros((len(at), BLOCK), np.uint32)
        for j in range(width):
            part |= np.unpackbits(planes[:, j], axis=1).astype(np.uint32) << np.uint32(j)
        rows[at] = part
    for i, (least, width, count, _) in enumerate(heads):
        if count:
            at = starts[i] + HEAD_BYTES + width * BLOCK // 8
            places = np.frombuffer(data, "<u2", count, at)
            rows[i, places] = np.frombuffer(data, "<u4", count, at + 2 * count)
        rows[i] += np.uint32(least)
    sizes = [h[3] for h in heads]
    return rows.reshape(-1)[: (len(starts) - 1) * BLOCK + sizes[-1]]


class TokenFileWriter:
    """Writes one file; blocks leave memory as they fill."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self.out = system.open_output_stream(path, compression=None)
        self.out.write(MAGIC)
        self.at, self.ids = len(MAGIC), 0
        self.starts: list[int] = []
        self.keys: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.waits = 0

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if all_of_it else len(ids) // (BLOCK * GROUP) * BLOCK * GROUP
        for begin in range(0, whole, BLOCK * GROUP):
            for block in _pack(ids[begin : min(whole, begin + BLOCK * GROUP)]):
                self.starts.append(self.at)
                self.out.write(block)
                self.at += len(block)
        self.waiting = [ids[whole:]]
        self.waits = len(ids) - whole

    def add(self, keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with `counts` ids each, which `ids` holds one after another."""
        self.keys.extend(keys)
        self.counts.append(np.asarray(counts, np.uint64))
        self.waiting.append(np.asarray(ids, np.uint32))
        self.waits += len(ids)
        self.ids += len(ids)
        if self.waits >= BLOCK * GROUP:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.uint64)
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array([k or 0 for k in self.keys], "<i8").tobytes())
        self.out.write(np.array([k is None for k in self.keys], np.uint8).tobytes())
        self.out.write(counts.astype("<u8").tobytes())
        self.out.write(struct.pack(FOOT, len(self.starts), len(self.keys), self.ids, self.at, MAGIC))
        self.out.close()


class TokenFile:
    """Reads one file: its documents, and any stretch of its ids without the others."""

    def __init__(self, uri: str):
        system, path = located(uri)
        self.file = system.open_input_file(path)
        end = self.file.size()
        blocks, documents, self.ids, at, magic = struct.unpack(FOOT, self.file.read_at(FOOT_BYTES, end - FOOT_BYTES))
        if magic != MAGIC:
            raise ValueError(f"no token file: {uri}")
        tail = self.file.read_at(end - FOOT_BYTES - at, at)
        self.starts = np.frombuffer(tail, "<u8", blocks).astype(np.int64).tolist() + [at]
        keys = np.frombuffer(tail, "<i8", documents, 8 * blocks)
        nulls = np.frombuffer(tail, np.uint8, documents, 8 * (blocks + documents))
        self.keys = pa.array(keys, pa.int64(), mask=nulls.astype(bool))
        self.counts = np.frombuffer(tail, "<u8", documents, 8 * (blocks + documents) + documents).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from `first` to before `last`."""
        base = self.starts[first]
        data = self.file.read_at(self.starts[last] - base, base)
        return _unpack(data, [s - base for s in self.starts[first:last]])

    def read(self, start: int, count: int) -> np.ndarray:
        """`count` ids from the `start`-th on."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-(start + count) // BLOCK)
        return self.blocks(first, last)[start - first * BLOCK : start - first * BLOCK + count]

    def checksums(self) -> np.ndarray:
        """CRC-32 of each document's ids as unsigned 32-bit numbers."""
        ends = np.cumsum(self.counts)
        sums, at = np.zeros(len(ends), np.int64), 0
        document, running = 0, 0
        for first in range(0, len(self.starts) - 1, GROUP):
            ids = self.blocks(first, min(first + GROUP, len(self.starts) - 1)).astype("<u4")
            view, upto = memoryview(ids.tobytes()), at + len(ids)
            begin = at
            while document < len(ends) and ends[document] <= upto:
                end = int(ends[document])
                sums[document] = zlib.crc32(view[4 * (begin - at) : 4 * (end - at)], running)
                begin, running = end, 0
                document += 1
            running = zlib.crc32(view[4 * (begin - at) :], running)
            at = upto
        return sums


# White space of any kind; a piece without it but for a leading line feed can be encoded alone.
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PLAIN_PIECE = rf"^\n?[^{_SPACES}]+$"


# Fixed value: the published pre-token pattern of byte-level pair encodings.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _spread(sizes: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of `flat` for a sequence of `codes`, entry i having `sizes[i]` of them; and their numbers."""
    counts = sizes[codes]
    ends = np.cumsum(counts)
    begins = np.cumsum(sizes) - sizes
    where = np.repeat((begins[codes] - (ends - counts)).astype(np.int32), counts)
    where += np.arange(len(where), dtype=np.int32)
    return counts, flat[where]


class Encoder:
    """Ids of texts, each distinct piece of a batch encoded by the tokenizer once.

    A single space or line feed between two other characters always begins a pre-token of a byte-level
    tokenizer, so what stands between such places can be encoded alone, and distinct pieces are far
    fewer than pieces. Texts with any other white space are encoded whole.
    """

    def __init__(self, tokenizer: str):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        config = json.loads(self.tokenizer.to_str())
        cutter = config["pre_tokenizer"] or {}
        self.added = [x["content"] for x in config["added_tokens"]]
        # Only byte-level pairs without a normaliser allow pieces; other tokenizers get whole texts.
        self.by_piece = (
            config["normalizer"] is None and config["model"]["type"] == "BPE" and cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True) and not cutter["add_prefix_space"] and not any(c.split() != [c] for c in self.added)
        )
        self.cut = regex.compile(PRE_TOKEN).findall
        # Bytes that are no visible character are spelled with the letters from 256 on, in order.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173)]
        self.letters = {chr(b): chr(256 + n) for n, b in enumerate(hidden)}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, `lead` before it, and all ids.

        The pieces are cut into pre-tokens, lines keep them apart; the tokenizer's model gets each distinct
        pre-token once, in the letters that stand for its bytes.
        """
        if not len(pieces):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        coded = pa.array(self.cut(lead + f"\n{lead}".join(pieces.to_pylist()))).dictionary_encode()
        codes, tokens = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        line = tokens.index("\n") if "\n" in tokens else -1
        sizes, flat = np.zeros(len(tokens), np.int64), []
        tokenize = self.tokenizer.model.tokenize
        spelled = "\n".join(t for t in tokens if t != "\n").encode().decode("latin-1")
        for byte, letter in self.letters.items():
            spelled = spelled.replace(byte, letter)
        spelled = spelled.split(self.letters["\n"])
        ends, number = [], attrgetter("id")
        for token in spelled:
            flat.extend(map(number, tokenize(token)))
            ends.append(len(flat))
        sizes[np.arange(len(tokens)) != line] = np.diff(ends[: len(tokens) - (line >= 0)], prepend=0)
        breaks = np.nonzero(codes == line)[0]
        counts, ids = _spread(sizes, np.array(flat, np.uint32), codes)
        starts = np.concatenate([[0], breaks]) if len(breaks) else np.zeros(1, np.int64)
        return np.add.reduceat(counts, starts), ids

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids; null is empty, `end` follows each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy(), coded.dictionary
        plain = pc.match_substring_regex(pieces, PLAIN_PIECE).to_numpy(zero_copy_only=False) & self.by_piece
        for content in self.added:
            plain &= ~pc.match_substring(pieces, content).to_numpy(zero_copy_only=False)
        odd = np.maximum.reduceat(~plain[codes], offsets[:-1]) if len(texts) else np.zeros(0, bool)

        # Three kinds of pieces: first of a text, after a line feed, after a space.
        fed = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        spaced = np.nonzero(plain & ~fed)[0]
        lines = np.nonzero(plain & fed)[0]
        first = pc.take(pieces, pa.array(codes[offsets[:-1]][~odd])).dictionary_encode()
        whole = self._ids(texts.filter(pa.array(odd)).to_pylist())
        feed = self._ids(["\n"])[0]
        parts = [
            self._pieces(pieces.take(pa.array(spaced)), " "),
            self._pieces(pc.utf8_slice_codeunits(pieces.take(pa.array(lines)), 1), ""),
            self._pieces(first.dictionary, ""),
            (np.array([len(x) for x in whole], np.int64), np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in whole)])),
            (np.array([1]), np.array([end], np.uint32)),
            (np.array([len(feed)]), np.array(feed, np.uint32)),
        ]
        sizes = np.concatenate([p[0] for p in parts])
        flat = np.concatenate([p[1] for p in parts])
        base = np.cumsum([0] + [len(p[0]) for p in parts])

        # What each text is made of, as places in `sizes`: its pieces, line feeds before some, its end.
        place = np.zeros(len(pieces), np.int64)
        place[spaced] = np.arange(len(spaced))
        place[lines] = base[1] + np.arange(len(lines))
        own = place[codes]
        own[offsets[:-1][~odd]] = base[2] + first.indices.to_numpy()
        text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        use = ~odd[text_of]
        feeds = fed[codes] & use
        feeds[offsets[:-1]] = False
        width = np.where(use, 1 + feeds, 0)
        odd_places = offsets[:-1][odd]
        width[odd_places] = 1
        own[odd_places] = base[3] + np.arange(len(odd_places))
        last = offsets[1:] - 1
        width[last] += 1
        to = np.cumsum(width)
        made = np.full(to[-1] if len(to) else 0, base[5], np.int64)
        keep = use.copy()
        keep[odd_places] = True
        ending = np.zeros(len(codes), np.int64)
        ending[last] = 1
        made[(to - 1 - ending)[keep]] = own[keep]
        made[to[last] - 1] = base[4]

        counts, ids = _spread(sizes, flat, made)
        return np.diff(np.cumsum(counts)[to[last] - 1], prepend=0), ids


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END_ID, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Writes `docs` in ascending order of `key` (null first); `(part, path, documents, ids, base)` per file.

    `base` is the number of ids in the files before. `tokenizer` is the path of a tokenizer file, which each
    executor has; by default the one of the installed package. Texts that are null are empty; rows that
    repeat a key lie side by side. Texts, not ids, are dealt out by ranges of the key.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, writer, name, documents = TaskContext.get().partitionId(), None, None, None, 0
        for batch in batches:
            if writer is None:
                encoder = Encoder(tokenizer or _default_tokenizer())
                name = new_file(folder, part, ".ids")
                writer = TokenFileWriter(name)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            # Long texts make large batches: cut them where their sum passes a bound.
            cuts = np.unique(np.searchsorted(sizes, np.arange(0, sizes[-1] if len(sizes) else 0, BATCH_BYTES), side="right"))
            for at, to in zip(cuts, [*cuts[1:], batch.num_rows] if len(cuts) else []):
                rows = batch.slice(at, to - at)
                counts, ids = encoder.encode(rows.column(1), end)
                writer.add(rows.column(0).to_pylist(), counts, ids)
            documents += batch.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [name],
                "documents": pa.array([documents], pa.int64()), "ids": pa.array([writer.ids], pa.int64()),
            })

    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("key").sortWithinPartitions("key", "text")
    files = materialize(ordered.mapInArrow(write, "part int, path string, documents long, ids long"), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return materialize(files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")), "token-files")


def read_token_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document of the files: `(key, path, start, n_tokens, ids_crc32)`, all decoded from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(path)
                starts = base + np.cumsum(file.counts) - file.counts
                yield pa.RecordBatch.from_pydict({
                    key: file.keys, "path": pa.array([path] * len(starts), pa.string()), "start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(file.counts, pa.int64()), "ids_crc32": pa.array(file.checksums(), pa.int64()),
                })

    spread = files.select("path", "base").repartition(max(1, files.count()))
    return spread.mapInArrow(read, f"`{key}` long, path string, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes `docs` and reads the files back: `(doc_id, start, n_tokens, ids_crc32)`.

    An empty table gives no files and no rows.
    """
    files = write_token_files(docs, folder or new_folder(docs.sparkSession, "tokens"), tokenizer)
    return read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")
