"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is a lattice of pieces. Forward filtering sums the weights of all paths to each place;
backward sampling then draws one path from the end, each piece with its exact posterior chance.
Draws are hashes of (seed, row key, place in the row), so a row is always cut the same way,
whatever its batch, partition or attempt.

The vocabulary is a SentencePiece model with byte pieces. Such models rank pieces and give no
chances, so a piece of rank r weighs 1 / (r + RANK_SHIFT) to the power `sharpness`, bytes weigh
least. Pieces hold blanks at their front only, so the lattice falls apart into words; equal words
of a chunk share their forward pass, and all words of a chunk are sampled together, step by step.

Decoding joins the bytes of the pieces and takes the first blank away; it gives the text back for
every input, a literal U+2581 and control characters included.

Defined results: a null text gives null ids, an empty text no ids; a text of any length is encoded
whole, one chunk holds at least one word; repeated rows with equal keys get equal ids; a null key
is hashed like any other value; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import small_batches

MARK = "▁"
LITERAL = "\ud800"  # stands for a U+2581 of the text; no valid text holds it
CHUNK = 1_000_000  # characters encoded at once inside a batch
RANK_SHIFT = 10.0
BYTE_WEIGHT = 1e-6
COMMON = 120  # letters with a dense table


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Vocabulary:
    """Pieces as a trie in arrays: `keys` holds node * letters + letter in order, `targets` the node reached."""

    def __init__(self, model_file: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = np.zeros(256, dtype=np.int32)
        normal: list[tuple[str, int]] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} has a blank behind its front")
                normal.append((piece, i))
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        letters = sorted({c for piece, _ in normal for c in piece})
        self.letters = len(letters) + 1
        self.letter_of = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        self.letter_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: k for k, c in enumerate(letters, 1)}
        edges: dict[int, int] = {}
        piece_at = [-1]
        for piece, i in normal:
            node = 0
            for c in piece:
                key = node * self.letters + number[c]
                if key not in edges:
                    edges[key] = len(piece_at)
                    piece_at.append(-1)
                node = edges[key]
            piece_at[node] = i
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.targets = np.array([edges[k] for k in self.keys.tolist()], dtype=np.int32)
        self.first = np.zeros(self.letters, dtype=np.int32)  # the node behind the root by letter, 0: none
        for c, k in number.items():
            self.first[k] = edges.get(k, 0)
        self.piece_at = np.array(piece_at, dtype=np.int32)
        self.longest = max(len(piece) for piece, _ in normal)
        # ids from `size` on stand for characters spelt in 1 to 4 bytes, the last one for no piece
        self.spelt = size
        self.weight = np.zeros(size + 5)
        self.count = np.ones(size + 5, dtype=np.int64)
        rank = {i: k for k, (_, i) in enumerate(sorted(normal, key=lambda p: (-model.get_score(p[1]), p[1])))}
        for i, k in rank.items():
            self.weight[i] = (k + RANK_SHIFT) ** -sharpness
        for k in range(4):
            self.weight[size + k] = (BYTE_WEIGHT * 10.0**-k) ** sharpness
            self.count[size + k] = k + 1
        # the letters with most continuations have a table of their own, the others are searched for
        used, times = np.unique(self.keys % self.letters, return_counts=True)
        common = used[np.argsort(-times, kind="stable")[:COMMON]]
        self.column = np.full(self.letters, -1, dtype=np.int64)
        self.column[common] = np.arange(len(common))
        self.table = np.zeros((len(self.piece_at), len(common)), dtype=np.int32)
        listed = self.column[self.keys % self.letters] >= 0
        self.table[self.keys[listed] // self.letters, self.column[self.keys[listed] % self.letters]] = self.targets[listed]
        lines = "" if any("\n" in piece for piece, _ in normal) else "\n"
        # a cut before each run of blanks and around line ends, where no piece can reach across
        self.words = re.compile(rf"{lines}|{MARK}+[^{MARK}{lines}]*|[^{MARK}{lines}]+" if lines else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")


    def follow(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes behind `node` by `letter`, 0 for none."""
        column = self.column[letter]
        out = self.table[node, np.maximum(column, 0)]
        rare = np.flatnonzero(column < 0)
        if len(rare):
            key = node[rare].astype(np.int64) * self.letters + letter[rare]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[spot] == key, self.targets[spot], 0)
        return out


@lru_cache(maxsize=2)
def vocabulary(model_file: str, sharpness: float) -> Vocabulary:
    return Vocabulary(model_file, sharpness)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, per element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattice:
    """All pieces that fit into some distinct words, with the chance of each given the place where it ends.

    Characters are numbered depth by depth (all first characters, then all second ones, longest word
    first), so one forward step of all words is a few operations on slices. `bound` holds, for the place
    behind every character, the running chance of the pieces of 1, 2, ... characters that end there.
    """

    def __init__(self, vocab: Vocabulary, words: list[str]):
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(-sizes, kind="stable")
        self.row = np.empty(len(words), dtype=np.int64)  # place of a word among the sorted ones
        self.row[order] = np.arange(len(words))
        sizes = sizes[order]
        codes = np.frombuffer("".join([words[k] for k in order]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        deepest = int(sizes[0])
        self.width = np.append(np.searchsorted(-sizes, -np.arange(1, deepest + 1), side="right"), 0)  # words by depth
        self.base = np.concatenate(([0], np.cumsum(self.width)))[:-1]
        row = np.repeat(np.arange(len(words)), sizes)
        depth = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = self.base[depth] + row
        self.code = np.empty(len(codes), dtype=np.uint32)
        self.code[place] = codes
        letter = vocab.letter_of[self.code]
        step = np.repeat(self.width[:-1], self.width[:-1])  # from a character to the next of its word
        has_next = np.zeros(len(codes), dtype=bool)
        has_next[place] = depth + 1 < sizes[row]
        none = vocab.spelt + 4
        self.piece = np.full((len(codes), min(vocab.longest, deepest)), none, dtype=np.int32)  # by start and size
        start = now = np.arange(len(codes))
        node = vocab.first[letter]
        used = np.zeros(self.piece.shape[1], dtype=bool)
        for size in range(self.piece.shape[1]):
            alive = node > 0
            start, now, node = start[alive], now[alive], node[alive]
            found = vocab.piece_at[node]
            hit = found >= 0
            self.piece[start[hit], size] = found[hit]
            used[size] = bool(hit.any())
            more = has_next[now]
            start, now, node = start[more], now[more], node[more]
            now = now + step[now]
            node = vocab.follow(node, letter[now])
        lone = np.flatnonzero(self.piece[:, 0] == none)  # characters without a piece are spelt in bytes
        if len(lone):
            self.code[lone[self.code[lone] == ord(LITERAL)]] = ord(MARK)
            code = self.code[lone]
            self.piece[lone, 0] = vocab.spelt + (code >= 0x80) + (code >= 0x800).astype(np.int32) + (code >= 0x10000)
        used[0] = True
        self.bound = np.zeros(self.piece.shape, dtype=np.float32)
        before = [np.ones(len(words))]  # sums of all paths to the places 1, 2, ... characters back, last sum = 1
        for end in range(deepest):
            width, low = self.width[end], self.base[end]
            total = np.zeros(width)
            bound = self.bound[low:low + width]
            for size in range(self.piece.shape[1]):
                if size <= end and used[size]:
                    first = self.base[end - size]
                    total = total + before[size] * vocab.weight[self.piece[first:first + width, size]]
                bound[:, size] = total
            bound /= bound[:, -1:]
            after = self.width[end + 1]
            before = [np.ones(after)] + [
                np.minimum(b[:after] / total[:after], 1e290) for b in before[:self.piece.shape[1] - 1]]


def _sample(vocab: Vocabulary, words: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order and the number of ids per word; `draws` has one hash per word."""
    number: dict[str, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    distinct = list(number)
    lattice = Lattice(vocab, distinct)
    sizes = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
    row, depth = lattice.row[code], sizes[code] - 1  # the last character not yet covered
    here = np.arange(len(words))
    taken, picked, begun = [], [], []
    total = np.zeros(len(words), dtype=np.int64)
    step = np.zeros(1, dtype=np.uint64)
    while len(here):
        hashed = _mix(draws[here] + step * np.uint64(0x9E3779B97F4A7C15))
        chance = ((hashed >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24))[:, None]
        size = (lattice.bound[lattice.base[depth] + row] <= chance).sum(axis=1)
        depth = depth - size
        begin = lattice.base[depth] + row
        piece = lattice.piece[begin, size]
        taken.append(here)
        picked.append(piece)
        begun.append(begin)
        total[here] += vocab.count[piece]
        going = depth > 0
        here, row, depth = here[going], row[going], depth[going] - 1
        step += np.uint64(1)
    ids = np.empty(int(total.sum()), dtype=np.int32)
    behind = np.cumsum(total)  # paths are drawn from the end, so ids fill up backwards
    for here, piece, begin in zip(taken, picked, begun, strict=True):
        behind[here] -= vocab.count[piece]
        to = behind[here]
        plain = piece < vocab.spelt
        ids[to[plain]] = piece[plain]
        for at, first in zip(to[~plain], begin[~plain], strict=True):
            spelt = chr(lattice.code[first]).encode("utf-8", "surrogatepass")
            ids[at:at + len(spelt)] = vocab.byte_ids[list(spelt)]
    return ids, total


def encode_texts(vocab: Vocabulary, texts: list[str | None], keys: list[int], chunk: int = CHUNK) -> Iterator[np.ndarray | None]:
    """Sampled ids of every text; `keys` are 64-bit row hashes."""
    words: list[str] = []
    draws: list[np.ndarray] = []
    rows: list[tuple[int, int] | None] = []  # pieces of a text that are ready, words still to do
    size = 0
    parts: list[list[np.ndarray]] = []

    def finish() -> None:
        nonlocal size
        if words:
            ids, counts = _sample(vocab, words, np.concatenate(draws))
            ends = np.concatenate(([0], np.cumsum(counts)))
            for k, (low, high) in spans:
                parts[k].append(ids[ends[low]:ends[high]])
        words.clear()
        draws.clear()
        spans.clear()
        size = 0

    spans: list[tuple[int, tuple[int, int]]] = []
    for text, key in zip(texts, keys, strict=True):
        parts.append([])
        rows.append(None if text is None else (0, 0))
        if not text:
            continue
        found = vocab.words.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK))
        base = np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        hashes = _mix(base + np.arange(1, len(found) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        low = 0
        if size + len(text) < chunk:
            spans.append((len(parts) - 1, (len(words), len(words) + len(found))))
            words.extend(found)
            draws.append(hashes)
            size += len(text) + 1
            continue
        while low < len(found):  # a text longer than a chunk is done in several
            high, room = low, chunk - size
            while high < len(found) and (room > 0 or high == low):
                room -= len(found[high])
                high += 1
            spans.append((len(parts) - 1, (len(words), len(words) + high - low)))
            words.extend(found[low:high])
            draws.append(hashes[low:high])
            size = chunk - room
            low = high
            if size >= chunk:
                finish()
    finish()
    for row, pieces in zip(rows, parts, strict=True):
        yield None if row is None else (np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32))


def decode_ids(vocab: Vocabulary, ids: list[int] | np.ndarray) -> str:
    """The text of some ids; bytes that are no UTF-8 become replacement characters."""
    raw = b"".join(map(vocab.bytes_of.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _key(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def encode(
    rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, sharpness: float = 1.0,
    model_file: str | None = None, check: bool = True,
) -> DataFrame:
    """doc_id, ids, n_pieces and, with `check`, whether decoding gives the text back (null for null texts)."""
    path = model_file or default_model()
    small_batches(rows.sparkSession)
    chosen = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _key(seed, F.col(id_col)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, sharpness)
        for batch in batches:
            low = 0
            sizes = pc.utf8_length(batch.column("text")).to_pylist()
            while low < batch.num_rows:  # bounded output batches: the ids of a chunk or of one long text
                size, high = 0, low
                while high < batch.num_rows and (high == low or size + (sizes[high] or 0) <= CHUNK):
                    size += sizes[high] or 0
                    high += 1
                part = batch.slice(low, high - low)
                low = high
                texts = part.column("text").to_pylist()
                ids = list(encode_texts(vocab, texts, part.column("key").to_pylist()))
                lossless = [None if t is None else decode_ids(vocab, i.tolist()) == t for t, i in zip(texts, ids, strict=True)
                            ] if check else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                    pa.array([None if i is None else len(i) for i in ids], pa.int64()), pa.array(lossless, pa.bool_()),
                ], ["doc_id", "ids", "n_pieces", "lossless"])

    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, ids array<int>, n_pieces long, lossless boolean")


def decode(rows: DataFrame, *, ids_col: str = "ids", out: str = "text", model_file: str | None = None) -> DataFrame:
    """`rows` with the text of their ids in `out`."""
    path = model_file or default_model()
    small_batches(rows.sparkSession)

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        vocab = vocabulary(path, 1.0)
        return pd.Series([None if i is None else decode_ids(vocab, list(i)) for i in ids])

    return rows.withColumn(out, text_of(F.col(ids_col)))
