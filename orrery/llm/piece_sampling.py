"""SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text is cut into units at its spaces, the space going with the unit after it. The lattice of a
unit holds every vocabulary piece that matches somewhere in it, and the bytes of characters that
no piece covers. Forward filtering sums the weights of all segmentations up to each place;
backward sampling then draws, from the end, each piece in proportion to the weight of all
segmentations it completes. So a segmentation is drawn with its exact share.

All units of a slice of texts go through both steps together, as arrays: a trie finds the pieces
that end at each character, the sums go forward one character of all units at a time, and the
draws go back one piece of all units at a time. Units longer than LONGEST characters are cut
where no piece could reach across, and what is still longer has a lattice of its own.

The draw that ends at a place of a text is a hash of the row's key, the seed and that place alone:
the same row gets the same pieces wherever and however often it is computed. Spaces are the only
characters rewritten, and a text's own U+2581 goes by bytes, so that decoding gives back the very
text.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import Names, documents, mix, struct_of, text_slices, without

SPACE = "▁"
#: A piece of rank r in the vocabulary weighs (r + 1) ** -SHARPNESS. A higher one keeps to frequent pieces.
SHARPNESS = 1.0
SEED = 7
#: Text bytes whose units are handled together, and characters of a unit in the arrays.
SLICE_BYTES, LONGEST = 1 << 18, 64
#: Units of a long text that are looked up at once.
MOST_WORDS = 1 << 15
_UNIT = re.compile(r" [^ ]*|[^ ]+")
ADDED = ["pieces"]


class Vocabulary:
    """Pieces with their weights, as a dictionary and as a trie in arrays. A space stands for the mark."""

    def __init__(self, path: str, sharpness: float = SHARPNESS) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes.append(piece.replace(SPACE, " ").encode())
            usable = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            if usable and SPACE not in piece[1:]:  # units hold a space at their beginning only
                self.pieces[piece.replace(SPACE, " ")] = (i, (1.0 - model.get_score(i)) ** -sharpness)
        self.byte_weight = (1.0 + len(self.pieces)) ** -sharpness
        #: The bytes that each piece spells, one after another.
        self.spelled = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        #: Neighbouring characters that some piece holds side by side. A lattice falls apart between others.
        self.bigrams = {piece[k : k + 2] for piece in self.pieces for k in range(len(piece) - 1)}
        self.longest = max(map(len, self.pieces))
        nodes = {"": 0}
        for piece in sorted(self.pieces):
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        self.step = np.full((len(nodes), 128), -1, dtype=np.int32)
        self.ids, self.weights = np.full(len(nodes), -1, dtype=np.int32), np.zeros(len(nodes))
        wide: dict[int, int] = {}
        for text, node in nodes.items():
            if text:
                up, code = nodes[text[:-1]], ord(text[-1])
                if code < 128:
                    self.step[up, code] = node
                else:
                    wide[up << 21 | code] = node
                if text in self.pieces:
                    self.ids[node], self.weights[node] = self.pieces[text]
        #: Steps by other characters: node << 21 | character, sorted, and where they lead.
        self.wide = np.array(sorted(wide), dtype=np.int64)
        self.wide_to = np.array([wide[k] for k in sorted(wide)], dtype=np.int32)

    def follow(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to, -1 where none."""
        to = np.full(len(nodes), -1, dtype=np.int32)
        plain = codes < 128
        to[plain] = self.step[nodes[plain], codes[plain]]
        if len(self.wide) and not plain.all():
            keys = nodes[~plain].astype(np.int64) << 21 | codes[~plain]
            at = np.minimum(np.searchsorted(self.wide, keys), len(self.wide) - 1)
            to[~plain] = np.where(self.wide[at] == keys, self.wide_to[at], -1)
        return to

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()

    def decode_all(self, pieces: pa.ListArray) -> pa.StringArray:
        """The texts that lists of ids spell; null for null."""
        ids = pieces.flatten().to_numpy()
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        data = self.spelled[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy()
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.large_string()).cast(pa.string())
        return pc.if_else(pieces.is_valid(), texts, pa.scalar(None, pa.string()))


class Lattice:
    """One unit of any length: for each place the running sums of weights, beginnings and ids of the pieces that end there.

    A piece's weight comes with that of all segmentations up to its beginning. Both are scaled by
    TILT for each character, which all segmentations share, and every BLOCK characters by the
    greatest sum, lest long units leave the range of floats.
    """

    TILT, BLOCK = 20.0, 64

    def __init__(self, unit: str, vocabulary: Vocabulary) -> None:
        n, longest = len(unit), vocabulary.longest
        sums: list[list[float]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        ids: list[list[int]] = [[] for _ in range(n + 1)]
        sums[0].append(1.0)
        self.log_scale = -n * math.log(self.TILT)
        pieces = vocabulary.pieces
        for i, ch in enumerate(unit):
            so_far = sums[i][-1]
            for j in range(i + 1, min(n, i + longest) + 1):
                piece = pieces.get(unit[i:j])
                if piece is None and j == i + 1:
                    piece = (-1 - ord(ch), vocabulary.byte_weight ** len(ch.encode()))
                if piece is not None:
                    at = sums[j]
                    at.append((at[-1] if at else 0.0) + so_far * piece[1] * self.TILT ** (j - i))
                    starts[j].append(i)
                    ids[j].append(piece[0])
            if i % self.BLOCK == self.BLOCK - 1:
                top = max(at[-1] for at in sums[i + 1 : i + 1 + longest] if at)
                for k in range(i + 1, min(n, i + longest) + 1):
                    sums[k] = [x / top for x in sums[k]]
                self.log_scale += math.log(top)
        self.sums, self.starts, self.ids = sums, starts, ids

    @property
    def log_sum(self) -> float:
        return math.log(self.sums[-1][-1]) + self.log_scale

    def draw(self, uniform: Callable[[int], float]) -> list[int]:
        """The ids of a segmentation drawn from all of them; below 0 a character that goes by bytes. uniform gives the draw for a place."""
        sums, starts, ids = self.sums, self.starts, self.ids
        at, drawn = len(sums) - 1, []
        while at:
            here = sums[at]
            # The longest piece comes first here and last in the arrays of Units.
            k = min(bisect_right(here, (1.0 - uniform(at)) * here[-1]), len(here) - 1)
            drawn.append(ids[at][k])
            at = starts[at][k]
        return drawn[::-1]


class Units:
    """Distinct units of up to LONGEST characters with, for each character, the shares of the pieces that end there.

    Characters lie by their place in the unit, then by unit, longest first: those of one place, and
    those before them, are ranges of arrays.
    """

    def __init__(self, units: list[str], vocabulary: Vocabulary) -> None:
        self.sizes = np.array([len(u) for u in units], dtype=np.int64)
        by_size = np.argsort(-self.sizes, kind="stable")
        self.rank = np.empty_like(by_size)
        self.rank[by_size] = np.arange(len(by_size))
        sizes, longest, most = self.sizes[by_size], int(self.sizes.max(initial=0)), vocabulary.longest
        rows = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # units with a character at each place
        self.first = np.cumsum(rows) - rows
        n = int(rows.sum())
        owner = np.repeat(self.rank, self.sizes)
        nth = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        codes = np.empty(n, dtype=np.int64)
        codes[self.first[nth] + owner] = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        weights, self.ids, node = np.zeros((n, most)), np.zeros((n, most), dtype=np.int32), np.zeros(n, dtype=np.int32)
        for k in range(most):
            inside = nth + k < sizes[owner]
            owner, nth, node = owner[inside], nth[inside], node[inside]
            at = self.first[nth + k] + owner
            node = vocabulary.follow(node, codes[at])
            known = node >= 0
            owner, nth, node, at = owner[known], nth[known], node[known], at[known]
            if not len(at):
                break
            whole = vocabulary.ids[node] >= 0
            weights[at[whole], k] = vocabulary.weights[node[whole]]
            self.ids[at[whole], k] = vocabulary.ids[node[whole]]
        # A character that is no piece goes by its bytes.
        alone = np.flatnonzero(weights[:, 0] == 0)
        n_bytes = 1 + (codes[alone] >= 0x80) + (codes[alone] >= 0x800) + (codes[alone] >= 0x10000)
        weights[alone, 0] = vocabulary.byte_weight**n_bytes
        self.ids[alone, 0] = -1 - codes[alone]
        # The sums of all segmentations up to each place, and the running shares of the pieces that end there.
        sums, self.shares = [np.ones(len(units))], np.ones((n, most))
        for r, (a, m) in enumerate(zip(self.first.tolist(), rows.tolist()), 1):
            wide = min(r, most)
            running = np.empty((wide, m))
            for k in range(wide):
                np.multiply(weights[a : a + m, k], sums[r - 1 - k][:m] * Lattice.TILT ** (k + 1), out=running[k])
                if k:
                    running[k] += running[k - 1]
            sums.append(running[-1].copy())
            running /= running[-1]
            self.shares[a : a + m, :wide] = running.T

    def draw(self, unit: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For occurrences of units, with their rows' keys and their places in their texts: the pieces drawn from the end on.

        Returns the occurrence, the step from the end and the id of each.
        """
        left, active = self.sizes[unit], np.arange(len(unit))
        drawn, step = [], 0
        while len(active := active[left[active] > 0]):
            at = self.first[left[active] - 1] + self.rank[unit[active]]
            x = uniform(key[active], place[active] + left[active])
            k = np.minimum((self.shares[at] <= x[:, None]).sum(axis=1), self.shares.shape[1] - 1)
            drawn.append((active, np.full(len(active), step), self.ids[at, k]))
            left[active] -= k + 1
            step += 1
        return tuple(np.concatenate(x) for x in zip(*drawn)) if drawn else (np.zeros(0, dtype=np.int64),) * 3


def uniform(key, place):
    """The draw of a row for a place of its text, in [0, 1)."""
    with np.errstate(over="ignore"):
        h = mix(np.asarray(key, dtype=np.uint64) + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


class _Numbers(dict):
    """Numbers its keys in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Sampler:
    def __init__(self, vocabulary: Vocabulary, seed: int = SEED) -> None:
        self.vocabulary, self.seed = vocabulary, seed

    def key(self, key: str) -> int:
        return xxhash.xxh3_64_intdigest(key.encode(errors="replace"), self.seed)

    def _cut(self, unit: str) -> list[str]:
        """A long unit's parts: no piece could reach across, so they draw as one."""
        bigrams, cuts = self.vocabulary.bigrams, [0]
        cuts += [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in bigrams]
        return [unit[a:b] for a, b in zip(cuts, [*cuts[1:], len(unit)])]

    def encode_all(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of all texts in one array, and the number of each text's."""
        known, long = _Numbers(), []
        unit, row, place = [], [], []
        hashes = np.array([self.key(k) for k in keys], dtype=np.uint64)
        found, counts, size, n_units = [], np.zeros(len(texts), dtype=np.int64), 0, 0

        def flush() -> None:
            if unit:
                ids, rows = self._drawn(list(known), *map(np.concatenate, (unit, row, place)), long, hashes)
                found.append(ids)
                counts[:] += np.bincount(rows, minlength=len(texts))
            for x in (known, unit, row, place, long):
                x.clear()

        for i, text in enumerate(texts):
            words, at = _UNIT.findall(text), 0
            for k in range(0, len(words), MOST_WORDS):
                part = words[k : k + MOST_WORDS]
                if max(map(len, part)) > LONGEST:
                    part = [y for x in part for y in ([x] if len(x) <= LONGEST else self._cut(x))]
                sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
                for z in np.flatnonzero(sizes > LONGEST).tolist():  # such an occurrence has a lattice of its own
                    long.append((n_units + z, part[z]))
                    part[z] = ""
                unit.append(np.fromiter(map(known.__getitem__, part), dtype=np.int64, count=len(part)))
                row.append(np.full(len(part), i))
                place.append(at + np.cumsum(sizes) - sizes)
                at, size, n_units = at + int(sizes.sum()), size + int(sizes.sum()), n_units + len(part)
                if size >= SLICE_BYTES:
                    flush()
                    size, n_units = 0, 0
        flush()
        return np.concatenate([*found, np.zeros(0, dtype=np.int32)]), counts

    def _drawn(self, known: list[str], unit: np.ndarray, row: np.ndarray, place: np.ndarray, long: list[tuple[int, str]], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids drawn for occurrences of units, in their order, and the row of each."""
        which, step, ids = Units(known, self.vocabulary).draw(unit, hashes[row], place)
        parts = [(which, -step, ids.astype(np.int64))]
        for occurrence, text in long:
            draws = uniform(hashes[row[occurrence]], place[occurrence] + np.arange(len(text) + 1))
            drawn = Lattice(text, self.vocabulary).draw(draws.__getitem__)
            parts.append((np.full(len(drawn), occurrence), np.arange(len(drawn)), np.array(drawn, dtype=np.int64)))
        which, step, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((step, which))
        ids, rows = ids[order], row[which[order]]
        by_bytes = np.flatnonzero(ids < 0)
        if len(by_bytes):
            spelled = [np.frombuffer(chr(-1 - c).encode(), dtype=np.uint8) for c in ids[by_bytes].tolist()]
            sizes = np.ones(len(ids), dtype=np.int64)
            sizes[by_bytes] = [len(b) for b in spelled]
            ids, rows, bytewise = np.repeat(ids, sizes), np.repeat(rows, sizes), np.repeat(ids < 0, sizes)
            ids[bytewise] = self.vocabulary.byte_ids[np.concatenate(spelled)]
        return ids.astype(np.int32), rows

    def encode(self, text: str, key: str) -> list[int]:
        """Sampled piece ids of a text, the same for the same key and seed."""
        return self.encode_all([text], [key])[0].tolist()


@cache
def _sampler(path: str, seed: int) -> Sampler:
    return Sampler(Vocabulary(path), seed)


def _encoded(path: str, seed: int):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(path, seed)
        for batch in batches:
            for a, b, texts in text_slices(batch, 0, SLICE_BYTES):
                ids, counts = sampler.encode_all([t.decode() for t in texts], batch.column(1).slice(a, b - a).to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), batch.column(2).slice(a, b - a)], ["pieces", "row"])

    return encoded


def _key(id_col: str):
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))


def encode(docs: DataFrame, model_path: str, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs, less its text, with an array of piece ids.

    A null or empty text has no pieces. The key is the id as text; rows that repeat an id draw
    alike, and null ids share one key. A column named pieces, in any case, is replaced; all other
    names are free. An empty table gives an empty table.
    """
    own = without(docs, [text_col, *ADDED]).columns
    names = Names(own)
    packed = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), _key(id_col).alias("key"), names.pack().alias("row"))
    return packed.mapInArrow(_encoded(model_path, seed), struct_of(packed, pieces="array<int>")).select(*names.unpack(), "pieces")


def decode(docs: DataFrame, model_path: str, pieces_col: str = "pieces", text_col: str = "text") -> DataFrame:
    """docs with the text that each array of piece ids spells.

    Null pieces give a null text, no pieces an empty one. A column named like text_col is
    replaced; all other names are free. An empty table gives an empty table.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _sampler(model_path, SEED).vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([vocabulary.decode_all(part.column(0)), part.column(1)], ["text", "row"])

    names = Names(without(docs, [text_col]).columns)
    packed = docs.select(F.col(f"`{pieces_col}`").alias("pieces"), names.pack().alias("row"))
    return packed.mapInArrow(decoded, struct_of(packed, text="string")).select(*names.unpack(), F.col("text").alias(text_col))


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column(0)
        ids, ends = pieces.values.to_numpy().astype("<u4"), pieces.offsets.to_numpy()
        crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64()), batch.column(2)], ["doc_id", "n_pieces", "ids_crc32", "lossless"])


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of each document's sampled pieces, and whether decoding them gives back the text (null: empty)."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode(encode(docs.withColumn("original", F.col("text")), path), path)
    rows = back.select("pieces", "doc_id", (F.col("text") == F.col("original")).alias("lossless"))
    return rows.mapInArrow(_crcs, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
