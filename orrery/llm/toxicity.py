"""Toxicity of text restored from disguise by a noisy-channel model.

Words may be spelled with look-alike digits and signs, stretched by repeated letters, or spaced
out. Each token spans a lattice, and so does each run of single characters with white space
between them: every character can stand for itself, for a letter it looks like, or for nothing (a
separator, a space, or one more of the same letter). Viterbi decoding picks the path that a
character trigram model, counted over all documents, finds likeliest, and with it where the words
of a spaced run end. Tokens with nothing to restore have one path and skip the decoder.

The score of a restored text comes from how often its words, and the beginnings of its words,
stand in toxic texts among the labelled ones. Words and their scores are remembered by worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import Names, documents, slices, spool, struct_of, unspool, windows, without, words

#: Labelled rows the scores are learned from, at most: those with the smallest hashes of their ids.
MOST_LABELLED = 20_000
#: A feature's share of toxic texts counts PRIOR_TEXTS texts of the overall share beside its own.
PRIOR_TEXTS = 4.0
#: The raw score of a text, from the three highest shares among its words. Scores are raw ones,
#: stretched on both sides of the cut that parts the learned texts best, which becomes THRESHOLD.
SHARES = (0.8, 0.15, 0.05)
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7)
SLOTS = 1 << 22
MOST_WORDS = 300_000
#: Characters and the letters they stand in for (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y",
}
SEPARATORS = set(".-_*~·'`^=/\\")
#: Costs of reading a character as another, as nothing, and as one more of the letter before.
AS_LETTER, AS_NOTHING, AS_MORE = 2.0, 2.5, 1.5
ADDED = ["held_out", "score", "predicted"]

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
EDGE, OTHER = 0, 1
N_CLASSES = len(_LETTERS) + 2
_CLASS = {c: i + 2 for i, c in enumerate(_LETTERS)}
_TABLE = np.full(0x110000, EDGE, dtype=np.int32)
_TABLE[[ord(c) for c in "0123456789@$!|+(€£¥"]] = OTHER
_TABLE[0x100:0x250] = OTHER
_TABLE[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS)) + 2
#: Runs of tokens of one or two characters; those with three or more single ones may be spaced-out words.
_SPACED = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2,}(?!\S)")
_ADDRESS = re.compile(r"@.*\.|://")
_STRETCHED = re.compile(r"(.)\1\1")


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character trigrams of a task's texts, by number."""
    total = np.zeros(N_CLASSES**3, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            c = _TABLE[np.frombuffer(f"  {(text or '').lower()} ".encode("utf-32-le", errors="replace"), dtype=np.uint32)]
            total += np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=len(total)) if len(c) > 50_000 else 0
            if len(c) <= 50_000:
                found, n = np.unique((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], return_counts=True)
                total[found] += n
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["trigram", "n"])


class Channel:
    """Restores tokens under a character trigram model given as counts by trigram number."""

    def __init__(self, trigrams: np.ndarray, counts: np.ndarray) -> None:
        table = np.full(N_CLASSES**3, 0.1)
        table[trigrams] += counts
        table = table.reshape(N_CLASSES, N_CLASSES, N_CLASSES)
        self.cost = -np.log(table / table.sum(2, keepdims=True))

    def restore(self, token: str) -> str:
        """The likeliest reading of a lower-case token, or of a run of tokens with single spaces between them."""
        # By the last two classes: cost, and the reading as links to what comes before.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for ch in token:
            readings = [(ch, 0.0), *((x, AS_LETTER) for x in LOOKALIKES.get(ch, ""))]
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (u, v), (cost, text) in states.items():
                options = [((v, w), cost + extra + self.cost[u, v, w], (text, x)) for x, extra in readings for w in [EDGE if x == " " else _CLASS.get(x, OTHER)]]
                if ch in SEPARATORS or ch == " ":
                    options.append(((u, v), cost + AS_NOTHING, text))
                if text and text[1] != " " and text[1] in (ch, *LOOKALIKES.get(ch, "")):
                    options.append(((u, v), cost + AS_MORE, text))
                for state, total, reading in options:
                    if state not in step or total < step[state][0]:
                        step[state] = (total, reading)
            states = step
        (u, v), (_, link) = min(states.items(), key=lambda s: s[1][0] + self.cost[s[0][0], s[0][1], EDGE])
        spelled = []
        while link:
            link, ch = link
            spelled.append(ch)
        return "".join(reversed(spelled))

    def words(self, token: str) -> list[str]:
        """The words of a token, or of a run with spaces: trimmed, in lower case, restored if there is anything to restore."""
        low = token.lower()
        if " " in low:
            return self.restore(low).split()
        core = low.strip("\"'.,;:?!()[]{}<>#%&*-_~`^=/\\…«»“”")
        if core.isalpha():
            return [self.restore(core) if _STRETCHED.search(core) else core]
        core = low.strip("\"'.,;:?()[]{}<>#%&*-_~`^=/\\…«»“”").rstrip("!")
        disguised = any(c.isalpha() for c in core) and all(c.isalpha() or c in LOOKALIKES or c in SEPARATORS for c in core) and not _ADDRESS.search(core)
        return [self.restore(core) if disguised and 3 * sum(c in LOOKALIKES for c in core) <= 2 * len(core) else core]


def features(words: list[str]) -> list[int]:
    """Numbers of words and of their beginnings."""
    parts = [p for word in words if word for p in (f"={word}", *(word[:k] for k in BEGINNINGS if len(word) >= k))]
    return [zlib.crc32(p.encode(errors="replace")) & (SLOTS - 1) for p in parts]


def tokens(text: str) -> set[str]:
    """The distinct tokens of a text, and its runs that may be spaced-out words, with single spaces."""
    found = set(text.split())
    for run in _SPACED.findall(text):
        parts = run.split()
        if sum(len(p) == 1 for p in parts) >= 3:
            found.add(" ".join(parts))
    return found


class _Memory(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, token: str):
        if len(self) >= MOST_WORDS:
            self.clear()
        self[token] = made = self.make(token)
        return made


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With each labelled text its smallest 5-word shingle hash, which near copies mostly share."""
    for batch in batches:
        texts = [t.encode(errors="replace") for t in batch.column(0).to_pylist()]
        for a, b in slices(texts):
            hashes, where, _ = words(texts[a:b], fold=True)
            runs, at = windows(hashes, where, 5)
            keys = np.array([zlib.crc32(t) for t in texts[a:b]], dtype=np.uint64)
            owners, first = np.unique(where[at], return_index=True)
            if len(first):
                keys[owners] = np.minimum.reduceat(runs, first)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(i).slice(a, b - a) for i in (0, 1))], ["key", "text", "label"])


def _feature_counts(channel: Channel):
    """Counts of a task's distinct labelled texts by feature: all, and toxic ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(lambda token: features(channel.words(token)))
        every, toxic = np.zeros(SLOTS, dtype=np.int32), np.zeros(SLOTS, dtype=np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.fromiter({f for t in tokens(text or "") for f in memory[t]}, dtype=np.int64)
                every[found] += 1
                if label:
                    toxic[found] += 1
        found = np.flatnonzero(every)
        for at in range(0, len(found), 200_000):
            part = found[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(every[part]), pa.array(toxic[part])], ["feature", "n", "t"])

    return counted


class Scorer:
    def __init__(self, channel: Channel, shares: dict[int, float], prior: float) -> None:
        self.prior = prior

        def share(token: str) -> float:
            return max([prior, *(shares[f] for f in features(channel.words(token)) if f in shares)])

        self.share = _Memory(share)

    def score(self, text: str) -> float:
        top = sorted(map(self.share.__getitem__, tokens(text)), reverse=True)[: len(SHARES)]
        return float(sum(w * s for w, s in zip(SHARES, [*top, *[self.prior] * (len(SHARES) - len(top))])))


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score that parts the labels with the highest F1, in the middle between two scores."""
    order = np.argsort(-scores, kind="stable")
    scores, labels = scores[order], labels[order] > 0
    hits = np.cumsum(labels)
    f1 = 2 * hits / (np.arange(1, len(labels) + 1) + labels.sum())
    f1[:-1][scores[:-1] == scores[1:]] = 0  # no cut between equal scores
    if not len(f1) or not f1.max():
        return THRESHOLD
    k = int(np.argmax(f1))
    return float(np.clip((scores[k] + (scores[k + 1] if k + 1 < len(scores) else 0.0)) / 2, 1e-6, 1 - 1e-6))


def _scored(trigrams: np.ndarray, counts: np.ndarray, shares: dict[int, float], prior: float, cut: float = THRESHOLD):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Channel(trigrams, counts), shares, prior)
        for batch in batches:
            raw = np.array([scorer.score(t or "") for t in batch.column(0).to_pylist()], dtype=float)
            scores = np.where(raw < cut, raw * THRESHOLD / cut, THRESHOLD + (raw - cut) * (1 - THRESHOLD) / (1 - cut))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(scores, 0.0, 1.0)), batch.column(1)], ["score", "row"])

    return scored


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Every row of docs, less its text, with held_out, score (0 to 1) and predicted (0 or 1).

    Only labels of rows that aren't held out are learned from: at most MOST_LABELLED, and copies
    and most near copies count once. Null labels are left out; without any label every score is 0. A null text
    counts as empty; an empty one scores the share of toxic texts among the labelled. Repeated
    rows and null ids are scored like others. Columns of docs named like an added column, in any
    case, are replaced; all other names are free. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    grams = docs.select(text).mapInArrow(_trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    grams = grams.orderBy("trigram").toPandas()  # at most N_CLASSES ** 3 rows
    channel = (grams["trigram"].to_numpy(dtype=np.int64), grams["n"].to_numpy(dtype=np.int64))
    chosen = (
        labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("id"))
        .agg(F.max(label_col).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(MOST_LABELLED)
    )
    learned = docs.select(F.col(f"`{id_col}`").alias("id"), text).join(F.broadcast(chosen), "id")
    learned = learned.select("text", "label").mapInArrow(_keyed, f"key long, text string, label {chosen.schema['label'].dataType.simpleString()}")
    learned = spool(learned.groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label")).select("text", "label"), "learned")
    counts = learned.mapInArrow(_feature_counts(Channel(*channel)), "feature long, n int, t int").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    # The empty text's only feature is none at all: the overall share comes from the labels.
    overall = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("t")).first()
    prior = overall["t"] / overall["n"] if overall["n"] else 0.0
    share = (F.col("t") + PRIOR_TEXTS * prior) / (F.col("n") + PRIOR_TEXTS)
    strong = counts.select("feature", share.alias("share")).where(F.col("share") > max(0.3, 1.5 * prior)).toPandas()  # at most SLOTS rows
    shares = dict(zip(strong["feature"].tolist(), strong["share"].tolist()))
    tried = learned.select("text", F.struct("label").alias("row")).mapInArrow(_scored(*channel, shares, prior), f"score double, row struct<label:{learned.schema['label'].dataType.simpleString()}>")
    tried = tried.select("score", F.col("row.label").cast("double").alias("label")).toPandas()  # at most MOST_LABELLED rows
    cut = best_cut(tried["score"].to_numpy(dtype=float), tried["label"].to_numpy(dtype=float))
    unspool(learned)
    names = Names(without(docs, [text_col, *ADDED]).columns)
    packed = docs.select(text, F.struct(names.pack().alias("own"), held_out(id_col).alias("held_out")).alias("row"))
    scored = packed.mapInArrow(_scored(*channel, shares, prior, cut), struct_of(packed, score="double"))
    own = [c.alias(n) for n, c in zip(names.columns, names.unpack("row.own"))]
    return scored.select(*own, "row.held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "labels").select("doc_id", "toxic"))
