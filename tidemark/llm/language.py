"""Language identification: scripts narrow candidates, Viterbi labels the spans of mixed texts.

A word is scored for each language by character trigrams (log probabilities, hashed to a table of
fixed size). The script of its letters leaves only languages that use the script in the training
texts. Words of a text then get the sequence of languages of greatest total score, where each change
costs a penalty; sequences are found for all texts of a slab at once by composing blocks of words in
the (max, +) semiring, so a very long text takes no longer than many short ones.

Training takes the whole texts of a bounded sample (``FIT_DOCUMENTS`` documents, those first by a
hash of doc_id) of rows with text and language. Trigrams are counted where the texts are; the model
has a fixed size for each language. Prediction covers whole texts of all rows and sees nothing but
the text.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is every text if there
is nothing to learn from. Ties go to the language first by name. Repeated rows are predicted alike
and each is returned. A very long text is a slab by itself, found in blocks. Columns besides doc_id,
text and (for learning) lang are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kit
from tidemark.session import prepare, table

#: Labelled documents that the model is fitted on at most.
FIT_DOCUMENTS = 6000
BUCKETS = 1 << 15
SWITCH = 6.0
BLOCK = 64
UND = "und"

# First code points of script ranges, and what begins there.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x30000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS], dtype=np.int64)
_KIND = np.array([NAMES.index(name) for _, name in SCRIPTS], dtype=np.int64)


@cache
def letters() -> np.ndarray:
    """For every code point whether it is a letter or a mark, as 2 (letter), 1 (mark) or 0."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8)


@cache
def lowered() -> np.ndarray:
    """Simple lower case of every code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


class Letters:
    """Words (runs of letters and marks) of a slab, with a trigram bucket for each character."""

    def __init__(self, column: pa.Array) -> None:
        buf, offsets = kit.raw(column)
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        bounds = np.searchsorted(lead, offsets)
        kinds = letters()[points]
        start, end = kit.runs(kinds > 0, bounds)
        real = np.add.reduceat(kinds == 2, start) > 0 if len(start) else np.zeros(0, bool)
        self.start, self.end = start[real], end[real]
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.bounds = bounds
        low = lowered()[points].astype(np.uint64)
        inside = np.zeros(len(points), dtype=bool)
        n = self.end - self.start
        self.at = np.repeat(self.start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        inside[self.at] = True
        edge = np.where(inside, low, np.uint64(0x20))
        before = np.concatenate([[np.uint64(0x20)], edge[:-1]])
        after = np.concatenate([edge[1:], [np.uint64(0x20)]])
        before[self.start] = after[self.end - 1] = np.uint64(0x20)
        self.bucket = (kit.mix(before[self.at] << np.uint64(42) | low[self.at] << np.uint64(21) | after[self.at]) >> np.uint64(49)).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
        self.size = n
        first_letter = self.start + (kinds[self.start] == 1)
        self.script = _KIND[np.searchsorted(_STARTS, points[np.minimum(first_letter, len(points) - 1)], side="right") - 1] if len(points) else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray  # [bucket, language] log probability
    allowed: np.ndarray  # [script, language] whether the language uses the script

    def words(self, text: Letters) -> np.ndarray:
        """Scores of words by language; what the script rules out scores as low as never seen."""
        if not len(text.start):
            return np.zeros((0, len(self.languages)), np.float32)
        total = np.add.reduceat(self.score[text.bucket], text.begin, axis=0)
        allowed = self.allowed[text.script]
        some = allowed.any(axis=1)
        low = total.min(axis=1, keepdims=True) - 30
        return np.where(allowed | ~some[:, None], total, low).astype(np.float32)


def tallies(texts: pa.Array) -> np.ndarray:
    """How often each trigram bucket and, after them, each script occurs."""
    text = Letters(texts)
    return np.concatenate([np.bincount(text.bucket, minlength=BUCKETS), np.bincount(text.script, minlength=len(NAMES))])


def fit(counts: dict[str, np.ndarray]) -> Model:
    """Trigram log probabilities by language from the tallies of labelled texts."""
    languages = sorted(counts)
    both = np.array([counts[x] for x in languages], dtype=np.float64).reshape(len(languages), BUCKETS + len(NAMES)).T
    trigrams, scripts = both[:BUCKETS] + 0.2, both[BUCKETS:]
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    return Model(languages, np.log(trigrams / trigrams.sum(axis=0, keepdims=True)).astype(np.float32), share > 0.001)


def learn(docs: DataFrame) -> Model:
    """A model of the rows given, from the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in kit.slabs(batch):
                for lang in pc.unique(part.column("lang")).to_pylist():
                    one = tallies(part.filter(pc.equal(part.column("lang"), lang)).column("text"))
                    own[lang] = own[lang] + one if lang in own else one
        for lang, one in own.items():
            at = np.flatnonzero(one)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(one[at])], names=["lang", "place", "n"])

    usable = docs.where("lang is not null").select("doc_id", "lang", "text")
    rows = kit.sample(usable, FIT_DOCUMENTS).where("text is not null").select("lang", "text").mapInArrow(run, "lang string, place bigint, n bigint")
    found = rows.groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    counts = {lang: np.zeros(BUCKETS + len(NAMES)) for lang in pc.unique(found["lang"]).to_pylist()}
    for lang, one in counts.items():
        mine = found.filter(pc.equal(found["lang"], lang))
        one[mine["place"].to_numpy()] = mine["n"].to_numpy()
    return fit(counts)


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The language of each word: the best sequence of each row, ``first`` bounding the rows."""
    total, k = score.shape
    if not total or k < 2:
        return np.zeros(total, dtype=np.int64)
    n = np.diff(first)
    blocks = -(-n // BLOCK)
    row = np.repeat(np.arange(len(n)), blocks)
    order = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[row] + order * BLOCK
    size = np.minimum(first[row + 1] - begin, BLOCK)
    by_size = np.argsort(-size, kind="stable")  # so that at step i the blocks longer than i lead
    begin, size = begin[by_size], size[by_size]
    live = [int(np.searchsorted(-size, -i, side="left")) for i in range(BLOCK)]
    reach = np.full((len(begin), k, k), -np.inf, dtype=np.float32)  # from the language before to the last
    reach[:, np.arange(k), np.arange(k)] = 0
    for i in range(BLOCK):
        if not (m := live[i]):
            break
        r = reach[:m]
        reach[:m] = np.maximum(r, r.max(axis=2, keepdims=True) - penalty) + score[begin[:m] + i][:, None, :]
    place = np.empty(len(by_size), dtype=np.int64)
    place[by_size] = np.arange(len(by_size))
    enter = np.zeros((len(begin), k), dtype=np.float32)  # best totals before each block
    at = np.cumsum(blocks) - blocks
    now = np.zeros((len(n), k), dtype=np.float32)
    for step in range(int(blocks.max(initial=0))):
        rows = np.flatnonzero(blocks > step)
        where = place[at[rows] + step]
        enter[where] = now[rows]
        now[rows] = (now[rows][:, :, None] + reach[where]).max(axis=1)
    back = np.zeros((total, k), dtype=np.int8)
    v = enter.copy()
    for i in range(BLOCK):
        if not (m := live[i]):
            break
        top = v[:m].argmax(axis=1)
        other = v[:m].max(axis=1) - penalty
        stay = v[:m] >= other[:, None]
        back[begin[:m] + i] = np.where(stay, np.arange(k), top[:, None])
        v[:m] = np.where(stay, v[:m], other[:, None]) + score[begin[:m] + i]
    # where each last language leads back to, then the choice from the last block to the first
    path = np.empty((total, k), dtype=np.int8)
    came = np.tile(np.arange(k, dtype=np.int8), (len(begin), 1))
    for i in range(BLOCK - 1, -1, -1):
        m = live[i]
        if m:
            path[begin[:m] + i] = came[:m]
            came[:m] = np.take_along_axis(back[begin[:m] + i], came[:m].astype(np.int64), axis=1)
    end = np.zeros(len(begin), dtype=np.int64)
    last = now.argmax(axis=1)
    for step in range(int(blocks.max(initial=0)) - 1, -1, -1):
        rows = np.flatnonzero(blocks > step)
        where = place[at[rows] + step]
        end[where] = last[rows]
        last[rows] = came[where, last[rows]]
    of = np.repeat(end[place], size[place])
    return path[np.arange(total), of].astype(np.int64)


SCHEMA = "doc_id bigint, lang_pred string, score double, spans array<struct<start:bigint,stop:bigint,lang:string>>"


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """Per document its main language, that language's share of the letters, and the spans.

    A span is a run of words of one language, in code points from its first to its last word.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            for part in kit.slabs(batch):
                lang, score, runs_of = label(part.column("text"), sent.value, spans)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(runs_of, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def label(column: pa.Array, model: Model, spans: bool) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    text, k = Letters(column), len(model.languages)
    rows = len(text.count)
    out: list[list[dict]] = [[] for _ in range(rows)]
    if not k or not len(text.start):
        return [UND] * rows, np.zeros(rows), out
    chosen = viterbi(model.words(text), text.first)
    row = np.repeat(np.arange(rows), text.count)
    weight = np.bincount(row * k + chosen, weights=text.size, minlength=rows * k).reshape(rows, k)
    total = weight.sum(axis=1)
    best = weight.argmax(axis=1)
    if spans:
        new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(chosen))
        base = text.bounds[row[a]]
        for r, s, e, c in zip(row[a].tolist(), (text.start[a] - base).tolist(), (text.end[b - 1] - base).tolist(), chosen[a].tolist(), strict=True):
            out[r].append({"start": s, "stop": e, "lang": model.languages[c]})
    return [model.languages[i] if t else UND for i, t in zip(best.tolist(), total.tolist(), strict=True)], np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1), 0.0), out


def fold(column: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def confident(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents, in their columns, that have a language; those without letters go.

    A text goes also where no language has ``least`` of its letters. ``lang`` stays as given.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                lang, score, _ = label(part.column("text"), sent.value, False)
                yield part.filter(pa.array([x != UND and s >= least for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold("doc_id", 5) != 0))
    found = identify(docs, model, spans=False)
    return found.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(-1)) == 0).alias("held_out"), "lang_pred", "score")
