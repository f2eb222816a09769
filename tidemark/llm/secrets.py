"""Secret scans: fixed patterns, and character Markov models of random strings against identifiers.

Every run of identifier characters, and what the patterns leave of one, is scored by the
log-likelihood ratio of two second-order character models; runs of fewer than ``MIN_RUN`` characters
are too short to tell. Both models are fitted on labelled samples: random strings are pattern
matches in a bounded sample of documents and seeded draws from usual alphabets; ordinary
identifiers are the words of the same sample, alone and joined as programs join them, numbers and
dates, and rulers (one character again and again). Counting takes place where the texts are.

Edge cases: null and empty texts have no spans; repeated rows are each reported; ties are ordered
by start, then by kind as listed in ``KINDS``; a text full of hits costs as much as its length; an
empty table fits on the drawn strings alone and gives an empty result; columns besides doc_id and
text are ignored (``masked`` keeps them), whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kit
from tidemark.llm.decontaminate import characters
from tidemark.session import prepare, table

#: Documents that the models are fitted on at most, and identifiers made of the words of each.
FIT_DOCUMENTS, IDENTIFIERS = 2000, 4
MIN_RUN, MIN_RATIO = 16, 0.75
KINDS = ("assign", "access", "hex", "random")
MASK = "[SECRET]"

# The patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = ~kit.table_of([(0x30, 0x39), (0x61, 0x66)])
RUN = ~kit.table_of([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x2F, 0x2F), (0x5F, 0x5F), (0x3D, 0x3D), (0x2D, 0x2D)])
ALPHABET = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
SYMBOL = np.full(256, len(ALPHABET), dtype=np.int64)
SYMBOL[list(ALPHABET)] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET) + 1

SPANS = "doc_id bigint, spans array<struct<kind:string,start:bigint,stop:bigint>>"


def _counts(strings: list[bytes]) -> np.ndarray:
    out = np.zeros((SIZE, SIZE, SIZE))
    for s in strings:
        if len(s) > 2:
            x = SYMBOL[np.frombuffer(s, dtype=np.uint8)]
            np.add.at(out, (x[:-2], x[1:-1], x[2:]), 1)
    return out


def _model(three: np.ndarray) -> np.ndarray:
    """Log probabilities of a character after two, smoothed by those after one, and after none."""
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 4 * p1) / (two.sum(1, keepdims=True) + 4)
    return np.log((three + 4 * p2) / (three.sum(2, keepdims=True) + 4))


def drawn(seed: int = 11, n: int = 4000) -> list[bytes]:
    """Labelled random strings: draws from the alphabets of usual keys."""
    rng = np.random.default_rng(seed)
    alphabets = [b"0123456789abcdef", b"0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[:36], ALPHABET[:10] + ALPHABET[36:62]]
    return [bytes(rng.choice(list(alphabets[i % len(alphabets)]), size=int(rng.integers(16, 64))).astype(np.uint8)) for i in range(n)]


#: Ordinary words besides those of the sample.
COMMON = [b"value", b"index", b"count", b"parameter", b"document", b"version", b"identifier", b"configuration", b"description", b"management"]


def joined(words: list[bytes], seed: int = 12, n: int = 8000) -> list[bytes]:
    """Labelled ordinary identifiers: words alone and joined as in programs and paths."""
    rng = np.random.default_rng(seed)
    words, out = words or COMMON, []
    for i in range(n):
        pick = [words[int(k)] for k in rng.integers(0, len(words), size=int(rng.integers(1, 5)))]
        tail = b"%d" % rng.integers(0, 3000) if rng.random() < 0.3 else b""
        style = (i + seed) % 6
        if style == 0:
            out.append(b"_".join(pick) + tail)
        elif style == 1:
            out.append(b"".join([pick[0].lower(), *(p.capitalize() for p in pick[1:])]) + tail)
        elif style == 2:
            out.append(b"-".join(pick) + (b"-" + tail if tail else b""))
        elif style == 3:
            out.append(b"/".join(pick) + tail)
        elif style == 4:
            out.append(b"_".join(p.upper() for p in pick) + (b"_" + tail if tail else b""))
        else:
            out.append(b"".join(pick) + tail)
    return out


def rulers(seed: int = 13) -> list[bytes]:
    """Labelled ordinary runs that are no words: one character again and again, counts and dates."""
    rng = np.random.default_rng(seed)
    dates = [b"%d-%02d-%02d/%02d" % (rng.integers(1970, 2040), rng.integers(1, 13), rng.integers(1, 29), rng.integers(0, 24)) for _ in range(200)]
    return [bytes([c]) * 24 for c in ALPHABET for _ in range(8)] + [b"0123456789", b"1234567890", ALPHABET[36:62], ALPHABET[10:36]] * 8 + dates


def fit(docs: DataFrame) -> np.ndarray:
    """The log-likelihood ratio of each character after two others.

    The labelled sample is the whole texts of FIT_DOCUMENTS documents (those first by a hash of
    doc_id); everything else about the operator covers all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE, SIZE, SIZE))
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text.encode()
                words = sorted(set(re.findall(rb"[A-Za-z]+", text)))
                counts[0] += _counts([text[a:b] for _, a, b in base(text, _hex_runs(text))])
                if words:
                    counts[1] += _counts(words + joined(words, (i or 0) % (1 << 32), IDENTIFIERS))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at].astype(np.int64))], names=["place", "n"])

    rows = kit.sample(docs.select("doc_id", "text"), FIT_DOCUMENTS).where("text is not null")
    found = rows.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * SIZE**3)
    counts[found["place"].to_numpy()] = found["n"].to_numpy()
    random, ordinary = counts.reshape(2, SIZE, SIZE, SIZE)
    return (_model(random + _counts(drawn())) - _model(ordinary + _counts(joined([]) + rulers()))).astype(np.float32)


def _hex_runs(text: bytes) -> list[tuple[int, int]]:
    x = np.frombuffer(text, dtype=np.uint8)
    a, b = kit.runs(HEX[x], np.array([0, len(x)]))
    return [(s, e) for s, e in zip(a.tolist(), b.tolist(), strict=True) if e - s >= 32]


def base(text: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of the fixed patterns' matches; ``hexes`` are known."""
    out = [(2, a, b) for a, b in hexes]
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out


def _split(starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Spans by row, relative to it."""
    rows = np.searchsorted(offsets, starts, side="right") - 1
    out: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(rows.tolist(), (starts - offsets[rows]).tolist(), (ends - offsets[rows]).tolist(), strict=True):
        out.setdefault(r, []).append((a, b))
    return out


def _left(runs: list[tuple[int, int]], fixed: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What spans (sorted) leave of runs (in order), in pieces of MIN_RUN or more."""
    k = 0
    for s, e in runs:
        while k < len(fixed) and fixed[k][1] <= s:
            k += 1
        j = k
        while j < len(fixed) and fixed[j][0] < e:
            if fixed[j][0] - s >= MIN_RUN:
                yield s, fixed[j][0]
            s = max(s, fixed[j][1])
            j += 1
        if e - s >= MIN_RUN:
            yield s, e


def spans_of(column: pa.Array, ratio: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text (kind, start, end), in code points, sorted."""
    buf, offsets = kit.raw(column)
    a, b = kit.runs(HEX[buf], offsets)
    keep = b - a >= 32
    hexes = _split(a[keep], b[keep], offsets)
    a, b = kit.runs(RUN[buf], offsets)
    keep = b - a >= MIN_RUN
    scored = _split(a[keep], b[keep], offsets)
    whole, out = buf.tobytes(), []
    for i in range(len(offsets) - 1):
        text = whole[offsets[i] : offsets[i + 1]]
        found = base(text, hexes.get(i, []))
        fixed = sorted((s, e) for _, s, e in found)
        for s, e in _left(scored.get(i, []), fixed):
            x = SYMBOL[np.frombuffer(text[s:e], dtype=np.uint8)]
            if ratio[x[:-2], x[1:-1], x[2:]].mean() >= MIN_RATIO:
                found.append((3, s, e))
        if found:
            chars = characters(np.frombuffer(text, dtype=np.uint8))
            found = sorted((int(chars[s]), k, int(chars[e])) for k, s, e in found)
            found = [(k, s, e) for s, k, e in found]
        out.append(found)
    return out


def find(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """Per document all spans (code points, end exclusive); ``ratio`` as ``fit`` returns it."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs) if ratio is None else ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for part in kit.slabs(batch):
                rows = [[{"kind": KINDS[k], "start": s, "stop": e} for k, s, e in spans] for spans in spans_of(part.column("text"), sent.value)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)


def masked(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """The documents, all of them and in their columns, with a mask in place of each secret."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs) if ratio is None else ratio)

    def hide(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for _, s, e in spans:
            if e > at:
                out += [text[at:s], MASK] if s >= at else []
                at = e
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slabs(batch):
                spans = spans_of(part.column("text"), sent.value)
                if not any(spans):
                    yield part
                    continue
                names, columns = part.schema.names, list(part.columns)
                text = columns[names.index("text")].to_pylist()
                text = [hide(t, s) if s else t for t, s in zip(text, spans, strict=True)]
                columns[names.index("text")] = pa.array(text, part.schema.field("text").type)
                if "n_chars" in names:
                    old = columns[names.index("n_chars")]
                    columns[names.index("n_chars")] = pa.array([len(t) if s else n for t, s, n in zip(text, spans, old.to_pylist(), strict=True)], old.type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    fixed = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(line(fixed).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))
