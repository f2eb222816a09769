"""Resampling, collocations and line dedup against brute force over odd rows, on every way they have."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import collocations, lines, resample

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, batch int, block bigint, h1 bigint, rank string, below string, words string"
rng = random.Random(3)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = ["the", "The", "data", "New", "York", "city", "é", "Straße", "日本", "x" * 90, "a\x00b", "don't", "İ"]


def made_up():
    texts = [None, "", "\n", " \t\n\x0b", "one", "one two", "x" * 5000, " ".join(rng.choice(VOCAB) for _ in range(30_000)), "A line.\r\n  a LINE.\t\n\x0cA line.", "\n\n\n", "end\n"]
    for i in range(60):
        body = [" ".join(rng.choice(VOCAB) for _ in range(rng.randrange(1, 12))) + rng.choice([".", ",", ";", "", "!?"]) for _ in range(rng.randrange(1, 9))]
        texts.append(rng.choice(["\n", " ", "\r\n"]).join([*body, *["  Read MORE here \t"] * (i % 3), *["menu | home"] * (i % 2)]))
    rows = [(i, t, [None, "en", "fr"][i % 3], None if i % 4 else "s", None, 7, 8, 9, "r", "b", "w") for i, t in enumerate(texts)]
    return rows + [rows[20]] * 3 + [(None, texts[21], "en", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


ROWS = made_up()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4).persist()


def split_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER).encode())


def features(text):
    w = split_words(text)
    return [b" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resampled(rows, target, percent):
    s, t = (Counter(zlib.crc32(f) % 10_000 for text in texts for f in features(text)) for texts in ([r[1] for r in rows], target))
    a, b = sum(s.values()), sum(t.values())
    gain = {x: math.floor(1000 * math.log((t[x] + 1) * (a + 10_000) / ((s[x] + 1) * (b + 10_000)))) for x in range(10_000)}
    out = []
    for r in rows:
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % 10_000] for f in features(r[1]))
        out.append([r[0], len(features(r[1])), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((-x[3], x[0] is not None, x[0] or 0, i) for i, (x, r) in enumerate(zip(out, rows, strict=True)) if len(split_words(r[1])) >= 20)
    for place, x in enumerate(enough[: percent * len(enough) // 100]):
        out[x[3]][4] = place + 1
    return out


@pytest.mark.parametrize("percent", [5, 40])
def test_resampling_against_brute_force(spark, docs, percent):
    target = [None, "", "New York city data", "the 日本 straße " * 20]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    found = [list(r) for r in resample.resampled(docs, benchmark, percent).collect()]
    assert sorted(found, key=repr) == sorted(brute_resampled(ROWS, target, percent), key=repr)
    taken = {r[0] for r in found if r[4]}
    assert {r.doc_id for r in resample.drawn(docs, benchmark, percent=percent).collect()} == taken


def test_resampling_of_nothing(spark, docs):
    none, no_items = docs.limit(0), spark.createDataFrame([], "item_id bigint, text string")
    assert resample.resampled(none, no_items).collect() == []
    assert resample.resampled(docs, no_items).count() == len(ROWS)


def test_checksums_go_on():
    texts = [bytes(rng.randrange(1, 255) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 300]))) for _ in range(200)]
    buf, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    first = resample.advanced(np.full(200, resample.ONES), buf, bounds[:-1], bounds[1:])
    both = resample.advanced(first, buf, bounds[:-1][::-1], bounds[1:][::-1])
    assert (first ^ resample.ONES).tolist() == [zlib.crc32(t) for t in texts]
    assert (both ^ resample.ONES).tolist() == [zlib.crc32(t + u) for t, u in zip(texts, texts[::-1], strict=True)]


def test_resampling_leans_to_the_target(spark):
    near, far = "patient dose trial therapy clinic".split(), "goal match league striker coach".split()
    rows = [(i, " ".join(rng.choice(near if i % 4 == 0 else far) for _ in range(60))) for i in range(400)]
    target = spark.createDataFrame([(0, " ".join(near * 40))], "item_id bigint, text string")
    ids = [r.doc_id for r in resample.drawn(spark.createDataFrame(rows, "doc_id bigint, text string"), target, percent=20).collect()]
    assert len(ids) == 80 and all(i % 4 == 0 for i in ids)


def brute_mined(rows, least, top, cover=80):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r[1] or "").translate(LOWER)):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            f[lang].update(w[i : i + k] for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        some = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        listed = []
        for p, a in some.items():
            if 100 * longer[p] < cover * a:
                score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(listed)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top,sent", [(30, 2000, 1 << 20), (5, 2000, 0), (3, 7, 1 << 20), (200, 50, 0)])
def test_collocations_against_brute_force(docs, monkeypatch, least, top, sent):
    monkeypatch.setattr(collocations, "GATHERED", 500)
    if top < 100:
        monkeypatch.setattr(collocations, "ONE_NUMBER", 0)
    assert sorted(tuple(r) for r in collocations.mined(docs, least=least, top=top, sent_most=sent).collect()) == brute_mined(ROWS, least, top)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    words = [rng.choice(VOCAB).encode() for _ in range(300)]
    buf, bounds = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    monkeypatch.setattr(collocations.kit, "byte_hash", lambda buf, start, end, which=0: (end - start).astype(np.uint64))
    first, which = collocations._distinct_words(buf, bounds[:-1], bounds[1:])
    assert [words[first[w]] for w in which] == words and len(first) == len(set(words))


def test_collocations_of_nothing(docs):
    assert collocations.mined(docs.limit(0)).collect() == []
    assert collocations.mined(docs.where("text is null")).collect() == []


def test_scores_pass_64_bits(spark):
    a = 9 * 10**17
    row = spark.createDataFrame([(["u", "v"], a, [a, a], [a + 1, a])], "words array<string>, f bigint, firsts array<bigint>, lasts array<bigint>")
    assert row.select(collocations.lowest_cut(2_000_000).alias("c")).first().c.score == 2_000_000 * a // (2 * a + 1)


def brute_lines(rows, least_docs, least_chars):
    strip = " \t\n\x0b\x0c\r"
    of = [[(x, x.strip(strip).translate(LOWER)) for x in (r[1] or "").split("\n")] for r in rows]
    count = Counter(k for d in of for k in {k for _, k in d if len(k) >= max(1, least_chars)})
    out = []
    for r, d in zip(rows, of, strict=True):
        kept = [x for x, k in d if count[k] < least_docs]
        out.append((r[0], len(d), len(d) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least_docs,least_chars,batches,sent", [(10, 1, 4, 1 << 20), (10, 1, 4, 0), (2, 1, 7, 0), (3, 6, 1, 1 << 20), (1, 1, 3, 0)])
def test_lines_against_brute_force(docs, least_docs, least_chars, batches, sent):
    found = lines.dedup(docs, least_docs, least_chars, batches, sent)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_lines(ROWS, least_docs, least_chars)


def test_lines_of_nothing(docs):
    assert lines.dedup(docs.limit(0)).collect() == []


def test_runs_are_levelled_and_know_what_is_new(spark):
    """With a threshold of one the runs are the lines seen so far, and a batch is left with its new ones."""
    seen = set()
    with lines.Runs(spark, threshold=1) as runs:
        for i in range(6):
            batch = {(rng.randrange(40), rng.randrange(3)) for _ in range(30)}
            rows = spark.createDataFrame([(a, b, 1) for a, b in batch for _ in range(2)], "h1 bigint, h2 bigint, n bigint")
            assert {(r.h1, r.h2) for r in runs.unsettled(rows).collect()} == batch - seen
            runs.add(rows)
            seen |= batch
            assert [len(level) for level in runs.levels] == [int(x) for x in reversed(f"{i + 1:b}")]
        assert {(r.h1, r.h2) for r in runs.frequent().collect()} == seen
        plan = runs.unsettled(rows)._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan
        names = list(runs.made)
    assert not any(spark.catalog.tableExists(n) for n in names)
