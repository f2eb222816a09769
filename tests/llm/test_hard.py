"""Hard inputs: strings that defeat sums of powers, hot keys, clashing names, every way of an operator."""

import hashlib
import random
import re
import string
import struct
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import bpe, chat, decontaminate, jaccard, kit, language, licenses, quality, queries, secrets, substrings, winnow
from tidemark.session import table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LETTERS = string.ascii_letters


def thue_morse(k, a="a", b="b"):
    """Two strings of 2**k letters that have equal sums of powers modulo 2**64 from k = 11 on."""
    x, y = a, b
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


X, Y = thue_morse(11)


def test_hashes_tell_thue_morse_strings_apart():
    for k in range(1, 13):
        words = kit.Words(pa.array(thue_morse(k)), kit.SPACED, lower=False, second=True)
        assert words.hash[0] != words.hash[1] and words.hash2[0] != words.hash2[1]
    a, b = (kit.Words(pa.array([" ".join(t)]), kit.SPACED, lower=False) for t in thue_morse(4))
    for n in (2, 4, 8, 13, 16):
        rows = [{w[i : i + n] for i in range(17 - n)} for w in thue_morse(4)]
        got = [set(kit.window_hash(w.hash, n, kit.window_starts(w.first, n)).tolist()) for w in (a, b)]
        assert len(got[0] | got[1]) == len(rows[0] | rows[1])


def test_equal_hashes_of_other_slices_are_seen():
    buf = np.frombuffer(b"abcdefgh1abcdefgh2abcdefgh1" + b"z" * 300 + b"z" * 299 + b"y", dtype=np.uint8)
    start, end = np.array([0, 9, 18, 27, 327]), np.array([9, 18, 27, 327, 627])
    assert kit.same_bytes(buf, start, end, np.array([0, 0, 0, 3, 3])).tolist() == [True, False, True, True, False]


def test_collisions_do_not_reach_results(spark, monkeypatch):
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{X} {rest}"), (2, f"{Y} {rest}"), (3, X), (4, Y)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.clustered(docs.where("doc_id > 2")).collect()} == {3: 3, 4: 4}
    assert {r.n_removed for r in substrings.dedup(docs).collect()} == {0}
    item = spark.createDataFrame([(9, f"{X} {' '.join(rest.split()[:9])}")], "item_id bigint, text string")
    for bound in (decontaminate.BROADCAST_BYTES, 0):
        assert {r.doc_id: r.n_hit for r in decontaminate.scan(docs, item, broadcast_bytes=bound).collect()} == {1: 10, 2: 0, 3: 0, 4: 0}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.decode(bpe.encode(docs, bpe.production_ranks()), bpe.production_ranks()).collect()
    assert {r.doc_id: r.text for r in got} == texts


def test_bpe_compares_pieces_of_equal_hash(monkeypatch):
    with open(bpe.production_ranks(), "rb") as f:
        own = bpe.Vocabulary(f.read())
    texts = pa.array(["one two three", "four two six one", None, ""])
    want = own.encode(texts)[0].tolist()
    monkeypatch.setattr(kit, "byte_hash", lambda buf, start, end, which=0: (end - start).astype(np.uint64) % np.uint64(2))
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)  # the cache starts anew again and again
    for _ in range(3):
        assert own.encode(texts)[0].tolist() == want


def test_decontamination_compares_windows_of_equal_hash(monkeypatch):
    monkeypatch.setattr(kit, "window_hash", lambda h, n, starts: np.full(len(starts), 7, dtype=np.uint64))
    index = decontaminate.build([(1, "a b c"), (2, "a b d"), (3, "A b c"), (4, "x"), (1, "a b c")], 3)
    assert sorted(index.size.tolist()) == [1, 3, 3] and len(index.owner) == 4
    words = kit.Words(pa.array(["z a b d x a b c"]), kit.ALNUM, lower=True)
    at, window = decontaminate.hits_of(words, index)
    items = sorted((a, tuple(index.owner[index.bounds[w] : index.bounds[w + 1]].tolist())) for a, w in zip(at.tolist(), window.tolist(), strict=True))
    assert items == [(1, (2,)), (4, (4,)), (5, (1, 3))]


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_allocations_leave_similar_sets_a_signature(percent):
    """What two similar sets must share is more than what each may leave out."""
    for band in range(50):
        a = jaccard.allocation(band, percent)
        hi = int(jaccard.bands(percent)[band + 1]) - 1
        most = 2 * hi * (100 - percent) // (100 + percent)
        if not most:
            assert not any(a)
        elif a.deleted:
            assert a.exact + 2 * a.deleted > most and a.empties == a.frequent == 0 and a.common == 1
        else:
            assert a.exact - most - a.empties - a.frequent > a.common or (a.empties + a.frequent == 0 and a.exact > most and a.common == 1)


def brute_components(texts, n, percent):
    sets = {i: {tuple(t.split()[j : j + n]) for j in range(len(t.split()) - n + 1)} for i, t in texts.items()}
    root = {i: i for i in texts}
    ids, changed = sorted(texts), True
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("n,percent,ids", [(5, 80, 10**6), (3, 90, 0), (2, 60, 10**6)])
def test_jaccard_with_a_hot_passage(spark, monkeypatch, n, percent, ids):
    """Half of all texts share a passage, groups of near copies are among them; either way to fetch sets."""
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", ids)
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    rng = random.Random(n)
    hot, texts = [f"h{i}" for i in range(30)], {}
    for g in range(50):
        base = [f"v{rng.randrange(900)}" for _ in range(rng.choice([8, 20, 60, 150]))] + (hot if g % 2 else [])
        for _ in range(rng.choice([1, 1, 2, 9])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(900)}"
            texts[len(texts)] = " ".join(words)
    got = jaccard.clustered(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5), n, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_components(texts, n, percent)


def xx(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_print(text, k=winnow.K, w=winnow.W):
    """(hash, position) of the chosen grams."""
    tokens = [t for run in re.findall(r"[^\x20\x09-\x0D]+", text or "") for t in ([run] if len(run) <= 16 else run)]
    h = [xx([t]) for t in tokens]
    grams = [xx(h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else [xx(h)] * bool(h)
    grams = [((g % (1 << 64)) >> 25, i) for i, g in enumerate(grams)]
    windows = [grams[i : i + w] for i in range(len(grams) - w + 1)] if len(grams) > w else [grams] * bool(grams)
    return sorted({min(x, key=lambda e: (e[0], -e[1])) for x in windows}, key=lambda e: e[1])


def brute_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnowing_against_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t", "one", "a b c d", "x" * 16, "x" * 17, "日本語" * 40, "áé " * 9, "😀" * 30 + " end"]
    texts += [" ".join(rng.choice(["the", "of", "a" * 20, "日本語テキストがここにある長い文", "x1", "end."]) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    texts += [texts[15], texts[15]]
    docs = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    for _ in range(2):
        got = {r.doc_id: r for r in winnow.edited(docs).collect()}
        for i, t in enumerate(texts):
            t, nxt, r = t or "", texts[(i + 1) % len(texts)] or "", got[2 * i]
            changed = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            prints = [brute_print(x) for x in (t, changed, nxt)]
            assert [r.fingerprint, r.edited_fingerprint] == [",".join(f"{h:x}@{at}" for h, at in p) for p in prints[:2]]
            assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.n_chars == len(t)
            assert np.allclose([r.near_edited, r.near_next], [brute_likeness(prints[0], p) for p in prints[1:]])
        docs = docs.withColumnRenamed("doc_id", "doc_id").repartition(7)


def test_winnowing_of_unspaced_text_survives_a_shift(spark):
    rng = random.Random(4)
    text = "".join(rng.choice(LETTERS) for _ in range(400))
    rows = [(1, text), (2, "yyy" + text), (3, text[:200] + "-" + text[200:])]
    got = {r.doc_id: {x.split("@")[0] for x in r.fingerprint.split(",")} for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got[1] & got[2]) > 0.9 * len(got[1]) and len(got[1] & got[3]) > 0.8 * len(got[1])


def test_winnowing_deals_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_BYTES", 40)
    rows = [(rng_id, f"text {rng_id}") for rng_id in random.Random(5).sample(range(10**6), 300)]
    ordered = sorted(rows)
    got = {r.doc_id: r.next.text for r in winnow.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), []).collect()}
    assert got == {d: ordered[(i + 1) % 300][1] for i, (d, _) in enumerate(ordered)}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def brute_labels(text, notices):
    """Labels and the best share, by brute force over words, grams, diagonals and subsequences."""
    lower = str.maketrans(licenses.UPPER, licenses.LOWER)
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
    w, found, k = word(text or ""), {}, licenses.K
    for label, notice in notices:
        body, votes = word(notice), {}
        for pos in range(len(w) - k + 1):
            for at in range(len(body) - k + 1):
                if w[pos : pos + k] == body[at : at + k]:
                    votes.setdefault(pos - at, set()).add(pos)
        island, last = [], None
        groups = []
        for d in sorted(votes):
            if last is not None and d - last > licenses.NEAR:
                groups.append(island)
                island = []
            island, last = island + [votes[d]], d
        for g in [*groups, island] if island else groups:
            places = sorted({p + j for p in set().union(*g) for j in range(k)})
            share = lcs([w[p] for p in places], body) / len(body)
            if share >= licenses.MIN_SHARE:
                found[label] = max(found.get(label, 0), share)
    return found


def test_licenses_against_brute_force(spark):
    rng = random.Random(6)
    texts = ["", None, "MIT License " * 300, "Released under the MIT License " * 40, "licensed under the İ MIT License"]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            body = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(body))
                body[at : at + rng.randrange(2)] = rng.choice([[], ["kindly"], ["the", "License"], [body[at]]])
            words += [f"x{rng.randrange(9)}" for _ in range(rng.randrange(4))] + body
        texts.append(" ".join(words))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        want = brute_labels(t, licenses.TEMPLATES)
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == set(want) | base
        assert np.isclose(got[i].score, max([*want.values(), 0.5 if base else 0.0]))
    assert got[2].labels == "" and got[3].labels == "mit"


def test_notices_of_too_many_words_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    with pytest.raises(Exception, match="too many words"):
        licenses.scan(docs, [("x", "word " * 62)]).collect()


def test_secrets_found_and_ordinary_runs_left(spark, sf):
    ratio = secrets.fit(table(spark, sf, "documents"))
    found = lambda t: any(k == 3 for k, *_ in secrets.spans_of(pa.array([t]), ratio)[0])
    rng = random.Random(9)
    keys = ["".join(rng.choice(chars) for _ in range(rng.randrange(20, 41))) for chars in (LETTERS, LETTERS + string.digits, string.ascii_lowercase + string.digits) for _ in range(200)]
    assert np.mean([found(f"see {k} there") for k in keys]) >= 0.9
    assert found("qZxVbNtRkWpLsDfGhJmCyXwT") and found("kq7xz9vbnt2rkw4plsd8fg")
    plain = ["internationalization_of_documents", "getDocumentVersionByIdentifier", "src/main/configuration/values", "some-long-url-path-with-words", "MAXIMUM_PARAMETER_COUNT", "2024-01-01/2025-12-31"] + [c * 40 for c in "=-_+/a0"]
    assert [t for t in plain if found(f"see {t} there")] == []


def test_secrets_take_time_by_length(spark, sf):
    ratio = secrets.fit(table(spark, sf, "documents").limit(50))
    took = []
    for n in (2000, 20000):
        text = " ".join("0123456789abcdef" * 2 for _ in range(n))
        began = time.time()
        spans = secrets.spans_of(pa.array([text]), ratio)[0]
        took.append(time.time() - began)
        assert [s for s in spans if s[0] == 2] == [(2, 33 * i, 33 * i + 32) for i in range(n)]
    assert took[1] < 40 * took[0] + 1


def test_prior_needs_no_negative_labels():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        n = int(2000 * share)
        positive = rng.normal(2, 1, (1500, 3))
        unlabelled = rng.permutation(np.concatenate([rng.normal(2, 1, (n, 3)), rng.normal(-2, 1, (2000 - n, 3))]))
        assert abs(quality.estimated_prior(positive, unlabelled) - share) < 0.1
    assert quality.estimated_prior(positive[:2], unlabelled) == 0.5


def test_samples_are_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(500)], "doc_id bigint, text string")
    some = kit.sample(docs, 100)
    assert some.count() == 100 and {len(r.text) - r.doc_id for r in some.collect()} == {0}
    assert kit.sample(docs, 500).count() == 500 and kit.sample(docs.limit(0), 5).count() == 0


CLASH = "doc_id bigint, text string, _key string, _found string, row0 string, found0 string, h bigint, w string, g string, x string, bucket bigint, sketch string, node bigint, next string, part string, cuts string, spans string, word string"


def test_clashing_columns_everywhere(spark, sf):
    texts = ["w1 w2 w3 " * 20, None, "", "日本 " * 5000, "w1 w2 w3 " * 20]
    docs = spark.createDataFrame([(i, t, *[None if i % 2 else "7"] * 4, i, *["q"] * 3, i, "s", i, *["z"] * 5) for i, t in enumerate(texts)], CLASH)
    bench = spark.createDataFrame([(1, "w2 w3 w1", "a", "b")], "item_id bigint, text string, h string, words string")
    for bound in (decontaminate.BROADCAST_BYTES, 0):
        clean = decontaminate.without_spans(docs, bench, broadcast_bytes=bound)
        assert clean.columns == docs.columns and decontaminate.scan(docs, bench, broadcast_bytes=bound).where("n_hit > 0").count() == 2
        assert {r.doc_id: r.n_hit for r in decontaminate.scan(docs, bench, broadcast_bytes=bound).collect()} == {0: 57, 1: 0, 2: 0, 3: 0, 4: 57}
    assert {r.doc_id: r.component_id for r in jaccard.clustered(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    assert jaccard.first_of_each(docs).columns == docs.columns and jaccard.first_of_each(docs).count() == 4
    for out in (substrings.dedup(docs), bpe.digest(docs, bpe.production_ranks()), winnow.edited(docs), secrets.find(docs), licenses.scan(docs), language.identify(docs, language.learn(docs.withColumnRenamed("w", "lang"))), quality.scored(docs, quality.learn(docs, docs.selectExpr("doc_id", "1 as quality", "text as word")))):
        assert out.count() == 5
    assert secrets.masked(docs).columns == docs.columns


def test_chat_takes_odd_turns(spark):
    kind = "pair_id bigint, turn bigint, role string, text string, i int, part string, piece string, span string, n_prefix int"
    odd = lambda *turns: spark.createDataFrame([(*t, 1, "p", "q", "r", 5) for t in turns], kind)
    long = "w " * 100_000
    chosen = odd((1, 0, "user", long), (1, 1, "assistant", None), (2, None, "user", "a"), (3, 0, None, None))
    rejected = odd((1, 0, "user", long), (1, 1, "assistant", long), (2, None, "user", "a"), (3, 0, None, None))
    got = {r.pair_id: r for r in chat.preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3} and got[1].n_prefix == 1 and len(got[1].prompt) > len(long) and long in got[1].rejected


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLE[name])
    columns = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_stages_take_clashing_columns_and_long_texts(spark, sf):
    rows = [(1, "the thing of that and " * 20_000, "en", "s", 440_000), (2, None, None, None, None), (3, "the cat " + "z" * 100_000, "en", None, 100_008), (4, "der und die das ist " * 30, "de", "s", 600)]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], DOCS + ", spans string, node bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} >= {1, 4}, name


def test_pipeline_drops_near_copies_at_five_words_and_four_fifths(spark, sf):
    rng = random.Random(5)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(200)]
        texts.append(base)
        for size in (5, 20, 45, 80):
            at = rng.randrange(20, 180)
            texts.append(base[:at] + [f"x{g}s{size}n{j}" for j in range(size)] + base[at:])
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, " ".join(texts[t]), "en", "s", 0) for i, t in enumerate(order)]
    sets = {i: {tuple(texts[t][j : j + 5]) for j in range(len(texts[t]) - 4)} for i, t in enumerate(order)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    kept = corpus_pipeline.deduplicated(spark, spark.createDataFrame(rows, DOCS), sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if root[i] == i)


def test_secrets_score_all_runs_and_what_patterns_leave(spark, sf):
    ratio = secrets.fit(table(spark, sf, "documents"))
    score = lambda t: float(ratio[(x := secrets.SYMBOL[np.frombuffer(t.encode(), np.uint8)])[:-2], x[1:-1], x[2:]].mean())
    found = lambda t: secrets.spans_of(pa.array([t]), ratio)[0]
    rng = random.Random(8)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
    hits = 0
    for text in [key(letters, 16 + i) for i in range(30)] + [key(digits, 20 + i % 10) for i in range(30)]:  # no digit, or digits alone
        want = [(3, 4, 4 + len(text))] if score(text) >= secrets.MIN_RATIO else []
        assert found(f"see {text} there") == want
        hits += bool(want)
    assert hits > 20
    access = "AKIA" + key(letters[:26], 16)
    for i in range(20):
        rest = key(letters + digits, 40)
        for text, at, piece in ((f"{access}/{rest} x", len(access), "/" + rest), (f"x {rest}/{access}", 2, rest + "/"), (f"{rest}-{access}-{rest}", 0, rest + "-")):
            spans = found(text)
            assert 1 in [k for k, *_ in spans]
            assert ((3, at, at + len(piece)) in spans) == (score(piece) >= secrets.MIN_RATIO)
    assert (3, len(access), len(access) + len(rest) + 1) in found(f"{access}/{rest}") or score("/" + rest) < secrets.MIN_RATIO


def test_rows_without_id_are_no_hubs(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(None, " ".join(base), "en", "s", 0)]
    for i in range(30):
        rows.append((i, " ".join(base[: 6 * i + 5] + [f"x{i}"] + base[6 * i + 6 :]), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.component_id for r in jaccard.clustered(docs).collect()}
    assert got == {None: None} | {i: 0 for i in range(30)}  # any two share 192 of 204 shingles
    assert {r.doc_id for r in jaccard.first_of_each(docs).collect()} == {None, 0}


#: Two words of one hash under the first seed, built by undoing the first eight bytes with the next.
COLLIDING = ("mntyadvyrvhxpxmy", "nkugutkv?&^0(0je")


def test_constructed_collisions_link_nothing(spark, sf):
    a, b = COLLIDING
    tail = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(0, a), (1, b), (2, f"{a} {tail}"), (3, f"{b} {tail}"), (4, a)], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.clustered(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 0}
    assert {r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, sf).collect()} == {0, 1, 2}
    twice = spark.createDataFrame([(0, " ".join([a] * 13)), (1, " ".join([b] * 13)), (2, " ".join([a] * 13))], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in substrings.dedup(twice).collect()} == {0: 0, 1: 0, 2: 13}


@pytest.mark.parametrize("ids", [[5], [None], [5, None]])
def test_samples_of_repeated_and_null_ids(spark, ids):
    rows = [(ids[i % len(ids)], f"text number {i % 7000}", "en") for i in range(10_000)] + [(100 + i, "un texte en français", "fr") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, place0 string").repartition(5).persist()
    assert kit.sample(docs, 6000).count() == 6000
    assert kit.sample(docs, 10_099).count() == 10_099
    same = spark.createDataFrame([(5, "one text", "en")] * 9000, "doc_id bigint, text string, lang string").persist()
    assert kit.sample(same, 6000).count() == 6000
    docs.unpersist(), same.unpersist()


def test_models_learn_from_repeated_ids(spark):
    rows = [(None if i % 2 else 7, ["the words of the text are and is", "el texto de las palabras es y no"][i % 3 == 0], ["en", "es"][i % 3 == 0], "s", 32) for i in range(14_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").persist()
    model = language.learn(docs)
    assert language.confident(docs, model).count() == len(rows)
    found = secrets.find(docs)
    assert found.count() == len(rows)
    docs.unpersist()
