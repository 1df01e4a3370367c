"""Every operator against brute force on small fixtures, and on nulls, empty texts, repeated rows, clashing columns and
empty tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from levelground.llm import decontaminate as dc  # noqa: E402
from levelground.llm import alignment, exact_dedup, importance, jaccard_join, language, licences, line_dedup, packing, pii, secrets, spans, suffix_dedup, token_counts  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, id string, words string, rid long, n int"
BYTES, WORDS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "\n\n", "é" * 3, "a", "x" * 30_000, "word " * 3_000, "tab\tand\x0bmore\x85 nbsp", "Ελλάς ΣΊΣΥΦΟΣ 中文 ❤️ naïve", "<|endoftext|> and <|startoftext|>", "don't 'tis we're  two   spaces\r\n"]


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", "clash", "clash", 7, 3) for i, t in zip(ids, texts)], DOCS)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def corpus(seed, n=60, vocabulary=300):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(vocabulary)]
    return rng, [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(n)]


SAME = lambda df: exact_dedup.exact_dedup(df)
ALL = {
    "pii": lambda df: pii.private_data(df),
    "jaccard": lambda df: jaccard_join.jaccard_components(df),
    "language": lambda df: language.identify(df, dims=64),
    "secrets": lambda df: secrets.secrets(df),
    "lines": lambda df: line_dedup.line_dedup(df),
    "leaks": lambda df: dc.decontaminate(df, df.sparkSession.createDataFrame([(1, "some item text"), (2, None)], "item_id long, text string")),
    "pack": lambda df: packing.pack(df, WORDS),
    "exact": SAME,
    "licences": lambda df: licences.licence_scan(df, licences.document_path()),
    "tokens": lambda df: token_counts.token_counts(df, BYTES),
    "suffixes": lambda df: suffix_dedup.suffix_dedup(df),
    "alignment": lambda df: alignment.alignment_counts(df, BYTES, PIECES),
    "importance": lambda df: importance.importance_sample(df, df.sparkSession.createDataFrame([("some item text",), (None,)], "text string")),
}


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_and_empty_tables(spark, name):
    texts = [*ODD, *ODD[4:8]]
    ids = [*range(len(ODD)), None, 5, 6, None]
    out = ALL[name](table(spark, texts, ids))
    if name == "pack":
        assert out.where("piece = 0").count() == len(texts)
    else:
        assert Counter(x for (x,) in rows(out, "doc_id")) == Counter(ids)
    assert ALL[name](table(spark, texts[:0])).count() == 0


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, bits):
    rng, texts = corpus(1)
    texts = [*texts, *rng.sample(texts, 20), *rng.sample(texts, 5), "a  b", "a b", "a b ", None, ""]
    out = exact_dedup.exact_dedup(table(spark, texts), every=4, hash_bits=bits)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert set(rows(out, "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == want


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    out = exact_dedup.exact_dedup(table(spark, ["t"] * 4, [1, 2, 2, None]))
    assert sorted(rows(out, "kept", "group_size")) == [(False, 4)] * 3 + [(True, 4)]


def line_chunks(lines, window=3, every=2):
    """Chunks as (first line, number of lines), from the definition alone: XXH64 with seed 42, folded over line hashes."""
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in lines]

    def hit(i):
        if i + 1 < window:
            return False
        roll = 42
        for h in hashes[i + 1 - window : i + 1]:
            roll = xxhash.xxh64(h.to_bytes(8, "little"), seed=roll).intdigest()
        return (roll - (1 << 64) if roll >> 63 else roll) % every == 0

    ends = [i + 1 for i in range(len(lines)) if i + 1 == len(lines) or (hit(i) and not hit(i - 1))]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


def line_removal(texts):
    """What must go, from the contract: each occurrence of a chunk but the first, and the whole equal stretch around both,
    however many chunks it runs over."""
    lines = [(t or "").split("\n") for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, own in enumerate(lines):
        for at, n in line_chunks(own):
            part = tuple(own[at : at + n])
            if n < 2 or not "".join(part):
                continue
            e, start = first.setdefault(part, (d, at))
            if (e, start) == (d, at):
                continue
            i, j = at, start
            while i > 0 and j > 0 and own[i - 1] == lines[e][j - 1]:
                i, j = i - 1, j - 1
            stop, j = at, start
            while stop < len(own) and j < len(lines[e]) and own[stop] == lines[e][j]:
                stop, j = stop + 1, j + 1
            gone[d] |= set(range(i, stop))
    return [(len(x), len(g), None if t is None and not g else "\n".join(y for i, y in enumerate(x) if i not in g)) for t, x, g in zip(texts, lines, gone)]


@pytest.mark.parametrize("bits", [64, 2])
def test_line_dedup(spark, bits):
    rng = random.Random(2)
    passage = [f"shared line {i}" for i in range(14)]
    texts = ["\n".join([f"own {i} {j}" for j in range(rng.randint(0, 5))] + passage * (i % 3 > 0) + [f"end {i} {j}" for j in range(rng.randint(0, 5))]) for i in range(20)]
    texts += [texts[1] + "\n" + texts[1], None, "", "\n\n\n\n\n\n", "\n".join(["same"] * 40), "\n".join(["same"] * 40)]
    got = {d: (n, gone, t) for d, n, gone, t in rows(line_dedup.line_dedup(table(spark, texts), hash_bits=bits), "doc_id", "n_lines", "n_removed", "text")}
    want = line_removal(texts)
    assert [got[i] for i in range(len(texts))] == want
    # every passage but the first goes whole
    assert sum(gone for _, gone, _ in want[:20]) == 14 * 12


def test_line_dedup_takes_passages_whole(spark):
    """Parts of one long text at odd places of others: of each repeated part all lines go, whatever their chunks."""
    rng = random.Random(11)
    source = [f"line {i} {rng.random()}" for i in range(6_000)]
    texts, lost = ["\n".join(source), "\n".join(source)], [0, len(source)]
    for i in range(120):
        at, n = rng.randrange(5_900), rng.randint(30, 90)
        texts.append("\n".join([f"head {i} {j}" for j in range(rng.randint(0, 9))] + source[at : at + n] + [f"tail {i} {j}" for j in range(rng.randint(0, 9))]))
        lost.append(len(source[at : at + n]))
    out = line_dedup.line_dedup(table(spark, texts))
    got = {d: (n, gone, t) for d, n, gone, t in rows(out, "doc_id", "n_lines", "n_removed", "text")}
    assert [got[i][1] for i in range(len(texts))] == lost
    assert [got[i] for i in range(len(texts))] == line_removal(texts)
    assert got[1][2] == ""


@pytest.mark.parametrize("limit", [10_000, 0])
def test_decontaminate(spark, limit):
    rng, texts = corpus(3, vocabulary=60)
    items = [" ".join(rng.choices(" ".join(texts).split(), k=k)) for k in (1, 3, 5, 9, 10, 14, 30)]
    for i in range(0, 40, 3):
        own, part = texts[i].split(), items[4 + i % 3].upper().split()
        at = rng.randrange(len(own) + 1)
        texts[i] = " ".join([*own[:at], *part[: rng.randint(8, len(part))], *own[at:]])
    bench = spark.createDataFrame([*enumerate(items), (3, items[3]), (8, None), (9, "...")], "item_id int, text string")
    docs = table(spark, [*texts, None, "", "!!"])
    got = dc.decontaminate(docs, bench, broadcast_rows=limit)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", bench.toPandas())
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(rows(got, *columns)) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({dc.SQL})").fetchall())
    assert sum(r.contaminated for r in got.collect()) > 5


def components(texts, k=3, percent=90):
    sets = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [(i, len(s), r) for i, (s, r) in enumerate(zip(sets, root))]


@pytest.mark.parametrize(("frequent", "block"), [(10**9, 256), (4, 4), (2, 256)])
def test_jaccard_components(spark, frequent, block):
    rng, texts = corpus(4, n=25)
    for base in [*texts[:3], texts[5] + " " + texts[6] + " " + texts[7]]:
        for _ in range(14):  # near copies of several degrees, so that links make chains
            w = base.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", "third"])
            texts.append(" ".join(w))
    texts += ["one", "one", "two words", "Two  WORDS", None, "", "a b c d e f g h i j k", "a b c d e f g h i j k l"]
    out = jaccard_join.jaccard_components(table(spark, texts), frequent=frequent, block=block)
    want = [(i, n, c if n else i) for i, n, c in components(texts)]
    assert sorted(rows(out, "doc_id", "n_shingles", "component_id")) == want
    assert len({c for _, _, c in want}) < len(texts) - 20


@pytest.mark.parametrize("listed", [1, 6])
@pytest.mark.parametrize("frequent", [4, 10**9])
def test_jaccard_components_of_crowded_keys(spark, monkeypatch, listed, frequent):
    monkeypatch.setattr(jaccard_join, "LISTED", listed)
    test_jaccard_components(spark, frequent, 4)


def test_a_shared_footer_lists_few_pairs(spark, monkeypatch):
    """One document for each partition, so that no task sees the footer twice."""
    rng, texts = corpus(6, n=120, vocabulary=5000)
    footer = " ".join(f"notice{i}" for i in range(12))
    texts = [f"{t} {footer}" for t in texts] + [f"{texts[0]} {footer} more", texts[1]]
    listed, stored = {}, jaccard_join.stored

    def counted(df, name):
        out = stored(df, name)
        listed[name] = listed.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    monkeypatch.setattr(jaccard_join, "LISTED", 8)
    apart = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), len(texts)), "doc_id long, text string")
    out = jaccard_join.jaccard_components(apart)
    assert sorted(rows(out, "doc_id", "n_shingles", "component_id")) == [(i, n, c if n else i) for i, n, c in components(texts)]
    assert listed["crowded"] > 0
    assert listed["pairs"] <= 8 * len(texts), listed  # 120 * 119 / 2 if all of the footer's holders met


def test_near_copies_pair_with_one_of_them(spark, monkeypatch):
    """Forty copies that differ in a word each give pairs in proportion, not in the square; texts that share a run with the
    star's centre and are near only to each other still meet."""
    rng, stored, listed = random.Random(21), jaccard_join.stored, []

    def counted(df, name):
        out = stored(df, name)
        if name == "pairs":
            listed.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(200)]
    texts = [" ".join([*base[: 5 * i], word(), *base[5 * i + 1 :]]) for i in range(40)]
    shared = [word() for _ in range(60)]
    for _ in range(6):  # pairs of near copies; all share a run
        own = [*shared, *(word() for _ in range(30))]
        texts += [" ".join(own), " ".join([*own[:-1], word()])]
    out = jaccard_join.jaccard_components(table(spark, texts), frequent=1_000_000)
    assert sorted((r[0], r[2]) for r in rows(out, "doc_id", "n_shingles", "component_id")) == [(i, c) for i, _, c in components(texts)]
    assert 0 < sum(listed) < 4 * len(texts)


def test_a_long_text_does_not_join_short_ones(spark, monkeypatch):
    """A text of 20,000 words, whose sketch alone admits any short one, shares a run with each of 30 that are near nothing."""
    rng, stored, joined = random.Random(23), jaccard_join.stored, []

    def counted(df, name):
        out = stored(df, name)
        if name == "sized":
            joined.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    long = [word() for _ in range(21_000)]
    texts = [" ".join(long), *(" ".join(long[600 * i : 600 * i + 3] + [word() for _ in range(3)]) for i in range(30))]
    out = jaccard_join.jaccard_components(table(spark, texts), frequent=1_000_000)
    assert sorted((r[0], r[2]) for r in rows(out, "doc_id", "n_shingles", "component_id")) == [(i, i) for i in range(len(texts))]
    assert not sum(joined)


def test_sets_that_share_passages_alone_are_told_apart_by_sketches(spark, monkeypatch):
    """Texts of two passages each, of ten: runs of a passage join all of them, few are near one another, and only these are compared
    by shingles; of two lengths, and one of each of some near copies."""
    rng, stored, compared = random.Random(24), jaccard_join.stored, []

    def counted(df, name):
        out = stored(df, name)
        if name in ("sketches", "sets"):
            compared.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    monkeypatch.setattr(jaccard_join, "LISTED", 4)
    monkeypatch.setattr(jaccard_join, "SKETCHES", 8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passages = [[word() for _ in range(60 + 700 * (i > 6))] for i in range(10)]
    texts = [" ".join(passages[i] + passages[j]) for i in range(10) for j in range(i)]
    texts += [" ".join([*passages[i], *passages[i + 1], word()]) for i in range(9)]
    out = jaccard_join.jaccard_components(table(spark, texts), frequent=2, block=4)
    assert sorted((r[0], r[2]) for r in rows(out, "doc_id", "n_shingles", "component_id")) == [(i, c) for i, _, c in components(texts)]
    assert dict(compared).get("sketches", 0) >= len(texts) / 2
    assert dict(compared).get("sets", 0) < len(texts) / 2, compared


def test_alike_finds_all_that_may_link():
    """Sets of sizes on both sides of a power of two: all that link are joined."""
    rng, sets = random.Random(25), []
    for size in (3, 40, 1020, 1030, 2040, 2050, 4090, 4100):
        base = [rng.getrandbits(64) for _ in range(size)]
        sets += [np.unique(np.array(base[: size - cut] + [rng.getrandbits(64) for _ in range(more)], np.uint64)) for cut, more in ((0, 0), (size // 25, 0), (0, size // 20), (size // 40, size // 40))]
    label = list(range(len(sets)))
    for a, b in jaccard_join.alike(np.array([len(x) for x in sets]), [jaccard_join.sketch(x) for x in sets], 90):
        label = [label[a] if x == label[b] else x for x in label]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - c)]
    assert len(linked) >= 20 and all(label[i] == label[j] for i, j in linked)
    assert len(set(label)) >= 6


def test_a_dense_group_is_compared_with_one_set(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:i % 397] + [f"new{i}"] + words[i % 397 + 1 :]) for i in range(1500)]
    out = jaccard_join.jaccard_components(table(spark, texts))
    assert {(c,) for c in (0,)} == set(rows(out, "component_id"))


def test_prefix_keys_meet(spark):
    """Any two sets that are similar enough share a key, however the shingles are divided into rare and frequent."""
    rng = np.random.default_rng(5)
    for n in (9, 12, 40, 150, 280, 600):
        for _ in range(30):
            universe = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            base = rng.choice(universe, n, replace=False)
            drop = int(rng.integers(0, n // 18 + 1))
            other = np.unique(np.concatenate([base[drop:], rng.choice(universe, drop)]))
            base = np.unique(base)
            both = len(np.intersect1d(base, other))
            if 100 * both < 90 * (len(base) + len(other) - both):
                continue
            often = np.sort(rng.choice(universe, int(rng.integers(0, len(universe))), replace=False))
            counts = rng.integers(1, 50, len(often))
            s1, _, c1 = jaccard_join.keys_of(base, often, counts, 90)
            s2, _, c2 = jaccard_join.keys_of(other, often, counts, 90)
            assert len(np.intersect1d(s1, s2)) or len(np.intersect1d(c1, c2)) or np.array_equal(base, other)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_prefix_keys_of_small_sets_meet(percent):
    """Sets that share few shingles, all of them frequent, share a key too."""
    rng = np.random.default_rng(13)
    for n in range(1, 60):
        for _ in range(20):
            universe = np.unique(rng.integers(0, 1 << 63, 3 * n + 3).astype(np.uint64))
            counts = rng.integers(1, 50, len(universe))
            both = rng.permutation(universe)
            common = -(-percent * n // 100)
            spare = 100 * common // percent - n  # shingles that the other set alone may hold
            a, b = np.sort(both[:n]), np.sort(np.concatenate([both[:common], both[n : n + spare]]))
            assert 100 * common >= percent * (n + spare)
            k1, k2 = (jaccard_join.keys_of(s, universe, counts, percent)[2] for s in (a, b))
            assert np.array_equal(a, b) or len(np.intersect1d(k1, k2)), (n, common)


@pytest.mark.parametrize("frequent", [10**9, 2])
def test_pipeline_near_stage_links_between_the_thresholds(spark, monkeypatch, frequent):
    import corpus_pipeline

    rng, texts = corpus(14, n=20)
    for base in [" ".join(texts[i : i + 3]) for i in range(0, 12, 3)]:
        for edits in (0, 1, 2, 3):
            w = base.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(["new", "other", "third"])
            texts.append(" ".join(w))
    texts += [" ".join("abcdefgh"), " ".join("abcdefghi"), " ".join("bcdefghij")]  # four, five and five shingles
    plain = corpus_pipeline.jaccard_components
    monkeypatch.setattr(corpus_pipeline, "jaccard_components", lambda docs, **more: plain(docs, frequent=frequent, **more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i for i, n, c in components(texts, 5, 80) if c == i or not n}
    assert {i for (i,) in rows(corpus_pipeline.near(spark, docs, ""), "doc_id")} == want
    assert len(want) < sum(c == i for i, _, c in components(texts))


def test_sketches_bound_the_difference_and_fold():
    rng = np.random.default_rng(12)
    for n in (50, 3000, 4200, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 25 :], rng.integers(0, 1 << 63, n // 30).astype(np.uint64)]))
        x, y = (np.unpackbits(jaccard_join.sketch(s).view(np.uint8)) for s in (a, b))
        m = min(len(x), len(y))
        x, y = (v[:m] ^ v[m:] if len(v) > m else v for v in (x, y))
        assert int((x ^ y).sum()) <= len(np.setxor1d(a, b))
    long, halves = jaccard_join.sketch(a), jaccard_join.sketch(a[: len(a) // 2])
    assert len(long) >= 2 * len(halves)


def test_language_accuracy(spark):
    rng = random.Random(6)
    syllables = {"aa": "ka ro mi te su".split(), "bb": "sch ung ein lich zer".split(), "cc": "eau tion que ois ère".split()}
    data = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(4, 30))), lang if i % 5 else None) for i in range(400) for lang in [rng.choice([*syllables])]]
    truth = {i: next(k for k, v in syllables.items() if any(s in t for s in v)) for i, t, _ in data}
    docs = spark.createDataFrame([*data, (1000, None, "aa"), (1001, "123 ...", "aa")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, dims=256).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i, _, _ in data if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    rng, texts = corpus(7, n=120)
    texts = [*texts, "long words here " * 400, *ODD]
    got = packing.pack(table(spark, texts).repartition(5), WORDS, size=64, with_ids=True).collect()
    library = Tokenizer.from_file(WORDS)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    back, sequences = {}, {}
    for r in got:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == 64 * r.piece and np.frombuffer(r.ids, "<u4").tolist() == part and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        back[r.doc_id] = back.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert back == {i: len(w) for i, w in enumerate(want)}
    for placed in sequences.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 64
    assert len(sequences) <= 1.1 * sum(map(len, want)) / 64 + 1


def test_packing_plan_is_best_fit():
    rng = random.Random(8)
    for size in (10, 64):
        items = [rng.randint(1, size) for _ in range(500)]
        runs = packing.plan(Counter(items), size)
        assert Counter({n: sum(r[2] for r in runs if r[0] == n) for n in set(items)}) == Counter(items)
        bins = []  # best fit decreasing, piece by piece
        for n in sorted(items, reverse=True):
            fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(size - n)
            else:
                bins[fit] -= n
        assert len({r[3] + i for r in runs for i in range(r[2])}) <= len(bins)


@pytest.mark.parametrize("head", [1 << 19, 8])
def test_token_counts(spark, head):
    from tokenizers import Tokenizer

    texts = [*corpus(9)[1], *ODD, "a<|endoftext|>b", "   \n x", "tail \n\n"]
    got = {d: (b, n, over) for d, b, n, over in rows(token_counts.token_counts(table(spark, texts), BYTES, head=head), "doc_id", "n_bytes", "n_tokens", "over_limit")}
    library = Tokenizer.from_file(BYTES)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512), repr(t)[:60]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_email_search_is_the_pattern():
    rng = random.Random(10)
    for _ in range(3000):
        text = "".join(rng.choices("ab.@- %é", k=rng.randint(0, 30)))
        assert list(spans.emails(text)) == [m.span() for m in EMAIL.finditer(text)]


def test_private_data(spark):
    card = "4111 1111 1111 1111"
    texts = [f"é mail a.b@c.de, ip 10.0.0.255 and 300.1.1.1, card {card}, call +1 (212) 555-0100 now"]
    texts += [f"the customer number {4000000000000002 + i} is" for i in range(3)]
    seeds = [c for c in range(4 * 10**15, 4 * 10**15 + 400) if spans.luhn(str(c))][:12]
    texts += [f"filler {i} my card number {c} thanks" for i, c in enumerate(seeds)]
    texts += ["filler more my card number 4929-88XX-1234 thanks", "my other 12345 words"]
    got = {r.doc_id: r for r in pii.private_data(table(spark, texts), min_support=5, min_precision=0.8).collect()}
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 1, 1)
    s = texts[0].index(card)
    assert f"card:{s}:{s + len(card)}" in got[0].spans.split(",")
    learned = texts[-2].index("4929")
    assert got[len(texts) - 2].spans == f"card:{learned}:{learned + len('4929-88XX-1234')}" and got[len(texts) - 2].n_card == 0
    assert got[len(texts) - 1].spans == "" and got[len(texts) - 1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[0].base_sha256 == hashlib.sha256(got[0].spans.encode()).hexdigest()


def test_ip_search_is_the_pattern():
    rng = random.Random(17)
    for _ in range(3000):
        text = "".join(rng.choices("1023456..  x", k=rng.randint(0, 40)))
        want = [m.span() for m in spans.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        assert list(spans.ips(text)) == want
    assert not list(spans.ips("7" * 2_000_000))


def test_bootstrapping_finds_unseen_identifiers(spark):
    """Planted: cards that fail Luhn and phones without a +, in contexts of ones that the base patterns know, two links of
    contexts away too; precision and recall of what is learned."""
    rng = random.Random(18)
    good = [str(c) for c in range(4 * 10**15, 4 * 10**15 + 3000) if spans.luhn(str(c))]
    bad = [str(c) for c in range(5 * 10**15, 5 * 10**15 + 500) if not spans.luhn(str(c))]
    texts = [f"note {i} charged card {c} on monday" for i, c in enumerate(good[:30])]
    texts += [f"note {i} ring +1 212 555 {i:04d} before noon" for i in range(30)]
    unseen = {}
    for i in range(20):
        unseen[len(texts)] = ("card", bad[i])
        texts.append(f"entry {i} charged card {bad[i]} on monday")
    for i in range(10):  # a context that only learned cards show
        unseen[len(texts)] = ("card", bad[i])
        texts.append(f"entry {i} wallet token {bad[i]} expired")
    for i in range(20, 24):
        unseen[len(texts)] = ("card", bad[i])
        texts.append(f"entry {i} wallet token {bad[i]} expired")
    clean = len(texts)
    texts += [f"order number {rng.randrange(10**7, 10**8)} was shipped in {rng.randrange(1900, 2030)}" for _ in range(60)]
    got = {r.doc_id: r for r in pii.private_data(table(spark, texts)).collect()}
    right = sum(got[i].spans == f"{k}:{texts[i].index(v)}:{texts[i].index(v) + len(v)}" for i, (k, v) in unseen.items())
    learned = sum(r.n_learned for r in got.values())
    assert right >= 0.9 * len(unseen) and right >= 0.9 * learned
    assert all(got[i].n_learned == 0 for i in range(clean, len(texts)))


def test_live_and_copied_secrets(spark):
    """Planted: examples that five owners hold, and credentials of one owner each, copied often by that owner."""
    rng = random.Random(19)
    value = lambda: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=32))
    copied, live = [value() for _ in range(10)], [value() for _ in range(10)]
    data = [(f"uses {v} here", f"owner{o}") for v in copied for o in range(5)] + [(f"uses {v} here", f"owner{i}") for i, v in enumerate(live) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(data)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    assert all((r.n_live, r.spans) == ((0, "") if i < 50 else (1, "token:5:37")) for i, r in got.items())


def test_secrets(spark):
    texts = ["Password = 'abcdef12' and AKIA" + "A1" * 8, "token: short", "deadbeef" * 3 + " api_key=x9x9x9x9", "zq 8Xw3kP0vT7yLm2Qa9Rb5Zc1 end"]
    docs = spark.createDataFrame([(i, t, f"owner{i}") for i, t in enumerate(texts)] + [(10 + i, 'secret="EXAMPLE1234567"', f"owner{i}") for i in range(5)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(4)] == [(1, 1, 0), (0, 0, 0), (1, 0, 1), (0, 0, 0)]
    assert got[0].spans == "assign:0:20,access:26:46"
    assert got[3].spans == "token:3:26" and got[3].n_live == 1
    assert all(got[10 + i].n_copied == 1 and got[10 + i].n_live == 0 for i in range(5))


COMMON = "/usr/share/common-licenses"
REAL = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause"}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files")
def test_whole_licence_files(spark):
    """Real files, whole, without their first ten lines of titles too: then a licence that is right, or none."""
    there = {name: open(f"{COMMON}/{name}", errors="replace").read() for name in REAL if os.path.exists(f"{COMMON}/{name}")}
    docs = [(i, f"{i}/LICENSE", text) for i, text in enumerate(there.values())]
    docs += [(100 + i, f"{i}/notes.txt", "\n".join(text.split("\n")[10:])) for i, text in enumerate(there.values())]
    got = dict(rows(licences.licence_scan(spark.createDataFrame(docs, "doc_id long, path string, text string"), F.col("path")), "doc_id", "own_licence"))
    assert {name: got[i] for i, name in enumerate(there)} == {name: REAL[name] for name in there}
    versions = {name: got[100 + i] for i, name in enumerate(there)}
    for name in ("GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0"):
        assert name not in versions or versions[name] in (None, REAL[name])


def test_a_piece_as_near_to_two_licences_tells_nothing(spark):
    texts = ["it under the terms of the GNU General Public License as published by", "Released under the MIT License.", "   GNU GENERAL PUBLIC LICENSE\n\n   Version 2, June 1991\n", "Creative Commons"]
    got = dict(rows(licences.licence_scan(table(spark, texts), F.lit(None).cast("string")), "doc_id", "own_licence"))
    assert got == {0: None, 1: "MIT", 2: "GPL-2.0", 3: None}


def test_near_relatives_among_licences(spark):
    """Whole files and notices of licences that share most of their words; wrapped lines, and a holder in front."""
    import textwrap

    texts = {f"{name}/{i}/LICENSE": (name, "Copyright (c) 2020 Some Holder\n\n" + "\n".join(textwrap.wrap(t, 76))) for i, (name, t) in enumerate(licences.TEMPLATES) if len(t) > 400}
    notices = {f"{name}/{i}.py": (name, f"# {t}\nx = 1") for i, (name, t) in enumerate(licences.TEMPLATES) if len(t) <= 400}
    cases = texts | notices
    docs = spark.createDataFrame([(p, t, p) for p, (_, t) in cases.items()], "doc_id string, text string, path string")
    got = {r.doc_id: r.own_licence for r in licences.licence_scan(docs, F.col("path")).collect()}
    assert got == {p: name for p, (name, _) in cases.items()}


def test_licences(spark):
    docs = spark.createDataFrame(
        [
            ("a", "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose.", "p/x/a.txt"),
            ("b", "Nothing here", "p/x/b.txt"),
            ("c", "Released under the MIT License.", "p/LICENSE"),
            ("d", "This work is licensed under the GNU General Public License, version 3.", "p/x/LICENSE.txt"),
            ("e", "plain", "p/y/z/e.txt"),
            ("f", "plain", "q/f.txt"),
            ("g", "plain", None),
            ("h", "A licence to sing is what the old song says we need to have at night", "q/h.txt"),
        ],
        "doc_id string, text string, path string",
    )
    got = {r.doc_id: (r.own_licence, r.licence, r.inherited_from) for r in licences.licence_scan(docs, F.col("path")).collect()}
    assert got == {"a": ("Apache-2.0", "Apache-2.0", None), "b": (None, "GPL-3.0", "p/x"), "c": ("MIT", "MIT", None), "d": ("GPL-3.0", "GPL-3.0", None), "e": (None, "MIT", "p"), "f": (None, None, None), "g": (None, None, None), "h": (None, None, None)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng, texts = corpus(11, n=40)
    item = " ".join(rng.choices(" ".join(texts).split(), k=20))
    long = " ".join(rng.choices(" ".join(texts).split(), k=60))
    texts += [texts[0], "12345", long, long + " more", texts[3] + " " + item]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    near = {i for i, _, c in components(texts) if c != i}
    want = set(range(len(texts))) - {0, 41, 44} - {i for i in near if texts.count(texts[i]) == 1}
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == want
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns


def test_pipeline_decides_by_row(spark, tmp_path):
    """Repeated and null ids through all stages, each row told apart by its source."""
    import corpus_pipeline

    rng, texts = corpus(15, n=6)
    words = " ".join(texts).split()
    item = " ".join(rng.choices(words, k=20))
    a, b, c, d, e, f, g = (" ".join(rng.choices(words, k=40)) for _ in range(7))
    data = [
        (1, a), (1, a), (1, a),  # one row thrice: one stays
        (2, b), (2, "123 ..."),  # wordless row of an id that keeps another
        (3, c), (4, c), (3, d),  # the copy with the larger id stays, and so does the other text of 3
        (5, e), (5, e + " more"),  # near copies of one id: one stays
        (6, f), (6, "so " + item), (None, "and " + item),  # leaks, of a repeated and of no id
        (None, g), (None, g), (7, g + " more"),  # near copy 7 stays, its id is known
        (None, "one text only without a number"), (None, "456"), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", str(at)) for at, (i, t) in enumerate(data)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step, left = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        left.append(Counter(rows(step, "doc_id", "text")))
    gone = lambda of, *pairs: of - Counter(pairs)
    want = [gone(Counter(data), (2, "123 ..."), (None, "456"), (None, None))]
    want.append(gone(want[0], (1, a), (1, a), (3, c), (None, g)))
    stays = left[2] & Counter([(5, e), (5, e + " more")])
    leaks = left[2] & Counter([(6, "so " + item), (None, "and " + item)])
    assert left[:2] == want and stays.total() == leaks.total() == 1 and (6, "so " + item) in leaks
    want.append(gone(want[1], (5, e), (5, e + " more"), (None, g), (None, "and " + item)) + stays)
    assert left[2:] == [want[2], want[2] - leaks]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(x for (x,) in rows(out.where("piece = 0"), "doc_id")) == Counter(i for i, _ in left[3].elements())
    assert sorted(filter(None, (i for i, _ in left[3].elements()))) == [1, 2, 3, 4, 5, 6, 7]
