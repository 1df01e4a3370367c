"""Suffix-array dedup, cross-tokenizer alignment and importance resampling against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from levelground.llm import alignment, importance, suffix_dedup  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, rid long, id string, key int, ctx binary, bucket int, n_words int, weight long, rank int, pairs string"


def table(spark, docs):
    return spark.createDataFrame([(i, t, 7, "clash", 1, b"c", 2, 3, 4, 5, "p") for i, t in docs], SCHEMA)


def listed(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


# Suffix-array dedup


def removed(docs, length=50):
    """From the contract: every string of every text, with the smallest id that has it."""
    key = lambda i: math.inf if i is None else i
    least = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            least[b[p : p + length]] = min(key(i), least.get(b[p : p + length], math.inf))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), runs, kept))
    return sorted(out)


def passages(seed):
    rng = random.Random(seed)
    word = lambda a, n: "".join(rng.choices(a, k=n))
    shared = [word("abcdefgh ", rng.randint(30, 140)) for _ in range(8)]
    docs = [(i, "".join(rng.choice([rng.choice(shared), word("abcdefgh ", rng.randint(0, 40)), rng.choice(shared)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    base = word("ab é\0", 400)
    docs += [(200, None), (201, ""), (202, "a" * 500), (203, "a" * 49), (204, "a" * 50), (205, "b" + "a" * 120), (206, base), (207, base[:200] + "x" + base[200:]), (207, base), (208, base)]
    docs += [(None, base), (None, "q" * 60), (3, "q" * 60), (209, "é" * 30), (210, "xé" * 30), (211, "0" * 49 + "1" + "0" * 49), (205, docs[4][1]), (4, docs[4][1])]
    # a passage that very many texts have between words of their own
    return docs + [(300 + i, word("xyz", rng.randint(0, 30)) + shared[0] * 2 + word("xyz", 30)) for i in range(80)]


@pytest.mark.parametrize(("length", "contexts"), [(50, 200_000), (50, 30), (24, 200_000)])
def test_suffix_dedup(spark, monkeypatch, length, contexts):
    """contexts 30: dozens of buckets, of which the common passage fills many, so most runs are compared across boundaries."""
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    docs = passages(length)
    want = removed(docs, length)
    assert listed(suffix_dedup.suffix_dedup(table(spark, docs), length=length)) == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in want]
    if contexts == 30:
        out = suffix_dedup.repeated_texts(table(spark, docs)).collect()
        assert Counter((str(r.doc_id), bytes(r.kept)) for r in out) == Counter((r[0], r[4]) for r in want if r[2])


def test_suffix_dedup_over_blocks(spark, monkeypatch):
    """Texts longer than a block of the hashing, a shared passage across its edge."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 512)
    rng = random.Random(1)
    shared = "".join(rng.choices("abcd", k=700))
    texts = ["".join(rng.choices("abcd", k=n)) + shared + "".join(rng.choices("abcd", k=300)) for n in (0, 130, 480, 511, 512, 900)]
    found = suffix_dedup.anchors([t.encode() for t in texts], 50)
    for i, t in enumerate(texts):  # every string has one anchor, inside of it, and equal strings the same place
        own = [(f, n, q) for x, f, n, q in zip(*(c.tolist() for c in found[:4])) if x == i]
        assert [p for f, n, _ in own for p in range(f, f + n)] == list(range(len(t) - 49))
        assert all(0 <= q - f - n + 1 and q - f <= 26 for f, n, q in own)
    docs = list(enumerate(texts))
    assert listed(suffix_dedup.suffix_dedup(table(spark, docs))) == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in removed(docs)]


def test_multikey_is_lexicographic():
    rng = random.Random(2)
    strings = [bytes(rng.choices(b"\0ab", k=rng.randint(0, 20))) for _ in range(500)]
    data, size = np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings)))
    begin = np.cumsum(size) - size
    of = suffix_dedup._Bytes(data)
    order, same = np.arange(500), np.append(False, np.ones(499, bool))
    suffix_dedup.multikey(order, same, [lambda i, n=n: of.ahead(begin[i], size[i], n) for n in range(3)] + [lambda i: size[i]])
    assert [strings[i] for i in order] == sorted(strings, key=lambda s: (s.ljust(24, b"\0"), len(s)))
    assert same.tolist() == [False, *[strings[a] == strings[b] for a, b in zip(order, order[1:])]]


# Cross-tokenizer alignment


def byte_level():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def aligned(docs):
    """From the contract, byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level()
    a_side.encode_special_tokens = True
    per, held = [], Counter()
    for i, text in docs:
        a = [(t, bytes(byte[c] for c in a_side.id_to_token(t))) for t in a_side.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(t, bytes([int(b_side.id_to_piece(t)[3:5], 16)]) if b_side.is_byte(t) else b_side.id_to_piece(t).replace("▁", " ").encode()) for t in b_side.encode(text or "")]
        if not text or b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
            a, b = [], []
        owners = [[n for n, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = sorted(set(zip(*owners)))
        held.update({(a[x][0], b[y][0]) for x, y in links})
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (a, b)]
        stops = sorted(ends[0] & ends[1])
        groups = [[[], []] for _ in stops]
        for n, side in enumerate((a, b)):
            at = g = 0
            for t, x in side:
                groups[g][n].append(str(t))
                at += len(x)
                g += at == stops[g]
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        per.append((i, a, b, links, len(stops), hashlib.sha256(text.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    count = lambda a, b, links: [(held[a[x][0], b[y][0]], best[a[x][0]]) for x, y in links]
    return sorted((str(i), len(a), len(b), g, len(ls), sum(n == m for n, m in count(a, b, ls)), sum(n for n, _ in count(a, b, ls)), sha, many) for i, a, b, ls, g, sha, many in per)


ODD = [None, "", " ", "\n\n", "é" * 3, "a", "x" * 3000, "word " * 300, "tab\tand\x0bmore\x85 nbsp", "Ελλάς ΣΊΣΥΦΟΣ 中文 ❤️ naïve", "<|endoftext|> and <s> </s> <0x0A> <unk>", "don't 'tis we're  two   spaces\r\n", "a▁b", "▁", "\x00 a\x00b", "  lead", "trail  ", "\n  x", " \n \t y  \n", "ﬁ ½ Å Å", "🏳️‍🌈 flags", "a b　c"]


@pytest.mark.parametrize("head", [1 << 19, 8])
def test_alignment_counts(spark, monkeypatch, head):
    rng = random.Random(3)
    alphabet = " " * 6 + "\n\t abcdeéñ中▁'s<|>012.,;  "
    docs = [*enumerate([*ODD, *["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)]]), (5, "a"), (5, "b a")]
    assert listed(alignment.alignment_counts(table(spark, docs), A, B, head=head)) == aligned(docs)


def test_remembered_parts_give_way(monkeypatch):
    """Ids stay right while the memory of parts turns over."""
    from levelground.llm import pretokens

    monkeypatch.setattr(pretokens, "REMEMBERED", 20)
    side, fresh = alignment.PieceTokens(B), alignment.PieceTokens(B)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdef", k=4)) for _ in range(60)]
    for _ in range(12):
        texts = [" " + " ".join(rng.choices(words, k=15)) for _ in range(3)]
        assert side.of(texts) == [np.array(fresh.whole(t), "<u4").tobytes() for t in texts]


def test_token_alignment(spark):
    """Group products expand to all pairs of a group's tokens, of which the links are those that overlap."""
    row = alignment.token_alignment(table(spark, [(1, "don't 'tis we're  two   spaces"), (2, None)]), A, B).orderBy("doc_id").collect()
    assert row[1].a == row[1].link_a == []
    a, b = (Counter(x) for x in (row[0].group_a, row[0].group_b))
    assert list(a) == list(b) == list(range(len(a))) and set(zip(row[0].link_a, row[0].link_b)) <= {(i, j) for i, g in enumerate(row[0].group_a) for j, h in enumerate(row[0].group_b) if g == h}
    assert len(set(zip(row[0].link_a, row[0].link_b))) == len(row[0].link_a) <= sum(a[g] * b[g] for g in a)


# Importance resampling


def sampled(docs, target, n, buckets, least, percent):
    """From the contract, runs written out."""
    def words(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) > 127 else " " for c in text).replace("\x85", "").replace("\xa0", "").split(" ")

    def features(text):
        w = [x.replace("", "\x85").replace("", "\xa0") for x in words(text) if x]
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(k for x in texts for k in features(x)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1.0) * (s.total() + buckets) / ((s[k] + 1.0) * (t.total() + buckets))))
    out = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    return out, order[: percent * len(order) // 100]


@pytest.mark.parametrize(("n", "buckets"), [(1, 10_000), (3, 100_000), (2, 7)])
def test_importance_sample(spark, n, buckets):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choices("abcdeXYé9", k=rng.randint(1, 5))) for _ in range(80)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " .,;\x85 \xa0x "), (None, docs[3][1]), (7, docs[7][1]), (600, "word " * 3000)]
    target = [*(" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(10)), None]
    got = importance.importance_sample(table(spark, docs), spark.createDataFrame([(x,) for x in target], "text string"), n=n, buckets=buckets, least_words=5, percent=20).collect()
    out, drawn = sampled(docs, target, n, buckets, 5, 20)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(r[:4] for r in out)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[3]) for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_importance_ring():
    words = [w.encode() for w in "one two three four five".split()]
    want = Counter(zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, 4) for i in range(len(words) - k + 1))
    assert Counter(importance.run_hashes(words, 3)) == want


def test_importance_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    df = importance.op13_importance_resampling(spark, "/root/testdata/sf0.001")
    expected = con.sql(importance.SQL)
    assert sorted(map(str, expected.project(", ".join(df.columns)).fetchall())) == sorted(str(tuple(r)) for r in df.collect())


# Mended this round


def test_patterns_of_a_text_without_white_space():
    """Contexts of megabytes of addresses, e-mails and dotted digits in one word stay in proportion."""
    from levelground.llm import pii

    for piece in ("10.0.0.1,", "ab@cd.ef;", "+49 30 1234567".replace(" ", "-") + ","):
        short, long = piece * 500, piece * 5_000
        size = [sum(len(p) for t in pii.scan(x)[1] for p in t["pattern"]) for x in (short, long)]
        assert 0 < size[1] <= 11 * size[0]
    assert pii.patterns("see my card 1234 now", 12, 16) == ["my card _", "card _ now", "card <9>", "<9> now"]


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    """Extra columns named like what stages find, an empty table and an empty benchmark."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, lang_pred string, id string, rid long, words string, component_id long, kept boolean, contaminated boolean, place string"
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefg", k=4)) for _ in range(60)]
    data = [(i, " ".join(rng.choices(words, k=30)), None if i % 3 else "en", "s", "clash", "x", 1, "w", 2, True, True, "p") for i in range(6)]
    for name, some in (("some", data), ("none", [])):
        folder = tmp_path / name
        docs = spark.createDataFrame(some, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        step = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, str(folder))
            assert step.columns == docs.columns
        assert [(r.doc_id, r.lang_pred, r.place) for r in step.orderBy("doc_id").collect()] == [(r[0], "clash", "p") for r in some]
        assert all(r.lang == "en" for r in step.collect())
        assert corpus_pipeline.run(spark, str(folder)).count() == len(some)
