"""Source divergence, token counts and fill-in-middle against brute force, on small inputs with nulls, empty and long texts, ties, repeats, clashes."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import divergence, fim, queries, tokencount

SF = "/root/testdata/sf0.001"
ODD = ["a", "B", "é", "É", " ", "1", "\x00", "\xa0", "\u0085", "bc", "-", "😀", "[", "`", "{", "\x7f", "\n", "<P>", "▁", "  ", "ﬁ", "漢", "\r\n", "the ", "ing", "<0x0A>", "</s>"]


def odd_text(r, n):
    return "".join(r.choice(ODD) for _ in range(r.randint(0, n)))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    texts = [None, "", " ", "\n", "one line", "a\nb\nc", "a\nb\nc\n", "\n\n\n", "x<P>y\nz", "no <S\n> mark <\n", "tail <", "w" * 5000 + "\n" + "z " * 3000, "漢" * 3000]
    texts += [odd_text(r, 60) for _ in range(60)] + ["\n".join(odd_text(r, 6) for _ in range(400))] * 2
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["s0", "s1", "é", None]), 1, "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(3, "a\nb", "en", "s0", 1, "x", "y", "z"), (None, "p\nq\nr", "en", "s0", 1, "x", "y", "z"), rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, form string, id string, row string")


def same(got, want):
    key = lambda row: tuple((x is None, str(x)) for x in row)
    return sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def twin(sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    return con.sql(sql).fetchall()


# source divergence


def plain_audit(rows, least, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for text, lang, source in rows]
    fold = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    rows = [(lang, source, [fold(w) for w in words]) for lang, source, words in rows]
    out, places = [], sorted({(lang, source) for lang, source, _ in rows})
    for lang in {x for x, _ in places}:
        own = [(s, w) for x, s, w in rows if x == lang]
        docs = Counter(t for _, w in own for t in set(w))
        kept = [t for t in docs if docs[t] >= least]
        count = {s: Counter(t for a, w in own if a == s for t in w if docs[t] >= least) for _, s in {(x, s) for x, s in places if x == lang}}
        total = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s in count:
            pairs = [(-sum(f(share(count[s], t), share(count[o], t)) for t in kept), o) for o in count if o != s]
            terms = [(-f(share(count[s], t), share(total, t)), t) for t in kept if count[s][t] and share(count[s], t) > share(total, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return out


def test_counted_terms_against_plain_counts():
    r = random.Random(1)
    for _ in range(300):
        groups = [(r.choice(["", "en"]), r.choice(["", "a"])) for _ in range(r.randint(1, 6))]
        texts = [odd_text(r, 14) for _ in groups]
        n, docs = Counter(dict.fromkeys([(*g, "") for g in groups], 0)), Counter()
        for g, t in zip(groups, texts, strict=True):
            words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
            n.update((*g, w) for w in words)
            docs.update((*g, w) for w in set(words))
        made = divergence.counted_terms(groups, [t.encode() for t in texts]).to_pylist()
        assert sorted(tuple(x.values()) for x in made) == sorted((*k, v, docs[k]) for k, v in n.items())


def test_audit_against_plain_python(spark, docs, monkeypatch):
    rows = [(x["text"], x["lang"], x["source"]) for x in docs.collect()]
    assert same(divergence.audit(docs).collect(), plain_audit(rows, 10, 10))
    monkeypatch.setattr(divergence, "SOURCES", 1)  # every source a tile of its own
    monkeypatch.setattr(divergence, "TERMS", 20)
    assert same(divergence.audit(docs, least=2).collect(), plain_audit(rows, 2, 10))


def test_audit_ties_empty_and_large_counts(spark):
    rows = [(f"tie{i:02d} tie{i:02d} hot", "en", s) for i in range(40) for s in ("a", "b")] + [("123", "xx", "c"), (None, "xx", "d"), ("only", "yy", "e")]
    df = spark.createDataFrame([(t, x, s, 1) for t, x, s in rows], "text string, lang string, source string, value long")
    got = divergence.audit(df, least=1, top=5).collect()
    assert same(got, plain_audit(rows, 1, 5))
    assert {(x["source"], x["item"], x["value"]) for x in got if x["lang"] == "xx"} == {("c", "d", 0), ("d", "c", 0)}  # a lang without kept terms
    assert divergence.audit(df.limit(0)).count() == 0
    big = spark.createDataFrame([(30_000_000_000, 70_000_000_000, 7)], "n long, of long, kept long").select(divergence.share("n", "of", "kept", 10**9))
    assert big.head()[0] == 1 + Fraction(10**9 * 30_000_000_002, 70_000_000_014).__floor__()


def test_divergence_twin(spark):
    df = queries.op11_divergence(spark, SF)
    assert same(df.collect(), twin(queries.DIVERGENCE_SQL))


# token counts


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def test_pre_tokens_are_independent(model):
    pieces, r = tokencount.Pieces(queries.PIECES), random.Random(5)
    for text in ["", " ", "   ", "\n", "▁", *(odd_text(r, 14) for _ in range(5000))]:
        found = pieces.pre_tokens(text)
        assert sum(n * k for n, k in zip(pieces.counts(list(found)), found.values(), strict=True)) == len(model.encode(text)), text


@pytest.mark.parametrize("frequent", [20, tokencount.FREQUENT])
def test_token_counts_against_the_library(spark, docs, model, frequent):
    got = tokencount.token_counts(docs, queries.PIECES, frequent)
    assert got.columns == [*(c for c in docs.columns if c not in ("text", "n_tokens")), "n_bytes", "n_tokens"]
    want = [(x["doc_id"], len((x["text"] or "").encode()), len(model.encode(x["text"] or ""))) for x in docs.collect()]
    assert same(got.select("doc_id", "n_bytes", "n_tokens").collect(), want)  # row by row, repeated and null ids too
    assert tokencount.token_counts(docs.limit(0), queries.PIECES).count() == 0


def test_words_of_one_key_are_told_apart(spark, docs, model, monkeypatch):
    monkeypatch.setattr(tokencount, "key", lambda: (F.xxhash64("word") % 7).alias("key"))  # nearly all words clash
    got = tokencount.token_counts(docs, queries.PIECES, 1)
    assert same(got.select("doc_id", "n_tokens").collect(), [(x["doc_id"], len(model.encode(x["text"] or ""))) for x in docs.collect()])


def test_token_count_query(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [(x["doc_id"], len((x["text"] or "").encode()), n := len(model.encode(x["text"] or "")), n > 4096) for x in rows]
    assert same(queries.op12_tokencount(spark, SF).collect(), want) and any(w[3] for w in want)


# fill-in-middle


def test_rank_index_is_exact_within_its_error():
    r, bits = np.random.default_rng(0), random.Random(2)
    for size in (1, 2, 3, 70, 5000):
        for step in (1, 3, 150, 10**6):
            offsets = np.concatenate(([0], np.cumsum(r.integers(1, step + 1, size - 1))))
            for error in (0, 1, 120):
                index = fim.RankIndex.fit(offsets, error)
                assert index.offset(np.arange(size)).tolist() == offsets.tolist()
                assert np.abs(index.residuals.astype(int)).max() <= error + 1
    assert len(fim.RankIndex.fit(np.arange(0, 10**6, 17)).first) == 1  # equal lines: one segment
    for _ in range(500):
        text = "".join(bits.choice(["a" * bits.randint(0, 300), "\n", "\n\n", "😀\r"]) for _ in range(bits.randint(0, 30)))
        ends = np.cumsum([0, *(len(u) for u in re.findall(r"[^\n]*\n|[^\n]+", text))])
        assert fim.boundaries(text).tolist() == ends.tolist()


def plain_fim(doc_id, text, rate=100, spm=50):
    text, units = text or "", re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 10)])
def test_transform_and_its_inverse(spark, docs, rate, spm):
    made = fim.transform(docs, rate=rate, spm=spm)
    assert made.columns == [*(c for c in docs.columns if c != "form"), "n_lines", "form", "prefix_chars", "middle_chars", "output"]
    got = made.select("doc_id", "text", "id", "n_lines", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert {x["form"] for x in got} == {"plain", "psm", "spm"} and {x["id"] for x in got} == {"y"}
    assert all(tuple(x)[3:8] == plain_fim(x["doc_id"], x["text"], rate, spm) and x["back"] == (x["text"] or "") for x in got)
    assert len(got) == docs.count() and fim.transform(docs.limit(0)).count() == 0


def test_line_index_finds_cuts_without_the_text(spark, docs):
    for x in fim.line_index(docs, error=2).collect():
        index = fim.RankIndex(*(np.array(x[c]) for c in ("first", "base", "slope", "residuals")))
        assert index.offset(np.arange(x["n_lines"] + 1)).tolist() == fim.boundaries(x["text"] or "").tolist()


def test_fim_twin(spark, docs):
    assert same(queries.op13_fim(spark, SF).collect(), twin(queries.FIM_SQL))
