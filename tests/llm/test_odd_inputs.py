"""Values of any magnitude, repeated ids, shares by occurrences, and menus held against all pages."""

import random
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import ann, html, pii, topk


def words_of(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.mark.parametrize("size", [10**3, 10**6, 3 * 10**6, 10**7, 10**8, 10**12, 10**16])
def test_topk_is_exact_at_every_magnitude(size):
    r = np.random.default_rng(size)
    rows = r.integers(-size, size + 1, (1500, 32))
    rows[-300:] = rows[:300]  # ties
    index = topk.Index(np.arange(1500), rows)
    for own in range(0, 1500, 60):
        ids, scores = index.search(rows[own], 5, own)
        true = sorted(((-sum(int(a) * int(b) for a, b in zip(rows[own], x)), i) for i, x in enumerate(rows) if i != own))[:5]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == true


def test_scores_and_components_beyond_the_long_are_errors(spark):
    huge = spark.createDataFrame([(i, [1e12, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    v = topk.scaled(huge)
    with pytest.raises(Exception, match="(?i)overflow|too large|convert"):
        topk.top_k(v, v.filter("vec_id = 0")).collect()
    with pytest.raises(Exception, match="no long"):
        topk.scaled(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_rows_that_share_an_id(spark):
    """Each row is a candidate and a query of its own; only the query's own row is none of its candidates."""
    r = np.random.default_rng(3)
    rows = [(i // 2 if i < 20 else i, r.normal(size=4).round(2).tolist()) for i in range(150)]
    rows += [(0, rows[0][1])] * 30 + [rows[1]]  # copies of one row, more than are asked for
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = [i for i, (v, _) in enumerate(rows) if v % 50 == 0]
    whole = [np.floor(256 * np.array(x)).astype(int) for _, x in rows]
    want = Counter()
    for q in asks:
        best = sorted((-int(whole[q] @ whole[i]), rows[i][0]) for i in range(len(rows)) if i != q)[:5]
        want.update((rows[q][0], n, i, -s) for n, (s, i) in enumerate(best, 1))
    v = topk.scaled(df)
    assert Counter(map(tuple, topk.top_k(v, v.filter("vec_id % 50 = 0"), 5).collect())) == want
    near = Counter()
    for q in asks:
        best = sorted((float(np.sqrt(((np.array(rows[q][1]) - np.array(rows[i][1])) ** 2).sum())), rows[i][0]) for i in range(len(rows)) if i != q)[:5]
        near.update((rows[q][0], n, i) for n, (_, i) in enumerate(best, 1))
    got = Counter((x["query_id"], x["rank"], x["vec_id"]) for x in ann.search(df, df.filter("vec_id % 50 = 0"), 5, target=1.0).collect())
    assert sum(got.values()) == sum(near.values()) and sum((got & near).values()) >= 0.95 * sum(near.values())


def test_an_occurrence_counts_once_for_an_entity(spark):
    """Between two spans of one entity there is one occurrence of a term, not two."""
    beside = [f"{words_of(12, i)} a@b.example.org sharedterm a@b.example.org {words_of(12, 50 + i)}" for i in range(4)]
    away = [f"{words_of(12, 100 + i)} sharedterm {words_of(12, 150 + i)}" for i in range(4)]
    df = spark.createDataFrame(list(enumerate(beside + away)), "doc_id long, text string")
    counts = pii.gather(df).filter("term = 'sharedterm'").groupBy("entity").sum("n").collect()
    assert {x[0]: x[1] for x in counts} == {None: 8, "email a@b.example.org": 4}


def test_kind_on_a_tie(spark):
    texts = [f"{words_of(9, i)} x@y.example.org tiedterm 10.1.2.3 {words_of(9, 50 + i)}" for i in range(30)] + [words_of(60, 200 + i) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(x) for x in pii.disclosing_terms(df).filter("term = 'tiedterm'").collect()] == [("tiedterm", "email")]


def site(n, linked):
    """A host whose articles end in a list of references; the first pages by hash may all have links in it."""
    rows = []
    for i in range(n):
        refs = "".join(f"<li><a href='/r{j}'>{words_of(6, 9000 + 10 * i + j)}</a></li>" if linked(i) else f"<li>{words_of(6, 9000 + 10 * i + j)}</li>" for j in range(3))
        menu = "".join(f"<li><a href='/{j}'>{words_of(2, 50 * i + j)}</a></li>" for j in range(4))
        rows.append((i, f"http://h.x/{i}", f"<html><body><div class=x1><ul>{menu}</ul></div><article><h1>{words_of(4, 5000 + i)}</h1><p>{words_of(60, i)}</p><p>{words_of(40, 700 + i)}</p><ul>{refs}</ul></article></body></html>"))
    return rows


@pytest.mark.parametrize("share", [1.0, 0.3])
def test_lists_of_links_in_an_article_stay(spark, share):
    rows = site(40, lambda i: i < 40 * share)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html.extract(df).collect()}
    for i, _, _ in rows:
        assert got[i] == "\n\n".join([words_of(4, 5000 + i), words_of(60, i), words_of(40, 700 + i), *(words_of(6, 9000 + 10 * i + j) for j in range(3))])


def test_menus_are_counted_over_all_pages(spark):
    """A slot that is links on the pages drawn, but text on most others, is no menu."""
    def page(i, linked):
        part = f"<a href='/{i}'>{words_of(9, 300 + i)}</a>" if linked else words_of(30, 300 + i)
        return f"<html><body><div class=x2>{part}</div><div class=x3><p>{words_of(60, i)}</p></div></body></html>"

    made = html.wrapper([page(i, True) for i in range(10)])
    assert "/html/body/div.x2" in made[2]
    rows = [(i, f"http://h.x/{i}", page(i, i < 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = html.proposed
    html.proposed = lambda pages: spark.createDataFrame([("h.x", *made)], html.WRAPPER)
    try:
        (one,) = html.wrappers(df).collect()
    finally:
        html.proposed = old
    assert "/html/body/div.x2" not in one["menus"] and one["root"] == made[0]


@pytest.mark.parametrize("n", [3, 4])
def test_least_number_of_pages(n):
    pages = [f"<body><div class=m><a href=/>{words_of(3, 40 + i)}</a></div><div class=t><p>{words_of(50, i)}</p></div></body>" for i in range(n)]
    assert bool(html.wrapper(pages)[0]) == (n >= html.LEAST)
