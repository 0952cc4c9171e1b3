"""Label model, quality, toxicity, language fusion and page extraction against plain Python over whole tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeloom.llm import html, labelmodel, langid, mixing, quality, toxicity

SF = "/root/testdata/sf0.001"


def plain_posteriors(rows, prior, rounds=40, clamp=0.02):
    """Expectation-maximisation row by row; in the second half of the rounds voters weigh by how far others repeat them."""
    j = len(rows[0])
    p = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else prior for v in rows]
    weight = [1.0] * j
    for step in range(rounds):
        mass = [[1 - q for q in p], p]
        share = min(1 - 1e-4, max(1e-4, sum(p) / len(rows)))
        table = [[[(sum(q for q, v in zip(of, rows) if v[i] == x) + clamp) / (sum(of) + 3 * clamp) for i in range(j)] for x in (-1, 0, 1)] for of in mass]
        if step >= rounds // 2:
            corr = [[0.0] * j for _ in range(j)]
            for of, s in zip(mass, (1 - share, share)):
                n = sum(of)
                if n < 2:
                    continue
                mean = [sum(q * v[i] for q, v in zip(of, rows)) / n for i in range(j)]
                cov = [[sum(q * (v[a] - mean[a]) * (v[b] - mean[b]) for q, v in zip(of, rows)) / n for b in range(j)] for a in range(j)]
                for a in range(j):
                    for b in range(j):
                        corr[a][b] += s * cov[a][b] / math.sqrt(max(cov[a][a], 1e-9) * max(cov[b][b], 1e-9))
            weight = [1 / (1 + sum(max(0.0, min(1.0, corr[a][b]) - 0.1) for b in range(j) if b != a)) for a in range(j)]
        p = []
        for v in rows:
            z = math.log(share / (1 - share)) + sum(weight[i] * math.log(table[1][x + 1][i] / table[0][x + 1][i]) for i, x in enumerate(v))
            p.append(1 / (1 + math.exp(-min(30, max(-30, z)))))
    return p


def plain_features(text):
    """Words and their beginnings of four and five bytes, hashed."""
    data = re.sub(rb"[^A-Za-z0-9\x80-\xff]", b" ", (text or "").encode("utf-8", "replace"))
    found = set()
    for w in bytes(c + 32 if 65 <= c <= 90 else c for c in data).split():
        found |= {zlib.crc32(x) % 2**24 for x in [w] + [b"^" + w[:4]] * (len(w) >= 4) + [b"~" + w[:5]] * (len(w) >= 5)}
    return found


def plain_score(model, found):
    z = [model["bias"][y] + sum(w[y] for x, w in model["weights"].items() if x in found) for y in (0, 1)]
    return 1 / (1 + math.exp(z[0] - z[1]))


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_posteriors_of_patterns_are_those_of_rows(texts):
    for vote, prior in ((quality.votes, 0.8), (toxicity.Voters({x: x % 6 for w in (b"the", b"and") for x in [zlib.crc32(w) % 2**24]}), 0.1)):
        rows = [tuple(vote(t)) for _, t in texts]
        counts = Counter(rows)
        of, _ = labelmodel.of_patterns([list(v) for v in counts], list(counts.values()), prior)
        assert [of[v] for v in rows] == pytest.approx(plain_posteriors(rows, prior), abs=1e-9)


def test_quality_query_against_plain_scores(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs.select("doc_id", "text"))
    rows = [tuple(quality.votes(t)) for _, t in texts]
    good = [p >= 0.5 for p in plain_posteriors(rows, 0.8)]
    found = [plain_features(t) | set(mixing.shape(t, re.findall(rb"\S+", re.sub(rb"[^A-Za-z0-9\x80-\xff]", b" ", (t or "").encode("utf-8", "replace")).lower()))) for _, t in texts]
    whole, with_it, among = [good.count(False), good.count(True)], Counter(x for f in found for x in f), Counter(x for f, g in zip(found, good) if g for x in f)

    def z(x):
        n, p = with_it[x], with_it[x] / len(texts)
        return abs(among[x] / max(1, whole[1]) - (n - among[x]) / max(1, whole[0])) / math.sqrt(p * (1 - p) * (1 / max(1, whole[0]) + 1 / max(1, whole[1])) + 1e-12)

    rated = {x: z(x) for x, n in with_it.items() if n >= 3}
    bound = sorted(rated.values(), reverse=True)[: quality.FEATURES][-1]
    assert {x for x, v in rated.items() if v > bound + 1e-9} <= set(model["weights"]) <= {x for x, v in rated.items() if v >= bound - 1e-9}
    want = {i: plain_score(model, f) for (i, _), f in zip(texts, found)}
    for r in quality.quality(docs).collect():  # fitted in another order of rows
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=2e-3) and (r["predicted"] == (r["score"] >= 0.5))


def test_toxicity_query_against_plain_scores(spark, texts):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    want = {i: plain_score(model, plain_features(t)) for i, t in texts}
    for r in toxicity.toxicity(docs, labels).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=2e-3) and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def plain_fusion(rows, k, weight=8.0):
    """Posterior of each row: evidence x how its codes go with languages x prior of its host, the row's own share left out."""
    soft = lambda z: [math.exp(x - max(z)) / sum(math.exp(y - max(z)) for y in z) for x in z]
    own = [soft(r["evidence"]) for r in rows]
    add = lambda sums: [sum(x) for x in zip(*sums)] or [0.0] * k
    world = [(x + 1) / (len(rows) + k) for x in add(own)]
    domain = lambda h: (re.search(r"([^.]+\.[^.]+)$", h or "") or [""])[0]
    at_code = {c: defaultdict(lambda: [0.0] * k) for c in ("declared", "suffix")}
    at_host, at_domain = defaultdict(lambda: [0.0] * k), defaultdict(lambda: [0.0] * k)
    for r, o in zip(rows, own):
        for c, table in at_code.items():
            if re.fullmatch("[a-z]{2,3}", r[c] or ""):
                table[r[c]] = add([table[r[c]], o])
        at_host[r["host"]] = add([at_host[r["host"]], o])
        at_domain[domain(r["host"])] = add([at_domain[domain(r["host"])], o])
    out = []
    for r, o in zip(rows, own):
        z = list(r["evidence"])
        for c, table in at_code.items():
            if r[c] in table:
                whole = [x + 1 for x in add(table.values())]
                z = [a + math.log((n + 0.5) / w) for a, n, w in zip(z, table[r[c]], whole)]
        known = r["host"] is not None
        other = [max(0.0, a - b) for a, b in zip(at_domain[domain(r["host"])], o)] if known else [0.0] * k
        same = [max(0.0, a - b) for a, b in zip(at_host[r["host"]], o)] if known else [0.0] * k
        by_domain = [(a + weight * w) / (sum(other) + weight) for a, w in zip(other, world)]
        prior = [(a + weight * p) / (sum(same) + weight) for a, p in zip(same, by_domain)]
        out.append(soft([a + math.log(p + 1e-9) for a, p in zip(z, prior)]))
    return out


@pytest.mark.parametrize("codes", [True, False])
def test_fusion_against_plain_sums(spark, codes):
    r, k = random.Random(5), 3
    rows = []
    for i in range(400):
        at = i % k
        code = r.choice(["en", "de", "fil", None, "english", ""]) if codes else None
        rows.append({"i": i, "evidence": [r.uniform(-4, 0) + (x == at) for x in range(k)], "declared": code, "suffix": r.choice(["de", "fr", None]) if codes else "",
                     "host": r.choice(["a.x.de", "b.x.de", "hot.org", "hot.org", "hot.org", "one", None])})
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "i int, evidence array<double>, declared string, suffix string, host string")
    got = {x["i"]: x for x in langid.fuse(df, ["l0", "l1", "l2"]).collect()}
    assert len(got) == len(rows)
    for x, want in zip(rows, plain_fusion(rows, k)):
        assert list(got[x["i"]]["posterior"]) == pytest.approx(want, abs=1e-9)
        assert got[x["i"]]["lang"] == f"l{want.index(max(want))}" and got[x["i"]]["probability"] == pytest.approx(max(want))


def test_pages_query_against_plain_counts(spark):
    """Wrappers of all hosts in plain loops: induced from a host's distinct pages, then held against all of them."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    hosts = defaultdict(list)
    for p in pages:
        name = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", p["url"] or "")
        hosts[name[1].lower() if name else ""].append(p)
    want = {}
    for name, own in hosts.items():
        read = {x["html"] for x in own if x["html"] is not None}
        assert len(read) <= html.PAGES or not name  # so all of them are drawn
        made = None
        if name:
            root, template, menus = html.wrapper(sorted(read))
            seen = [html.blocks(x["html"]) for x in own]
            stay = {t for t in template if sum(any(f"{b[0]}\n{b[3]}" == t for b in page) for page in seen) >= html.STAYS * len(own)}
            inside = lambda b: b[0] == root or b[0].startswith(root + "/")  # noqa: B023, E731
            most = sum(2 * sum(len(b[3]) for b in page if not b[2] and inside(b)) > sum(len(b[3]) for b in page if not b[2]) for page in seen)
            kept = {m for m in menus if sum(b[4] for page in seen for b in page if b[0] == m) >= html.LINKED * sum(len(b[3]) for page in seen for b in page if b[0] == m)}
            if root or template or menus:
                made = (root if root and most >= html.MOST * len(own) else "", frozenset(stay), frozenset(kept))
        for x in own:
            want[x["page_id"]] = html.main_text(x["html"], made)
    got = html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == len(pages)
    assert all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("size", [0.5, 3.0, 40.0, 300.0])
def test_calibration_settles_at_the_least_loss(size):
    """At the slope and shift found the slopes of the penalised loss are zero, however far from the boundary the rows are."""
    r = random.Random(int(size))
    model = {"bias": np.array([size / 2, -size / 2]), "weights": {1: np.array([-size, size]), 2: np.array([size / 9, -size / 9])}}
    hits = [r.sample([1, 2], r.randint(0, 2)) for _ in range(60)]
    for marks in ([int(1 in h) for h in hits], [int((1 in h) != (r.random() < 0.2)) for h in hits]):
        made = toxicity.calibrated(model, hits, np.array(marks))
        a = made["weights"][1][1] / size
        b = made["bias"][1] - a * model["bias"][1]
        z = [max(-28 * math.log(10), min(28 * math.log(10), model["bias"][1] - model["bias"][0] + sum(model["weights"][x][1] - model["weights"][x][0] for x in h))) for h in hits]
        z = [math.log(1 / (1 + math.exp(-x)) + 1e-12) - math.log(1 / (1 + math.exp(x)) + 1e-12) for x in z]  # no difference from one: it cancels
        left = [1 / (1 + math.exp(-max(-500, min(500, a * x + b)))) - y for x, y in zip(z, marks)]
        assert a > 0 and abs(sum(q * x for q, x in zip(left, z)) + a - 1) < 1e-4 and abs(sum(left) + b) < 1e-4
