"""Main text of web pages by wrapper induction.

Of each host, a few distinct pages are drawn by hash. Their block trees are aligned by simple tree matching into one tree of slots. A
text that stays the same in its slot is proposed as template; a slot whose text lies in links is proposed as a menu; and the content is below the
slot into which one comes from the top as long as a single part holds most of the varying text that isn't in links. What was proposed is
then counted over all pages of the host: only a text that stays in most of them is template, only a slot whose text is in links on
all of them together is a menu (within the content, only what repeats a menu around it), and only a content slot that most of them fill is used. Lists of elements and marks decide where alignment can't: about parts within the content that vary like prose
(readers' comments, adverts), and on hosts with too few pages that are unlike each other.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, map_columns, stored

#: Elements without content, with raw text, that end a paragraph, and that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
OUT = frozenset("nav footer aside form button select option menu dialog fieldset head".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent footer menu nav navbar navigation "
    "newsletter notice notices popup promo promoted sidebar sponsor sponsored subscribe toolbar".split()
)
#: Elements and marks that hold no main text outside an article; within one, they may hold its title or a part of it.
OUT_AROUND = frozenset("header".split())
MARKS_AROUND = frozenset("banner disclaimer header related share sharing social widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
#: Elements that a start tag of the same group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|=\s*"[^"]*"|=\s*'[^']*'|["'])*+)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z].*\Z""", re.S)
MARKED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile("[a-z]+")
#: Pages of a host that are aligned; how many must be unlike each other; the share of a host's pages in which a template text stays.
PAGES, LEAST, STAYS, ALIKE = 12, 4, 0.8, 0.5
#: Words of a shingle, and the share of its shingles that a page must have of its own, so that copies with a few changes aren't unlike.
SHINGLE, OWN = 3, 0.1
#: Share of the varying text that the part to go down into must hold; share of a slot's text in links that makes it a menu.
MOST, LINKED = 0.6, 0.7
#: Hosts with a wrapper, and characters of these, up to which each task holds all of them.
HELD, HELD_CHARS = 20_000, 32 << 20
#: Drawn pages (two short fields each) up to which each task holds all of them.
DRAWN = 100_000


def label(tag: str, attributes: str) -> tuple[str, int]:
    """What an element counts as in alignment, and whether it is marked as no main text: 2 anywhere, 1 outside an article, else 0."""
    out, around, mark = tag in OUT, tag in OUT_AROUND, ""
    if attributes and "=" in attributes or "hidden" in attributes.lower():
        for name, *values in MARKED.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "class":
                mark = value.strip()
            if name in ("class", "id"):
                found = WORD.findall(value)
                out |= not MARKS.isdisjoint(found)
                around |= not MARKS_AROUND.isdisjoint(found)
            elif name == "role":
                out |= value in ROLES
            else:
                out |= name == "hidden" or value == "true"
    return f"{tag}.{mark}" if mark else tag, 2 if out else int(around)


def blocks(html: str | None) -> list[tuple[str, int, bool, str, int]]:
    """(path, 2 in an article or 1 in a main element, marked as no main text, text, characters in links) of each block with text, in page order.
    Paths name block elements."""
    found: list[tuple[str, int, bool, str, int]] = []
    linked = 0
    open_: list[tuple[str, str, int, bool]] = []  # tag, path, in an article or main element, out
    parts: list[str] = []

    def close_block():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, path, inside, out = open_[-1] if open_ else ("", "", 0, False)
                found.append((path, inside, out, text, min(linked, len(text))))
            linked = 0

    def pop_to(at: int):
        if any(t[0] in BLOCK for t in open_[at:]):
            close_block()
        del open_[at:]

    html = html or ""
    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None or m.start() > at:
            text = html[at : m.start() if m else end]
            parts.append(unescape(text) if "&" in text else text)
            if any(t[0] == "a" for t in open_):
                linked += len(parts[-1])
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    pop_to(i)
                    break
                if open_[i][0] in ("article", "table", "html") and tag in ("p", "b", "i", "a", "span", "li"):
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                close_block()
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
            at = stop.start() if stop else end
            if stop:
                over = html.find(">", at)
                at = over + 1 if over >= 0 else end
            continue
        if tag in BLOCK:
            close_block()
            for i in range(len(open_) - 1, -1, -1):  # a paragraph ends where another block starts
                if open_[i][0] == "p":
                    pop_to(i)
                    break
                if open_[i][0] in BLOCK:
                    break
        if tag in CLOSES:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in CLOSES[tag]:
                    pop_to(i)
                    if tag != "tr":
                        break
                elif open_[i][0] in SCOPE[tag]:
                    break
        _, path, inside, out = open_[-1] if open_ else ("", "", 0, False)
        name, marked = label(tag, m[3])
        open_.append((tag, f"{path}/{name}" if tag in BLOCK else path, max(inside, 2 * (tag == "article"), tag == "main"), out or marked == 2 or marked == 1 and inside < 2))
    close_block()
    return found


def node(label: str) -> dict:
    return {"label": label, "texts": {}, "children": []}


def tree(found: list[tuple[str, int, bool, str, int]]) -> dict:
    """The block tree of a page: each node's texts with their characters in links. Neighbours that look alike (list items, paragraphs) are one
    repeated node, so trees stay small."""
    root = node("")
    for path, _, _, text, linked in found:
        at = root
        for part in path.split("/")[1:]:
            if not at["children"] or at["children"][-1]["label"] != part:
                at["children"].append(node(part))
            at = at["children"][-1]
        at["texts"][text] = linked
    return root


def matching(a: dict, b: dict, memory: dict) -> tuple[int, list[tuple[dict, dict]]]:
    """Simple tree matching: the size of the largest order-preserving match of two trees of equal label, and its pairs."""
    if a["label"] != b["label"]:
        return 0, []
    key = id(a), id(b)
    if key in memory:
        return memory[key]
    rows, cols = a["children"], b["children"]
    best = [[(0, ())] * (len(cols) + 1) for _ in range(len(rows) + 1)]
    for i, x in enumerate(rows, 1):
        for j, y in enumerate(cols, 1):
            size, _ = matching(x, y, memory)
            options = [best[i - 1][j], best[i][j - 1]]
            if size:
                options.append((best[i - 1][j - 1][0] + size, (best[i - 1][j - 1][1], (x, y))))
            best[i][j] = max(options, key=lambda o: o[0])
    pairs, at = [(a, b)], best[-1][-1][1]
    while at:
        at, (x, y) = at
        pairs += matching(x, y, memory)[1]
    memory[key] = 1 + best[-1][-1][0], pairs
    return memory[key]


def shingles(texts: set[str]) -> set[tuple[str, ...]]:
    """Runs of SHINGLE words of each text; a shorter text is one."""
    split = [t.split() for t in texts]
    return {tuple(w[i : i + SHINGLE]) for w in split for i in range(max(1, len(w) - SHINGLE + 1))}


def aligned(pages: list[dict]) -> dict:
    """The tree of slots of some page trees: each page is matched with what was aligned so far, and what has no partner is put in after the
    partner before it. A slot has, by text, the number of pages and the characters in links."""
    whole = node("")
    for page in pages:
        partner = {id(y): x for x, y in matching(whole, page, {})[1]}

        def add(own: dict, into: dict):
            for text, linked in own["texts"].items():
                n, before = into["texts"].get(text, (0, 0))
                into["texts"][text] = (n + 1, before + linked)
            place = 0
            for child in own["children"]:
                if id(child) in partner:
                    target = partner[id(child)]
                    place = next(i for i, c in enumerate(into["children"]) if c is target) + 1
                else:
                    target = node(child["label"])
                    into["children"].insert(place, target)
                    place += 1
                add(child, target)

        add(page, whole)
    return whole


def wrapper(pages: list[str | None]) -> tuple[str, list[str], list[str]]:
    """Of a host's pages: the path of the content slot (empty, if none stands out), path and text of what stays the same in half of the pages
    that are unlike each other, and paths of menus. All empty with fewer than LEAST such pages. Pages are compared by what most of them don't
    share, so that template texts don't make them alike, however many there are."""
    read = [(found, shingles({t for _, _, out, t, _ in found if not out})) for found in map(blocks, pages) if found]
    common = Counter(x for _, own in read for x in own)
    kept: list[tuple[set[tuple[str, ...]], dict]] = []
    for found, whole in read:
        own = {x for x in whole if common[x] <= ALIKE * len(read)}
        if own and len(own) >= OWN * len(whole) and all(len(own & other) <= ALIKE * min(len(own), len(other)) for other, _ in kept):
            kept.append((own, tree(found)))
    if len(kept) < LEAST:
        return "", [], []
    slots, stays = aligned([page for _, page in kept]), max(2, ALIKE * len(kept))
    template: set[str] = set()
    chars, links, mass = Counter(), Counter(), {}

    def weigh(slot: dict, path: str) -> float:
        """Characters that vary and aren't in links, of a slot and all below it."""
        own = 0
        for text, (n, linked) in slot["texts"].items():
            if n >= stays:
                template.add(f"{path}\n{text}")
            else:
                own += n * len(text) - linked
            chars[path] += n * len(text)
            links[path] += linked
        mass[id(slot)] = own, own + sum(weigh(c, f"{path}/{c['label']}") for c in slot["children"])
        return mass[id(slot)][1]

    weigh(slots, "")
    at, path = slots, ""
    while at["children"]:
        best = max(at["children"], key=lambda c: mass[id(c)][1])
        own, below = mass[id(best)]
        if below < MOST * max(1, mass[id(at)][1]) or own > (1 - MOST) * below:  # no part stands out, or it is a text itself
            break
        at, path = best, f"{path}/{best['label']}"
    return path, sorted(template), sorted(p for p in chars if links[p] >= LINKED * chars[p])


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


#: What a host's pages taught: content slot, template texts, menus.
WRAPPER = "host string, root string, template array<string>, menus array<string>"


def proposed(pages: DataFrame) -> DataFrame:
    """WRAPPER of each host with pages that can be aligned, from those drawn."""
    heads = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("sign"), "page_id", F.col("html").isNotNull().alias("filled")).filter("host <> '' AND page_id IS NOT NULL").filter(F.col("filled"))
    once = heads.groupBy("host", "sign").agg(F.min("page_id").alias("page_id")).withColumn("salt", F.pmod("sign", F.lit(64)))
    for keys in (("host", "salt"), ("host",)):  # a hot host's pages don't meet in one task: at most 64 times PAGES do
        once = once.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("sign"))).filter(F.col("n") <= PAGES)
    drawn = stored(once.select("host", "page_id", "sign"))
    few = drawn.limit(DRAWN + 1).count() <= DRAWN  # else the pages are dealt by id
    rows = pages.select("page_id", "html", F.xxhash64("html").alias("sign"))
    sample = rows.join(F.broadcast(drawn) if few else drawn.hint("shuffle_hash"), ["page_id", "sign"])
    sample = sample.groupBy("host", "sign").agg(F.first("html").alias("html"))  # a page_id may have several rows

    def induce(key, table):
        import pyarrow as pa

        root, template, menus = wrapper(sorted(table.column("html").to_pylist()))
        lists = pa.list_(pa.string())
        return pa.table({"host": pa.array([key[0].as_py()]), "root": pa.array([root]), "template": pa.array([template], lists), "menus": pa.array([menus], lists)})

    return sample.groupBy("host").applyInArrow(induce, WRAPPER).filter((F.size("template") > 0) | (F.col("root") != "") | (F.size("menus") > 0))


def with_wrapper(rows: DataFrame, made: DataFrame) -> tuple[DataFrame, dict | None]:
    """``rows`` (host, ...) with their host's wrapper (null, if it has none); while wrappers are few, these come as a dict instead."""
    chars = F.sum(sum((F.length(F.array_join(c, "")) for c in ("template", "menus")), F.length("root")))
    count, size = made.agg(F.count(F.lit(1)), chars).head()
    if count <= HELD and (size or 0) <= HELD_CHARS:
        return rows, {r["host"]: (r["root"], frozenset(r["template"]), frozenset(r["menus"])) for r in made.collect()}
    return join_hot(rows, made.select("host", F.struct("root", "template", "menus").alias("wrapper")), "host", "left"), None


def of_row(held: dict | None, x):
    if held is not None:
        return held.get(x)
    return x and (x["root"], frozenset(x["template"]), frozenset(x["menus"]))


def below(path: str, root: str) -> bool:
    return path == root or path.startswith(f"{root}/")


def wrappers(pages: DataFrame) -> DataFrame:
    """``proposed`` wrappers (host, root, template, menus), held against all pages of their hosts: template texts that STAYS of them hold, the content slot if it
    holds most text of MOST of them, and menus whose text lies in links over all of them. Pages with a null or empty html or without host, and an
    empty table, teach nothing; repeated rows count again."""
    made = stored(proposed(pages))
    rows, held = with_wrapper(pages.select("html", host(F.col("url")).alias("host")).filter("host <> ''"), made)

    def make():
        def f(htmls, hosts, *known):
            counts: Counter = Counter()
            for html, name, x in zip(htmls, hosts, known[0] if known else hosts, strict=True):
                if (own := of_row(held, x)) is None:
                    continue
                found = blocks(html)
                counts[name, ""] += 1
                for text in {f"{b[0]}\n{b[3]}" for b in found}:
                    if text in own[1]:
                        counts[name, f"t{text}"] += 1
                for path, _, _, text, linked in found:
                    if path in own[2]:
                        counts[name, f"c{path}"] += len(text)
                        counts[name, f"k{path}"] += linked
                whole, within = sum(len(b[3]) for b in found if not b[2]), sum(len(b[3]) for b in found if not b[2] and below(b[0], own[0]))
                counts[name, "root"] += int(bool(own[0]) and 2 * within > whole)
            return {"host": [k[0] for k in counts], "what": [k[1] for k in counts], "n": list(counts.values())}

        return f

    part = map_columns(rows, ["html", "host"] + ["wrapper"] * (held is None), [("host", "string"), ("what", "string"), ("n", "long")], make)
    seen = stored(part.groupBy("host", "what").agg(F.sum("n").alias("n")))
    total = seen.filter("what = ''").select("host", F.col("n").alias("pages"))
    rated = seen.filter("what <> ''").join(total.hint("merge"), "host")
    stay = rated.filter((F.substring("what", 1, 1) == "t") & (F.col("n") >= STAYS * F.col("pages"))).groupBy("host").agg(F.collect_list(F.expr("substring(what, 2)")).alias("t"))
    of_slot = rated.filter(F.substring("what", 1, 1).isin("c", "k")).groupBy("host", F.expr("substring(what, 2)").alias("path"))
    of_slot = of_slot.agg(*(F.sum(F.when(F.substring("what", 1, 1) == c, F.col("n")).otherwise(0)).alias(c) for c in "ck"))
    linked = of_slot.filter(F.col("k") >= LINKED * F.col("c")).groupBy("host").agg(F.collect_list("path").alias("m"))
    rooted = rated.filter((F.col("what") == "root") & (F.col("n") >= MOST * F.col("pages"))).select("host", F.lit(True).alias("r"))
    whole = made.join(stay.hint("merge"), "host", "left").join(rooted.hint("merge"), "host", "left").join(linked.hint("merge"), "host", "left")
    root = F.when(F.col("r"), F.col("root")).otherwise("")
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(n) for c, n in (("t", "template"), ("m", "menus"))]
    return whole.select("host", root.alias("root"), *lists)


def main_text(html: str | None, made: tuple[str, frozenset, frozenset] | None = None) -> str:
    """The main text: blocks in page order, joined by an empty line, without template, menus and marked parts. They are those below the
    wrapper's content slot; without one, or on a page that has nothing there, those of the page's articles, else of its main element,
    else of the whole page."""
    found = blocks(html)
    root, template, menus = made or ("", (), ())
    inner = [b for b in found if root and below(b[0], root)]
    if not inner:
        best = max((b[1] for b in found if not b[2]), default=0)
        inner = [b for b in found if b[1] == best]

    def content(b) -> bool:
        return b[1] > 0 or bool(root) and below(b[0], root)

    # links within the content are part of it, unless they repeat a menu that stands around it
    around = {b[3] for b in found if b[0] in menus and not content(b)} if menus else ()
    menu = lambda b: b[0] in menus and (not content(b) or b[3] in around)
    return "\n\n".join(b[3] for b in inner if not b[2] and not menu(b) and f"{b[0]}\n{b[3]}" not in template)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars of every row of ``pages`` (page_id, url, html). Null and empty html give an empty text; a page
    without host or id takes no part in wrappers (without host it has none), but is extracted; html of any length is read whole; repeated
    rows stay; an empty table gives no rows; other columns are left aside, whatever their names."""
    rows = pages.select("page_id", "url", "html")
    source, held = with_wrapper(rows.withColumn("host", host(F.col("url"))), stored(wrappers(rows)))

    def make():
        def f(ids, urls, htmls, known):
            texts = [main_text(h, of_row(held, x)) for h, x in zip(htmls, known, strict=True)]
            return {"page_id": ids, "url": urls, "text": texts, "n_chars": list(map(len, texts))}

        return f

    inputs = ["page_id", "url", "html", "host" if held is not None else "wrapper"]
    return map_columns(source, inputs, [("page_id", "long"), ("url", "string"), ("text", "string"), ("n_chars", "long")], make)
