"""Main text of web pages: page structure, and a suffix array over the pages of each host.

A page becomes a stream of blocks of words. The streams of a host's pages are
concatenated and their suffixes sorted; runs of words that begin suffixes of
several distinct pages are boilerplate, and blocks outside an article that such
runs cover are removed, on pages with an article too. What is unique stays.
In an article short runs are common prose: there a block goes if it stands whole
in several pages, unless most of the article does (a copied article is no
boilerplate). Structure decides where repetition can't: menus, notices, forms
and the like go even from a host with one page.

Hosts of many pages are taken in groups of bounded size, so that no task holds
a whole host. Runs and article blocks of such a host that stand in pages of
several groups are found by their hashes, and each group is told those it
holds: the text of a page doesn't depend on the size of its host.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, freed, joined, text_slices, windows, written

#: Pages of one host that are sorted together, about.
GROUP = 256
#: Words of a run, and distinct pages that share it, from which on it is boilerplate.
RUN, PAGES = 4, 2

#: Elements whose content is not read at all.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "select", "option", "head"}
#: Elements that are not main text.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
#: Elements that end a block.
BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "tr", "td", "th", "table", "thead", "tbody", "section", "article", "main", "header", "blockquote", "pre", "figure", "figcaption", "hr", "br", "body", "html", "address", "summary", "details", "caption"} | ASIDE
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
#: Words in class, id or role that mark what is not main text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|cookies?|consent|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|social|related|recommended|comments?|replies|reply|disqus|widget|toolbar|search|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Elements whose class or role may mark them inside an article, and words that may go with a mark there.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "header", "figure", "details", "span"}
WITH_MARK = re.compile(r"(?:area|bar|block|box|btns?|buttons?|container|content|form|group|inner|item|items|links?|list|main|module|outer|panel|posts?|articles?|stor(?:y|ies)|section|slot|text|top|bottom|left|right|thread|title|unit|wrap|wrapper|\d+)$", re.I)
_HEADERS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|banner)(?:$|[\s_-])", re.I)
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _marked_inside(value: str) -> bool:
    """Whether one of the names in a class or role says nothing but that its element is aside ("share-buttons", not "share-price")."""
    for name in value.split():
        marks = 0
        for word in re.split(r"[_-]+", name):
            if word and MARKS.search(word):
                marks += 1
            elif word and not WITH_MARK.match(word):
                break
        else:
            if marks:
                return True
    return False


def _aside(tag: str, attrs: str, inside: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not inside):
        return True
    if tag in ("body", "html", "article", "main") or not attrs:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value.lower() == "true"):
            return True
        if inside:
            if name.lower() in ("class", "role") and tag in CONTAINERS and _marked_inside(value):
                return True
        elif MARKS.search(value) or _HEADERS.search(value):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """The blocks of a page in order: (text with white space made single spaces, scope).

    Scope 2: in an article (or the main part) and not aside; 1: elsewhere and
    not aside; 0: aside. References are decoded; markup, comments, scripts and
    styles are left out; tags that are never closed end with their surroundings.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    skip: list = []  # tag and depth of the element that is aside
    article = 0
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            words = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if words:
                out.append((words, 0 if skip else 2 if article else 1))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        m = _PART.match(page, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            if attrs.endswith("/"):
                continue
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag == "head" and not end:
                end = re.compile(r"(?=<body\b)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in BLOCK and not skip and not attrs:
            continue
        if tag in BLOCK:
            flush()
        if tag in ("article", "main"):
            if closing:
                article = max(0, article - 1)
            else:
                # An aside that was left open ends where an article begins; comments may hold articles.
                if skip and skip[2] != "comments":
                    skip.clear()
                article += 1
            continue
        if skip:
            if tag == skip[0] and tag not in VOID:
                skip[1] += -1 if closing else 1
                if not skip[1]:
                    flush()
                    skip.clear()
        elif not closing and tag not in VOID and _aside(tag, attrs, article > 0):
            flush()
            skip[:] = [tag, 1, "comments" if re.search("comment|repl|disqus", attrs, re.I) else ""]
    flush()
    return out


def suffix_ranks(tokens: np.ndarray, depths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, rank of each suffix among all by its first ``depth`` tokens) for ascending depths, by prefix doubling."""
    rank, at, n = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1, len(tokens)
    for depth in depths:
        while at < depth:
            step = min(at, depth - at)  # overlapping halves give exactly `depth`
            after = np.full(n, -1, np.int64)
            after[: n - step] = rank[step:]
            rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
            at += step
        yield depth, rank


def _distinct(keys: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """For each key, how many distinct pages have it."""
    kind = np.unique(keys, return_inverse=True)[1]
    pairs = np.unique(kind * (int(pages.max(initial=0)) + 1) + pages)
    return np.bincount(pairs // (int(pages.max(initial=0)) + 1), minlength=int(kind.max(initial=-1)) + 1)[kind]


def covered(parsed: list[list[tuple[str, int]]], run: int = RUN, pages: int = PAGES, known: np.ndarray | None = None) -> list[list[tuple[int, bool]]]:
    """For each block of each page: its words that lie in repeated runs, and whether it stands whole in several pages.

    All text of the pages is one stream whose suffixes are ranked by prefix
    doubling. Outside articles a run of at least ``run`` words that stands there
    in ``pages`` distinct pages is repeated. A block of an article of at least
    ``run`` words is repeated if the same words between the same ends begin
    suffixes of ``pages`` distinct pages: two ranks, of its first and its last
    2^k words, tell. Pages whose blocks are all equal count as one. ``known`` are
    sorted hashes of runs and blocks that distinct pages elsewhere share.
    """
    kinds: dict[tuple, int] = {}
    same = [kinds.setdefault(tuple(b), len(kinds)) for b in parsed]
    ids: dict[str, int] = {}
    flat: list[int] = [0]  # 0 ends a block
    # Of each block: its page, the place of the end before it, its words, its scope.
    rows: list[tuple[int, int, int, int]] = []
    for b, k in kinds.items():
        for text, scope in b:
            words = text.split()
            rows.append((k, len(flat) - 1, len(words), scope))
            flat += [ids.setdefault(w, len(ids) + 1) for w in words]
            flat.append(0)
        flat.append(-1 - k)  # ends a page; equal to nothing
        flat.append(0)
    tokens = np.array(flat, np.int64)
    of, at, size, scope = np.array(rows or [(0, 0, 0, 0)], np.int64).T
    inside = (scope == 2) & (size >= run)
    # Words of blocks outside articles, by block, and those of them that have a whole run of such words after them.
    outer = np.flatnonzero(scope != 2)
    word = np.concatenate([np.arange(at[i] + 1, at[i] + 1 + size[i]) for i in outer]) if len(outer) else np.empty(0, np.int64)
    page = np.repeat(of[outer], size[outer])
    block = np.repeat(outer, size[outer])
    mark = np.zeros(len(word), bool)
    whole = np.zeros(len(rows), bool)
    # Runs go on over the ends of blocks: the words outside articles of a page are a stream of their own.
    stream = np.concatenate([np.r_[tokens[word[page == k]], -1 - k] for k in np.unique(page)]) if len(word) else np.empty(0, np.int64)
    owner = np.repeat(np.unique(page), np.bincount(page)[np.unique(page)] + 1) if len(word) else np.empty(0, np.int64)
    real = stream >= 0
    for _, rank in suffix_ranks(stream, [run] if len(stream) else []):
        edge = np.zeros(len(stream) + 1, np.int64)
        starts = np.flatnonzero(_distinct(rank, owner) >= pages)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + run, len(stream)), -1)
        mark = (np.cumsum(edge[:-1]) > 0)[real]
    level = np.floor(np.log2(np.maximum(size + 2, 1))).astype(int)
    levels = sorted({int(1 << v) for v in level[inside]})
    for depth, rank in suffix_ranks(tokens, levels):
        i = np.flatnonzero(inside & ((1 << level) == depth))
        first, last = rank[at[i]], rank[at[i] + size[i] + 2 - depth]
        key = np.unique(np.stack([first, last, size[i]]), axis=1, return_inverse=True)[1].ravel()
        whole[i] |= _distinct(key, of[i]) >= pages
    if known is not None and len(known):
        hashes = WordHashes()
        every = list(kinds)
        begin = np.searchsorted(page, np.arange(len(kinds)))
        for k, b in enumerate(every):
            hit = np.flatnonzero(np.isin(run_hashes(_stream(b), run, hashes), known))
            for j in range(run):
                mark[begin[k] + hit + j] = True
        found = set(known.tolist())
        for i in np.flatnonzero(inside & ~whole):
            whole[i] = block_hash(every[of[i]][i - int(np.searchsorted(of, of[i]))][0]) in found
    hits = np.bincount(block[mark], minlength=len(rows))
    begin = np.searchsorted(of, np.arange(len(kinds))) if rows else np.zeros(len(kinds), int)
    return [[(int(hits[begin[k] + j]), bool(whole[begin[k] + j])) for j in range(len(b))] for b, k in zip(parsed, same)]


def _stream(blocks_: list[tuple[str, int]] | tuple[tuple[str, int], ...]) -> list[str]:
    """The words outside articles."""
    return [w for t, s in blocks_ if s != 2 for w in t.split()]


def run_hashes(stream: list[str], run: int, hashes: WordHashes) -> np.ndarray:
    """The hash of each run of ``run`` words, in order."""
    return windows(hashes.of(stream), run).view(np.int64) if len(stream) >= run else np.empty(0, np.int64)


def block_hash(block: str) -> int:
    """The hash of a whole article block; unlike those of runs."""
    import xxhash

    return xxhash.xxh3_64_intdigest(block, 1) - 2**63


def _group_keys(parsed: list[tuple[str, int]], run: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, kinds) of the runs and article blocks of a page: a kind is a hash of what must differ in distinct pages."""
    import xxhash

    stream = _stream(parsed)
    runs = np.unique(run_hashes(stream, run, hashes))
    whole = np.array(sorted({block_hash(t) for t, s in parsed if s == 2 and t.count(" ") + 1 >= run}), np.int64)
    kind = xxhash.xxh3_64_intdigest(repr(parsed).encode("utf-8", "surrogatepass")) - 2**63
    return np.concatenate([runs, whole]), np.full(len(runs) + len(whole), kind, np.int64)


def _group(parsed: list[list[tuple[str, int]]], run: int, least: int, known: np.ndarray | None = None) -> list[tuple[str, int]]:
    out = []
    for b, found in zip(parsed, covered(parsed, run, least, known)):
        size = sum(t.count(" ") + 1 for t, s in b if s == 2)
        again = sum(t.count(" ") + 1 for (t, s), (_, whole) in zip(b, found) if s == 2 and whole)
        # An article that is mostly repeated is a copy, not boilerplate.
        copy = 2 * again > size
        kept, removed, rest = [], 0, []
        for (t, s), (hit, whole) in zip(b, found):
            n = t.count(" ") + 1
            if s == 2:
                if copy or not whole:
                    kept.append(t)
                else:
                    removed += n
                continue
            if s == 1:
                if not size:
                    rest.append(t)
                if 2 * hit < n:
                    kept.append(t)
                    continue
            removed += n
        # Where everything is repeated, the page is a copy, not boilerplate.
        out.append(("\n".join(kept or rest), removed))
    return out


def main_text(pages: DataFrame, run: int = RUN, least: int = PAGES, group: int = GROUP) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars (code points), n_removed (words outside the text).

    Null html counts as empty; a null or odd url is a host of its own kind;
    repeated rows give repeated rows; an empty table gives none.
    """
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    large = written(pages.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > group))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in text_slices(b["html"]):
                got = [blocks(t) for t in texts]
                # A block holds no line break, so blocks are the lines of one text.
                text = pa.array(["\n".join(t for t, _ in g) for g in got], pa.string())
                scopes = pa.array([bytes(s for _, s in g) for g in got], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b[c].slice(lo, hi - lo) for c in ("page_id", "url", "host")], text, scopes], ["page_id", "url", "host", "body", "scopes"])

    # Only text is moved, never markup.
    parsed = rows.mapInArrow(freed(parse), "page_id long, url string, host string, body string, scopes binary")
    bucket = F.pmod(F.xxhash64("page_id", "url"), F.coalesce(F.ceil(F.col("n") / group), F.lit(1)))
    # One key of its own for each group: pages are dealt by it, whatever the join dealt them by.
    dealt = joined(parsed, large, "host", "left").withColumn("g", F.concat_ws("-", F.xxhash64("host"), bucket))
    schema = "page_id long, url string, text string, n_chars long, n_removed long"

    def read(body: str, scopes: bytes) -> list[tuple[str, int]]:
        return list(zip(body.split("\n"), scopes)) if scopes else []

    def result(t: pa.Table, known: np.ndarray | None) -> pa.Table:
        got = _group(list(map(read, t["body"].to_pylist(), t["scopes"].to_pylist())), run, least, known)
        text = [g[0] for g in got]
        return pa.table({"page_id": t["page_id"], "url": t["url"].cast(pa.string()), "text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64()), "n_removed": pa.array([g[1] for g in got], pa.int64())})

    columns = ["g", "page_id", "url", "body", "scopes"]
    if not large.limit(1).count():
        return dealt.select(*columns).groupBy("g").applyInArrow(lambda t: result(t, None), schema)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for i in range(len(b)):
                got, kinds = _group_keys(read(b["body"][i].as_py(), b["scopes"][i].as_py()), run, hashes)
                n = len(got)
                yield pa.RecordBatch.from_arrays([pa.array([b["hh"][i].as_py()] * n, pa.int64()), pa.array([b["g"][i].as_py()] * n, pa.string()), pa.array(got), pa.array(kinds)], ["hh", "g", "h", "kind"])

    # Of each group a key goes on once, with the smallest and largest kind of page: memory and rows are bounded by its text.
    made = dealt.where("n is not null").select(F.xxhash64("host").alias("hh"), "g", "body", "scopes").mapInArrow(freed(keys), "hh long, g string, h long, kind long")
    many = F.min("low") < F.max("high") if least == 2 else F.size(F.array_distinct(F.flatten(F.collect_set("few")))) >= least
    few = F.slice(F.collect_set("kind"), 1, least) if least > 2 else F.lit(None).cast("array<long>")
    of = F.substring_index("g", "-", -1).cast("int").alias("bucket")
    held = written(made.groupBy("hh", "h", of).agg(F.min("kind").alias("low"), F.max("kind").alias("high"), few.alias("few")))
    shared = held.groupBy("hh", "h").agg(many.alias("many"), F.count("*").alias("groups")).where("many and groups > 1" if least > 1 else "groups > 1")
    told = joined(held.select("hh", "h", "bucket"), written(shared.select("hh", "h")), ["hh", "h"], "left_semi").select(F.concat_ws("-", "hh", "bucket").alias("g"), "h")

    def one(t: pa.Table, known: pa.Table) -> pa.Table:
        return result(t, np.sort(known["h"].to_numpy()) if len(known) else None) if len(t) else pa.table({n: pa.array([], x) for n, x in (("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_removed", pa.int64()))})

    return dealt.select(*columns).groupBy("g").cogroup(told.groupBy("g")).applyInArrow(one, schema)
