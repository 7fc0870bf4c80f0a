"""Main text of web pages: article structure and host suffix arrays.

A page is read into blocks. Scripts, styles and the head are skipped; blocks inside menus, page
headers, footers, sidebars, forms, adverts, notices and comments (by element, role, class or id) are chrome;
blocks inside ``article`` or ``main`` are its article, and of a page without such a landmark the
other blocks are. What of these is the host's own and not the page's is decided by suffix arrays over all blocks:

the token streams of a host's pages are concatenated, a
suffix array ordered by the first ``run`` tokens is built by prefix doubling, and its classes of equal suffixes
give the substrings found on several pages. Hosts are cut into parts of some ``group_pages`` pages or ``group_bytes`` bytes,
each a task of its own; a substring's ends and counts meet by hash across the parts, so a host with a
third of all pages is split without losing a repetition. Covered tokens go, unique runs stay; a repeated block shorter than
a run, such as a heading, goes only where it adjoins covered text.

Inside a landmark a run goes that more than half of the host's different articles hold, and ``least`` at least: a notice
without a telling class. Equal articles count as one, and a page that would lose half of its article keeps it
all, since it is a copy among near copies. Outside landmarks a run goes that two pages hold; there pages whose content (article
and other blocks) is the same all through count as one, since a copied article is no boilerplate.

Null and empty html give an empty text; a null url is a host of its own; a page without id is no evidence
of repetition but is extracted; equal rows are extracted each and count as one page. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from larder.llm import tokens
from larder.llm.common import broadcast_if_small, rows_per_batch, written
from larder.llm.tokens import U, mix

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SKIPPED = frozenset("script style head title template noscript iframe svg math canvas object audio video noframes noembed textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
CHROME = frozenset("nav footer aside form menu dialog button select search".split())
LANDMARK = frozenset("article main".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices
    alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies share sharing social
    related newsletter subscribe subscription copyright login signup search widget toolbar pagination""".split())


def _chrome(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in CHROME or (tag == "header" and not in_main):
        return True
    if not attributes or tag in LANDMARK or tag in ("html", "body"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and not HINTS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if name == "role" and value in CHROME_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def blocks(page: str) -> list[tuple[str, str]]:
    """(role, text) of each block in page order; role is main, chrome or other. White space inside is one space."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, int, int]] = []  # element, open chrome, open landmarks
    chrome = main = 0
    held: list[str] = []
    at = 0

    def close() -> None:
        if held:
            raw = "".join(held)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            held.clear()
            if text:
                out.append(("chrome" if chrome else "main" if main else "other", text))

    while m := _TAG.search(page, at):
        if m.start() > at:
            held.append(page[at: m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in SKIPPED:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if tag != "head" or end:  # a head that is never closed hides nothing
                    at = end.end() if end else len(page)
            continue
        boundary = tag in BLOCK
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if boundary or k is not None and stack[k][1:] != (chrome, main):
                close()
            if k is not None:
                _, chrome, main = stack[k]
                del stack[k:]
            continue
        inside = _chrome(tag, m[3], main > 0)
        if boundary or inside:
            close()
        if boundary and stack and stack[-1][0] == "p":  # an open paragraph ends where a block begins
            _, chrome, main = stack.pop()
        if tag not in VOID and not m[3].endswith("/"):
            stack.append((tag, chrome, main))
            chrome += inside
            main += tag in LANDMARK
    rest = page[at:]
    held.append(rest)
    close()
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def run_hashes(text: str | list[str], run: int) -> list[tuple[np.ndarray, int]]:
    """For each text: token hashes, and how many there are."""
    texts = [text] if isinstance(text, str) else text
    out = []
    for i, j, data, at in tokens.walk(pa.array(texts, pa.large_string())):
        s, e, row = tokens.spans(data, at)
        h = tokens.hashes(data, s, e, tokens.BYTE_EXACT)
        cut = np.searchsorted(row, np.arange(j - i + 1))
        out += [(h[cut[k]: cut[k + 1]], int(cut[k + 1] - cut[k])) for k in range(j - i)]
    return out


def keys_of(h: np.ndarray, run: int) -> np.ndarray:
    """Content hashes of the runs of ``run`` tokens of a block; of the whole block if it is shorter."""
    n = min(run, len(h))
    if not n:
        return np.zeros(0, dtype=U)
    v = np.full(len(h) - n + 1, n, dtype=U)
    for k in range(n):
        v = mix(v * U(0x9E3779B97F4A7C15) + h[k: len(h) - n + 1 + k])
    return v


def keys_at(streams: list[np.ndarray], block: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """``keys_of`` of the runs that begin at these places."""
    size = np.array([len(s) for s in streams], dtype=np.int64)
    start = np.cumsum(size) - size
    h = np.concatenate([*streams, np.zeros(run, dtype=U)])
    n, first = np.minimum(run, size[block]), start[block] + at
    v = n.astype(U)
    for k in range(run):
        v = np.where(k < n, mix(v * U(0x9E3779B97F4A7C15) + h[first + k]), v)
    return v.view(np.int64)


def suffix_classes(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the concatenated blocks by their first ``run`` tokens.

    Returns the start positions that begin a whole run (or a shorter block), in suffix order, the
    class of equal runs of each, and the block each lies in. Prefix doubling: ranks of 2h tokens from pairs of ranks of h.
    """
    size = np.array([len(s) for s in streams], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size + run)])
    rank = np.zeros(int(start[-1]), dtype=np.int64)  # between blocks: run times the end mark 0
    if size.sum():
        _, ids = np.unique(np.concatenate(streams), return_inverse=True)
        rank[np.concatenate([np.arange(a, a + n) for a, n in zip(start, size)])] = ids + 1
    order, h = np.arange(len(rank)), 1
    many = np.ones(len(rank), dtype=bool)  # places in the order whose suffix is not told from another yet
    while h < run:
        step = min(h, run - h)
        open_ = np.flatnonzero(many)
        mine = order[open_]
        after = np.minimum(mine + step, len(rank) - 1)
        both = rank[mine] * (len(rank) + 1) + np.where(mine + step < len(rank), rank[after], 0)
        by = np.argsort(both)
        mine, both = mine[by], both[by]
        order[open_] = mine
        new = np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.zeros(0, dtype=bool)
        begin = np.flatnonzero(new)
        # a class is named by the place in the order where it begins, so that names grow with the order; 0 stays the end mark's
        rank[mine] = np.where(rank[mine] > 0, open_[begin][np.cumsum(new) - 1] + 1, 0)
        many[open_] = np.repeat(np.diff(np.append(begin, len(both))) > 1, np.diff(np.append(begin, len(both)))) & (rank[mine] > 0)
        h += step
    block_of = np.repeat(np.arange(len(streams)), size + run)
    offset = np.arange(len(rank)) - start[block_of]
    valid = offset < np.maximum(size - run + 1, (size > 0).astype(np.int64))[block_of]
    order = order[valid[order]]
    return offset[order], rank[order], block_of[order]


def _digest(parts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _evidence(run: int):
    """The blocks outside landmarks and those inside, each dealt to a part of the host; equal articles of a task travel once."""

    def go(batches):
        seen = set()
        for b in batches:
            out = {c: [] for c in ("at", "part", "main", "texts", "content")}
            hosts, rows, parts = (b.column(c).to_pylist() for c in ("host", "row", "parts"))
            for at, (host, row, n) in enumerate(zip(hosts, rows, parts)):
                found = blocks(b.column("html")[at].as_py() or "")
                mine, outside = [t for r, t in found if r == "main"], [t for r, t in found if r != "main"]
                whole = _digest(mine)
                if outside:
                    judged = _digest([str(whole)] + [t for r, t in found if r == "other"])
                    for c, v in zip(out, (at, row % n, False, outside, judged)):
                        out[c].append(v)
                if mine and (host, whole) not in seen:
                    seen.add((host, whole))
                    for c, v in zip(out, (at, whole % n, True, mine, whole)):
                        out[c].append(v)
            at = pa.array(out["at"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(at) for c in ("page", "host", "parts")]
                + [pa.array(out["part"], pa.int32()), pa.array(out["main"], pa.bool_()), pa.array(out["texts"], pa.list_(pa.string())), pa.array(out["content"], pa.int64())],
                names=["page", "host", "parts", "part", "main", "texts", "content"])

    return go


def _bare(batches):
    """The pages without a landmark."""
    for b in batches:
        at, outside, other = [], [], []
        for i, page in enumerate(b.column("html")):
            parts = blocks(page.as_py() or "")
            if not any(r == "main" for r, _ in parts):
                at.append(i)
                outside.append([t for _, t in parts])
                other.append([r == "other" for r, _ in parts])
        yield pa.RecordBatch.from_arrays(
            [b.column(c).take(pa.array(at, pa.int64())) for c in ("page", "url", "row", "host")] + [pa.array(outside, pa.list_(pa.string())), pa.array(other, pa.list_(pa.bool_()))],
            names=["page", "url", "row", "host", "outside", "other"])


def _repeats(run: int, least: int):
    """Of one part of a host: the ends of each class outside landmarks, and the classes that most of its articles hold.
    A row without a key has the number of articles."""

    def go(t: pa.Table) -> pa.Table:
        pages, texts, contents = (t.column(c).to_pylist() for c in ("page", "texts", "content"))
        main, twice = np.array(t.column("main").to_pylist(), dtype=bool), set()
        for i in np.flatnonzero(main):
            if contents[i] in twice:
                texts[i] = []
            twice.add(contents[i])
        owner = np.array([i for i, ts in enumerate(texts) for _ in ts], dtype=np.int64)
        streams = [h for h, _ in run_hashes([x for ts in texts for x in ts], run)]
        at, cls, block = suffix_classes(streams, run)
        of, inside = owner[block], main[owner[block]]
        kind, host, n = t.schema.field("page").type, t.column("host")[0].as_py(), len(twice)
        out = []
        if not inside.all():
            c, o, k, p = (x[~inside] for x in (cls, of, block, at))
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            ids, held = np.array(pages)[o], np.array(contents, dtype=np.int64)[o]
            out.append((False, keys_at(streams, k[first], p[first], run), np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first),
                        np.minimum.reduceat(held, first), np.maximum.reduceat(held, first), np.zeros(len(first), dtype=np.int64)))
        if n:
            c, o, k, p = (x[inside] for x in (cls, of, block, at))
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, dtype=np.int64)
            often = np.diff(np.append(first, len(c)))
            some = np.repeat(2 * often > n, often)
            c, o, k, p = (x[some] for x in (c, o, k, p))
            _, one = np.unique(c * len(texts) + o, return_index=True)  # a class once an article
            _, first, held = np.unique(c[one], return_index=True, return_counts=True)
            most = (2 * held > n) & ((t.column("parts")[0].as_py() > 1) | (held >= least))
            at_most, held = one[first][most], held[most]
            k = keys_at(streams, k[at_most], p[at_most], run)
            none = pa.nulls(len(k) + 1)
            out.append((True, pa.array([*k.tolist(), None], pa.int64()), none, none, none, none, np.append(held, n)))
        if not out:
            out = [(False, *[pa.nulls(0)] * 6)]
        types = [("key", pa.int64()), ("low", kind), ("high", kind), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64())]
        return pa.concat_tables(pa.table(
            {"host": pa.array([host] * len(cols[0]), pa.string()), "main": pa.array([zone] * len(cols[0]), pa.bool_())}
            | {c: x.cast(ty) if isinstance(x, pa.Array) else pa.array(x, ty) for (c, ty), x in zip(types, cols)}) for zone, *cols in out)

    return go


def _held(run: int):
    """The runs each article holds."""

    def go(batches):
        for b in batches:
            hosts, contents, keys = [], [], []
            for host, page in zip(b.column("host").to_pylist(), b.column("html")):
                mine = [t for r, t in blocks(page.as_py() or "") if r == "main"]
                if mine:
                    k = np.unique(np.concatenate([keys_of(h, run) for h, _ in run_hashes(mine, run)])).view(np.int64)
                    hosts.append(np.full(len(k), len(contents)))
                    contents.append((host, _digest(mine)))
                    keys.append(k)
            at = np.concatenate(hosts) if hosts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in contents], pa.string()).take(pa.array(at)), pa.array([c for _, c in contents], pa.int64()).take(pa.array(at)),
                 pa.array(np.concatenate(keys) if keys else at, pa.int64())], names=["host", "content", "key"])

    return go


def _articles(run: int):
    """Texts of pages with a landmark: its blocks without the runs that are the host's own."""

    def go(batches):
        for b in batches:
            at, text = [], []
            for i, (page, own) in enumerate(zip(b.column("html"), b.column("own").to_pylist())):
                mine = [t for r, t in blocks(page.as_py() or "") if r == "main"]
                if not mine:
                    continue
                if own:
                    mine = _without(mine, np.array(own, dtype=np.int64), run)
                at.append(i)
                text.append(" ".join(mine))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("page").take(at), b.column("url").take(at), pa.array(text, pa.string())], names=["page", "url", "text"])

    return go


def _without(mine: list[str], own: np.ndarray, run: int) -> list[str]:
    """The blocks without the tokens of ``own`` runs; as they are if that is half of them: then the page is a copy among copies."""
    found, words = [], [re.findall(r"[^ \t-\r]+", t) for t in mine]
    for k, (h, n) in enumerate(run_hashes(mine, run)):
        found += [{"block": k, "pos": int(p), "size": min(run, n)} for p in np.flatnonzero(np.isin(keys_of(h, run).view(np.int64), own))]
    gone = _covered(found, [len(w) for w in words], run)
    if not gone or 2 * len(gone) >= sum(map(len, words)):
        return mine
    kept = [" ".join(w for p, w in enumerate(ws) if (k, p) not in gone) for k, ws in enumerate(words)]
    return [t for t in kept if t]


def _runs(run: int):
    """Every run of the other blocks of pages without a landmark."""

    def go(batches):
        for b in batches:
            rows, hosts, block, pos, size, keys = [], [], [], [], [], []
            for row, host, texts, other in zip(*(b.column(c).to_pylist() for c in ("row", "host", "outside", "other"))):
                for k, ((h, n), use) in enumerate(zip(run_hashes(texts, run), other)):
                    for p, key in enumerate(keys_of(h, run).view(np.int64).tolist() if use else ()):
                        rows.append(row), hosts.append(host), block.append(k), pos.append(p), size.append(min(run, n)), keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hosts, pa.string()), pa.array(block, pa.int32()), pa.array(pos, pa.int32()),
                                              pa.array(size, pa.int32()), pa.array(keys, pa.int64())], names=["row", "host", "block", "pos", "size", "key"])

    return go


def _covered(found: list[dict], words: list[int], run: int) -> set[tuple[int, int]]:
    """(block, position) of the tokens to go; ``words`` has the token count of each block, 0 for those that are not judged."""
    gone = {(c["block"], p) for c in found if c["size"] >= run for p in range(c["pos"], c["pos"] + c["size"])}
    short = {c["block"] for c in found if c["size"] < run}
    for order, step in ((sorted(short), -1), (sorted(short, reverse=True), 1)):
        for k in order:  # a neighbour may itself be a short block that has gone
            if 0 <= k + step < len(words) and (k + step, words[k + step] - 1 if step < 0 else 0) in gone:
                gone |= {(k, p) for p in range(words[k])}
    return gone


def _unique(run: int):
    """Texts of pages without a landmark: their other blocks without the covered tokens."""

    def go(batches):
        for b in batches:
            text = []
            for texts, other, covered in zip(*(b.column(c).to_pylist() for c in ("outside", "other", "covered"))):
                words = [re.findall(r"[^ \t-\r]+", t) if use else [] for t, use in zip(texts, other)]
                gone = _covered(covered or [], [len(w) for w in words], run)
                kept = [" ".join(w for p, w in enumerate(ws) if (k, p) not in gone) for k, ws in enumerate(words)]
                text.append(" ".join(t for t in kept if t))
            yield pa.RecordBatch.from_arrays([b.column("page"), b.column("url"), pa.array(text)], names=["page", "url", "text"])

    return go


def main_text(df: DataFrame, run: int = 8, group_pages: int = 2000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              group_bytes: int = 1 << 23, least: int = 4) -> DataFrame:
    """One row per page: id, url, text (blocks in page order joined by a space, empty if none)."""
    if run < 2:
        raise ValueError("a run has at least two tokens")
    rows_per_batch(df.sparkSession, 256)
    pages = df.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    pages = pages.select("page", "url", F.xxhash64("page", "url", "html").alias("row"), host_of(F.col("url")).alias("host"), "html")
    page, url = (pages.schema[c].dataType.simpleString() for c in ("page", "url"))
    sizes = pages.groupBy("host").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / group_pages), F.ceil(F.sum(F.octet_length("html")) / group_bytes)).cast("int").alias("parts"))
    # a host of several parts has that many pages or bytes, so there are few
    large = pages.join(F.broadcast(sizes.where("parts > 1")), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    evidence = large.where("page IS NOT NULL").select("page", "row", "host", "parts", "html").mapInArrow(
        _evidence(run), f"page {page}, host string, parts int, part int, main boolean, texts array<string>, content long")
    found = evidence.repartition("host", "part").groupBy("host", "part").applyInArrow(
        _repeats(run, least), f"host string, main boolean, key long, low {page}, high {page}, first long, last long, n long")
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")]
    # two pages and two contents: then some two pages differ in both
    verdicts = written(found.groupBy("host", "main", "key").agg(*ends).where("main OR low <> high AND first <> last").select("host", "main", "key", "n"), "repeats")
    repeated = verdicts.where("NOT main").select("host", "key")
    # a run that most articles of the host hold is in most of one part's at least; those are counted over all parts
    likely = verdicts.where("main AND key IS NOT NULL").select("host", "key")
    articles = verdicts.where("main AND key IS NULL").select("host", F.col("n").alias("articles"))
    among = pages.where("page IS NOT NULL").join(broadcast_if_small(likely.select("host").distinct()), "host", "left_semi").select("host", "html")
    held = among.mapInArrow(_held(run), "host string, content long, key long").join(broadcast_if_small(likely), ["host", "key"], "left_semi")
    held = held.distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    own = held.join(articles, "host").where((F.col("n") >= least) & (2 * F.col("n") > F.col("articles")))
    own = written(own.groupBy("host").agg(F.collect_list("key").alias("own")), "own")
    told = pages.join(broadcast_if_small(own), "host", "left").select("page", "url", "html", "own")
    bare = written(pages.mapInArrow(_bare, f"page {page}, url {url}, row long, host string, outside array<string>, other array<boolean>"), "bare")
    covered = bare.mapInArrow(_runs(run), "row long, host string, block int, pos int, size int, key long").join(
        repeated, ["host", "key"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("block", "pos", "size")).alias("covered"))
    rest = bare.join(covered, "row", "left").mapInArrow(_unique(run), f"page {page}, url {url}, text string")
    out = told.mapInArrow(_articles(run), f"page {page}, url {url}, text string").unionByName(rest)
    return out.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text")
