"""Main text of web pages by union-free wrapper inference.

A page is a stream of blocks: runs of text with the path of containers they stand in.  Runs of equal
blocks fold into repeated groups, which gives a union-free expression (items with a quantifier
1, ?, + or *, and their text, the first of a container marked).  The expressions of a host are aligned one after
another: equal items match, what only one
side has becomes optional (a mismatch is thus resolved as an optional or repeated group), and texts that differ become a
slot, until one wrapper matches all pages of the host.  A text that is the same on all pages that have its place, at least
``TEMPLATE`` different ones, belongs to the template.  Pages of one structure are put together before any host's are, and
a host's are folded in salted parts first, so a host with a third of all pages is no single task.

A page is matched against its host's wrapper, so each block has a place in it.  Its text is the text of the blocks inside an
article by the containers' meaning; where the page names none, of those that meet a slot and aren't mostly links.  Text
inside a named article stays even if it is the same on all pages, unless the block's own class names it as something else.

A null or empty html gives an empty text; a null url is a host of its own; repeated pages give a row each; broken markup is
read as far as it goes, in time linear in the page, however long.  An empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialise

#: Fixed names of the markup language.
CONTAINERS = frozenset("html head body header nav main article section aside footer div form ul ol dl table fieldset dialog menu figure details".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption summary address hr title legend option button label".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas select button".split())
CHROME = frozenset("head nav aside footer form dialog menu fieldset".split())
#: Words in a class, id or role that name what isn't main text.
CHROME_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|side-bar|aside|rail|widget|menu|nav\w*|breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|comments?|comment-\w+|replies|respond|disqus|discussion|share|sharing|social|related|recommend\w*|search\w*|skip-?link|complementary|contentinfo)(?:[^a-z]|$)"
)
#: A tag's attributes are read once (possessive); a tag whose quotes swallow all that follows ends at its first ">".
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?:((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>|([^>]*+)>)""", re.S)
#: A tag that the page's end cuts off; the matcher of whole tags has taken all others.
_UNFINISHED = re.compile(r"<(?:[a-zA-Z/!?][^<]*)?\Z")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SALTS = 16
#: Share of link text from which an item without an article around it isn't content.
LINKS = 0.5
#: Different pages of a host from which a text that never varies belongs to the template.
TEMPLATE = 3


def _marks(attributes: str) -> str:
    """Class, id and role in lower case, or "hidden"."""
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            out.append(value)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return "hidden"
    return " ".join(out)


def blocks(html: str | None) -> list[tuple[str, str, int]]:
    """(item, text, characters in links) of each block with text.

    The item is the path of containers and the block's tag, after a ">" where a container began or ended since the last block.
    """
    html = html or ""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []  # tag, and what it adds to the path
    text: list[str] = []
    links = in_link = 0
    tag, at, path, edge = "", 0, "", ">"

    def close() -> None:
        nonlocal links, edge
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append((f"{edge}{path}|{tag}", whole, min(links, len(whole))))
                edge = ""
            text.clear()
            links = 0

    # Beyond the last ">" there is no tag, so every "<" before it is matched or not within one pass.
    stop_at = html.rfind(">") + 1
    while m := _TOKEN.search(html, at, stop_at):
        if m.start() > at:
            text.append(html[at : m.start()])
            if in_link:
                links += m.start() - at
        at = m.end()
        if m[2] is None:
            if at == stop_at and m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "]]>")):
                at = len(html)
                break
            continue
        name, ends, said = m[2].lower(), bool(m[1]), m[3] if m[3] is not None else m[4]
        if name in RAW and not ends:
            if m[0].endswith("/>") and name in ("svg", "math"):
                continue
            stop = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = stop.end() if stop else len(html)
            if name not in ("svg", "math"):
                text.append(" ")
            continue
        if name == "a":
            in_link = 0 if ends else 1
        elif name == "br":
            text.append(" ")
        elif name in CONTAINERS:
            close()
            tag, in_link, edge = "", 0, ">"
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                marks = _marks(said) if said.strip() else ""
                stack.append((name, f"{name}.{marks}" if marks else name))
            path = "/".join([x for _, x in stack])
        elif name in BLOCKS:
            close()
            tag = "" if ends else name
            if said.strip() and not ends and name in ("p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
                marks = _marks(said)
                tag = f"{name}.{marks}" if marks else name
    if at < len(html):
        text.append(_UNFINISHED.sub("", html[at:]))
    close()
    return out


@dataclass(frozen=True)
class Meaning:
    """What the marks of an item say."""

    chrome: bool  # by the names of the markup language, or hidden
    article: bool
    #: Paths of the containers with a chrome word, around the innermost article and inside it (or where there is none).
    around: tuple[str, ...]
    inside: tuple[str, ...]
    word: bool  # the block's own


@lru_cache(1 << 16)
def meaning(item: str) -> Meaning:
    path, _, tag = item.rpartition("|")
    parts = [p for p in path.split("/") if p]
    names = [p.partition(".")[0] for p in parts]
    last = max((i for i, n in enumerate(names) if n in ("article", "main")), default=-1)
    head = re.fullmatch(r"h[1-6].*", tag) and last >= 0
    chrome = any(n in CHROME or n in ("title", "label", "legend", "option", "button") or (n == "header" and not head) for n in [*names, tag.partition(".")[0]])
    chrome = chrome or any(p.partition(".")[2] == "hidden" for p in [*parts, tag])
    worded = [i for i, n in enumerate(names) if n not in ("html", "body", "article", "main") and CHROME_WORDS.search(parts[i].partition(".")[2])]
    around, inside = (tuple("/".join(parts[: i + 1]) for i in worded if (i < last) == w) for w in (True, False))
    return Meaning(chrome, last >= 0, around, inside, bool(CHROME_WORDS.search(tag.partition(".")[2])))


def _digest(texts) -> int:
    return int.from_bytes(blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")


def fold(items: list[str]) -> list[list]:
    """Union-free expression of a block stream: [items of a group, quantifier], repeated neighbours of up to three items folded."""
    out: list[list] = []
    single = lambda g: g[1] == "1" and len(g[0]) == 1
    for x in items:
        out.append([[x], "1"])
        for k in (1, 2, 3):
            if len(out) <= k or not all(map(single, out[-k:])):
                continue
            tail = [g[0][0] for g in out[-k:]]
            if out[-k - 1][0] == tail:
                del out[-k:]
                out[-1][1] = "+"
                break
            if len(out) >= 2 * k and all(map(single, out[-2 * k : -k])) and [g[0][0] for g in out[-2 * k : -k]] == tail:
                out[-2 * k :] = [[tail, "+"]]
                break
    return out


def _lengths(expression: list[list], found: list[tuple[str, str, int]]) -> list[int]:
    """Blocks of each group of a page's expression; a group is never followed by one more repetition of it."""
    out, i = [], 0
    for g in expression:
        k = end = len(g[0])
        while g[1] == "+" and [x for x, _, _ in found[i + end : i + end + k]] == g[0]:
            end += k
        out.append(end)
        i += end
    return out


def express(found: list[tuple[str, str, int]]) -> list[list]:
    """fold() with the text of each item of a group: [digest of its different texts in order, [digest of the page]]."""
    out, i = fold([x for x, _, _ in found]), 0
    page = _digest(t for _, t, _ in found)
    for g, n in zip(out, _lengths(out, found), strict=True):
        k = len(g[0])
        g.append([[_digest(dict.fromkeys(t for _, t, _ in found[i + o : i + n : k])), [page]] for o in range(k)])
        i += n
    return out


def _same_text(a: list, b: list) -> list:
    """Text of two matching items: a constant with (at most TEMPLATE of) the pages that have it, or a slot."""
    if not a or not b or a[0] != b[0]:
        return []
    return [a[0], sorted({*a[1], *b[1]})[:TEMPLATE]]


_JOIN = {("1", "1"): "1", ("1", "+"): "+", ("+", "+"): "+", ("1", "?"): "?", ("?", "?"): "?"}


def align(a: list[list], b: list[list]) -> list[list]:
    """An expression that matches what either matches; what only one has becomes optional, and texts that differ a slot."""
    names_a, names_b = ["\n".join(g[0]) for g in a], ["\n".join(g[0]) for g in b]
    out: list[list] = []
    optional = {"1": "?", "?": "?", "+": "*", "*": "*"}
    for op, a1, a2, b1, b2 in SequenceMatcher(None, names_a, names_b, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[a1:a2], b[b1:b2], strict=True):
                q = tuple(sorted((x[1], y[1]), key="1+?*".index))
                texts = [[_same_text(t, u) for t, u in zip(x[2], y[2], strict=True)]] if len(x) > 2 else []
                out.append([x[0], _JOIN.get(q, "*"), *texts])
        else:
            out += [[g[0], optional[g[1]], *g[2:]] for g in [*a[a1:a2], *b[b1:b2]]]
    return out


class Matcher:
    """A host's wrapper, ready to be matched with its pages."""

    def __init__(self, wrapper: list[list], links: dict[str, list[int]]) -> None:
        self.wrapper, self.links = wrapper, links
        self._names = ["\n".join(g[0]) for g in wrapper]
        self._after: dict[int, dict[str, list[int]]] = {}
        self._held: dict[tuple[str, bool], bool] = {}

    def _holds_most(self, container: str, article: bool) -> bool:
        """Whether a container has most of the host's text inside articles (or outside them)."""
        key = container, article
        if key not in self._held:
            sizes = [(x, n) for x, (_, n) in self.links.items() if not meaning(x).chrome and meaning(x).article == article]
            self._held[key] = 2 * sum(n for x, n in sizes if x.startswith((container + "/", container + "|"))) > sum(n for _, n in sizes)
        return self._held[key]

    def _next(self, at: int) -> dict[str, list[int]]:
        """Groups that may follow group at (-1: the start), by the names of their items."""
        if at not in self._after:
            out: dict[str, list[int]] = {}
            for k in range(at + 1, len(self.wrapper)):
                out.setdefault(self._names[k], []).append(k)
                if self.wrapper[k][1] in "1+":
                    break
            self._after[at] = out
        return self._after[at]

    def match(self, expression: list[list]) -> list[int]:
        """The wrapper's group that each group of a page's expression meets.

        Of all matches that with the most constant texts met, less those missed.  Every page of the host has one, as align()
        keeps all groups of either side in order.
        """
        best: dict[int, int] = {-1: 0}
        back: list[dict[int, int]] = []
        for items, q, texts in expression:
            now: dict[int, int] = {}
            came: dict[int, int] = {}
            name = "\n".join(items)
            for at, score in best.items():
                for to in self._next(at).get(name, ()):
                    if q == "+" and self.wrapper[to][1] not in "+*":
                        continue
                    s = score + sum((1 if k[0] == t[0] else -1000) for k, t in zip(self.wrapper[to][2], texts, strict=True) if k)
                    if s > now.get(to, -1 << 60):
                        now[to], came[to] = s, at
            best = now
            back.append(came)
        # What follows the last group must be optional.
        done = {at: s for at, s in best.items() if all(g[1] in "?*" for g in self.wrapper[at + 1 :])}
        at = max(done, key=lambda x: (done[x], -x))
        out = []
        for came in reversed(back):
            out.append(at)
            at = came[at]
        return out[::-1]

    def template(self, found: list[tuple[str, str, int]]) -> list[bool]:
        """Whether each block of a page meets a text that belongs to the template."""
        expression, out = express(found), []
        for (items, _, _), at, n in zip(expression, self.match(expression), _lengths(expression, found), strict=True):
            fixed = [bool(t) and len(t[1]) >= TEMPLATE for t in self.wrapper[at][2]]
            out += fixed * (n // len(items))
        return out

    def content(self, found: list[tuple[str, str, int]]) -> list[bool]:
        """Whether each block of a page is main text.

        A chrome word says nothing of a container that has most of the host's text, nor of one around the page's only articles.
        """
        items = [x.lstrip(">") for x, _, _ in found]
        said = {x: meaning(x) for x in items}
        article = {x for x, m in said.items() if m.article and not m.chrome and all(self._holds_most(p, True) for p in m.inside)}
        if article:
            free = {x for x in article if all(self._holds_most(p, True) for p in said[x].around)}
            article = free or article
            if not any(said[x].word for x in article):
                return [x in article for x in items]
        plain = {x for x, m in said.items() if not m.chrome and not m.word and all(self._holds_most(p, False) for p in m.inside)}
        out = []
        for x, template in zip(items, self.template(found), strict=True):
            linked, total = self.links.get(x, [0, 1])
            fixed = template or linked >= LINKS * max(1, total)
            # Inside an article a block's own word needs the wrapper's word too.
            out.append(x in article and not (said[x].word and fixed) if article else x in plain and not fixed)
        return out


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def _structure(expression: list[list]) -> str:
    return json.dumps([g[:2] for g in expression])


def _put(seen: dict, key, expression: list[list]) -> None:
    """Keep one expression of a structure, texts that differ as slots."""
    have = seen.setdefault(key, expression)
    if have is not expression:
        for x, y in zip(have, expression, strict=True):
            x[2] = [_same_text(t, u) for t, u in zip(x[2], y[2], strict=True)]


def _merge(rows: list[tuple[str, str]]) -> tuple[str, str]:
    """Fold (expression, link statistics) pairs, longest structure first."""
    seen: dict[str, list[list]] = {}
    links: dict[str, list[int]] = {}
    for e, s in rows:
        x = json.loads(e)
        _put(seen, _structure(x), x)
        for k, (p, q) in json.loads(s).items():
            have = links.setdefault(k, [0, 0])
            have[0] += p
            have[1] += q
    wrapper: list[list] | None = None
    for k in sorted(seen, key=lambda k: (-len(k), k)):
        wrapper = seen[k] if wrapper is None else align(wrapper, seen[k])
    return json.dumps(wrapper or []), json.dumps(links, sort_keys=True)


def infer(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, wrapper, links) of every host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, list] = {}
            stats: dict[tuple, dict] = {}
            for host, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = blocks(h)
                e = express(found)
                k = (host, _structure(e))
                _put(seen, k, e)
                links = stats.setdefault(k, {})
                for x, t, n in found:
                    have = links.setdefault(x.lstrip(">"), [0, 0])
                    have[0] += n
                    have[1] += len(t)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([json.dumps(seen[k]) for k in keys], pa.string()), pa.array([json.dumps(stats[k]) for k in keys], pa.string())], ["host", "wrapper", "links"])

    def fold_part(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        w, s = _merge(list(zip(g["wrapper"], g["links"], strict=True)))
        return pd.DataFrame({"host": [key[0]], "wrapper": [w], "links": [s]})

    kind = "host string, wrapper string, links string"
    each = pages.select(_host(pages[url]).alias("host"), pages[html].alias("html")).mapInArrow(run, kind)
    parts = each.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))).groupBy("host", "salt").applyInPandas(fold_part, kind)
    return parts.groupBy("host").applyInPandas(fold_part, kind)


def apply(wrapper: str, links: str, html: str | None, cache: dict) -> str:
    """Text of the page's blocks that are main text by its host's wrapper."""
    matcher = cache.get(wrapper)
    if matcher is None:
        if len(cache) > 2000:
            cache.clear()
        matcher = cache[wrapper] = Matcher(json.loads(wrapper), json.loads(links))
    found = blocks(html)
    return "\n".join([t for (_, t, _), c in zip(found, matcher.content(found), strict=True) if c])


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    wrappers, _ = materialise(infer(pages, html, url), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            texts = [apply(w, s, h, cache) for h, w, s in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].alias("url"), pages[html].alias("html")).withColumn("host", _host(F.col("url")))
    return rows.join(wrappers, "host").select("page_id", "url", "html", "wrapper", "links").mapInArrow(run, "page_id long, url string, text string, n_chars long")
