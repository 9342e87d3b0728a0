"""HTML extraction by equivalence-class template deduction.

Each page is read as a run of tokens: elements, by the path of their open elements (with class, id and role, digits left out), and
text nodes, by their element's path and words. Over all pages of a host, tokens with the same occurrence vector (the same count on
every page) form an equivalence class; a class is valid if it has at least ``least_size`` tokens and stands on at
least ``least_share`` of the host's pages. On a page, elements of valid classes whose parents are such elements nest into the
template's skeleton; text nodes of valid classes are fixed, all other text fills the slot of the skeleton element around it. On a host without a template every
element is skeleton and every text fills a slot.

1. Elements that HTML itself sets apart (navigation, footers, asides, scripts, hidden ones) hold no main text. Elements whose class
   or id names such a thing as a whole token ("ad", "comment-list", not "comments-open") don't either, unless one is around the page's heading
   or main element and most of the text, or around all of it.
2. The main container is the deepest skeleton element with ``main_share`` or more of the slots' text outside links, text in article and main elements counting ``MAIN_WEIGHT`` times; from there it goes up to an
   article or main element around it or, if it has no first-level heading, to a parent that has one.
3. In the container, lists and boxes that are links nearly throughout are menus and go. A block (a paragraph, a heading, an item) whose text nodes are all fixed goes if its box is fixed throughout; in one box with varying blocks it
   is the article's own, outside article and main elements only between them. A fixed word in a sentence that varies stays. Where all of a container is fixed, as on a host of copies, nothing tells the slots and it stays whole.
4. Where the article's text stands in the container itself, small boxes of the template after the last of it are what the site appends, readers' comments and links to other articles, whatever their names; they go.

An occurrence vector is never built: its fingerprint is the sum, over pages, of a hash of (page, count), so
a host with a third of all pages is summed up in partial aggregates like any other. Templates are broadcast only if they have few
tokens together, and joined by host otherwise.

Defined cases: null or empty html gives an empty text; pages without a url form the host ""; a host with
fewer than three pages has no template; repeated page rows count as pages; unclosed, misnested and cut-off
markup is read on, an end tag closing the nearest open element of its name; of containers with equal text the deepest counts; very long pages are read whole; an empty
table gives an empty result; extra columns don't take part.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, mix_int, small, values_of

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*\Z|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: One attribute and its value; read in sequence, so that no name is found inside another name or a value.
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_PART = re.compile(r"[a-z]+|[0-9]+")
_NUMBER = re.compile(r"[0-9]+")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NOISE_TAGS = frozenset("head title nav footer aside script style noscript template iframe svg canvas object embed button select input textarea option menu dialog audio video map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words that name an element outside the main text, if a class or id has them and neutral words only.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "masthead topbar comment comments disqus reply replies respond notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login "
    "social share sharing related recommended recommendations widget toolbar pagination pager toc skip".split()
)
NEUTRAL_WORDS = frozenset(
    "area article author bar blog block body bottom box button buttons cell col column container content count entry first form global group icon inner item items last left "
    "link links list main outer page panel policy post primary reader readers right row secondary section site slot slots thread title top unit user wrap wrapper zone".split()
)
#: Elements that can be the main container.
CONTAINERS = frozenset("article center div main section td".split())
#: Lists and boxes that are menus if they are links nearly throughout.
BOXES = frozenset("div dl ol section table ul".split())
CLOSES = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
MAIN = frozenset(["article", "main"])
#: How much more text in an article or main element counts when the main container is chosen.
MAIN_WEIGHT = 8
#: Elements that break a line inside a block.
BREAKS = frozenset(["br"])


def names_noise(value: str) -> bool:
    """Whether a class or id has a token of noise and neutral words, with one noise word or more."""
    for name in value.split():
        words = _PART.findall(name)
        if any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words):
            return True
    return False


class Page:
    """A page's elements, in order, with their parents; and its runs of text, with their elements, in blocks."""

    def __init__(self, html: str):
        self.parent, self.name, self.path = [0], [""], [0]
        self.apart: list[bool] = [False]  # in an element that HTML sets apart
        self.named: list[bool] = [False]  # told apart by its name
        self.main: list[int] = [0]  # the outermost article or main element around it
        self.blocks: list[list[tuple[int, str]]] = [[]]
        at, top = 0, 0
        while m := _TOKEN.match(html, at):
            t, at = m.group(), m.end()
            if t[0] != "<" or len(t) == 1:
                self.blocks[-1].append((top, t))
                continue
            if t[1] in "!?":
                continue
            name = _NAME.match(t)[1].lower()
            if t[1] == "/":
                top = self.closed(top, name)
                self.bounded(top, name)
                continue
            top = self.implied(top, name)
            attributes: dict[str, str] = {}
            if len(t) > len(name) + 2:
                for a in _ATTRIBUTE.finditer(t, _NAME.match(t).end()):
                    attributes.setdefault(a[1].lower(), (a[2] or a[3] or a[4] or "").lower())
            self.bounded(top, name)
            element = self.opened(top, name, attributes)
            if name in VOID or t.endswith("/>"):
                continue
            top = element
            if name in RAW:
                # all up to the end tag is one text, whatever stands in it
                close = _CLOSE[name].search(html, at)
                end = close.start() if close else len(html)
                if end > at:
                    self.blocks[-1].append((top, html[at:end]))
                at = end

    def bounded(self, element: int, name: str) -> None:
        if name in BREAKS:
            self.blocks[-1].append((element, " "))
        elif name not in INLINE and self.blocks[-1]:
            self.blocks.append([])

    def closed(self, top: int, name: str) -> int:
        at = top
        while at:
            if self.name[at] == name:
                return self.parent[at]
            if self.name[at] in ("article", "main", "body", "table", "nav", "aside", "footer") and name in INLINE | {"p", "li"}:
                return top
            at = self.parent[at]
        return top

    def implied(self, top: int, name: str) -> int:
        """A block start closes an open p (and inline elements left open in it), an item the item before."""
        for open_name, closers in CLOSES.items():
            if name in closers:
                at = top
                while at and (self.name[at] in INLINE or self.name[at] == open_name):
                    if self.name[at] == open_name:
                        top = self.parent[at]
                        break
                    at = self.parent[at]
        return top

    def opened(self, top: int, name: str, attributes: dict[str, str]) -> int:
        role = attributes.get("role", "")
        kind = _NUMBER.sub("#", f"{attributes.get('class', '')}#{attributes.get('id', '')}@{role}") if attributes else ""
        main = self.main[top]
        apart = self.apart[top] or name in NOISE_TAGS or "hidden" in attributes or attributes.get("aria-hidden") == "true" or role in NOISE_ROLES or "display:none" in attributes.get("style", "").replace(" ", "")
        element = len(self.name)
        named = False
        if name not in ("html", "body") and (name == "form" or name == "header" and not main or any(names_noise(attributes[k]) for k in ("class", "id") if k in attributes)):
            named = True
        self.parent.append(top)
        self.name.append(name)
        self.path.append(zlib.crc32(f"{self.path[top]}/{name}.{kind}".encode("utf-8", "surrogatepass")))
        self.apart.append(apart)
        self.named.append(named)
        self.main.append(main or (element if name in MAIN or role == "main" else 0))
        return element

    def summed(self, values: list[int]) -> list[int]:
        """Each element's value and those of all elements in it."""
        for i in range(len(values) - 1, 0, -1):
            values[self.parent[i]] += values[i]
        return values


def token_number(path: int, text: str = "") -> int:
    """A token's 63-bit number: a tag by its path, a text node by path and words."""
    return mix_int((path << 32 | zlib.crc32(text.encode("utf-8", "surrogatepass"))) + (len(text) << 8)) >> 1


def shown(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def tokens(html: str | None) -> dict[int, int]:
    """Token numbers of a page and how often each stands on it."""
    page, found = Page(html or ""), {}
    for path in page.path[1:]:
        n = token_number(path)
        found[n] = found.get(n, 0) + 1
    for block in page.blocks:
        for element, value in block:
            if not page.apart[element] and (text := shown(value)):
                n = token_number(page.path[element], text)
                found[n] = found.get(n, 0) + 1
    return found


def host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def templates(pages: DataFrame, least_size: int = 3, least_share: float = 0.6) -> DataFrame:
    """host and the numbers of its template's tokens, for hosts with three pages or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, numbers, prints = [], [], []
        for h, key, html in zip(*(values_of(c) for c in batch.columns)):
            for n, count in tokens(html).items():
                hosts.append(h)
                numbers.append(n)
                prints.append(mix_int((key ^ count * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> 32)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(numbers, pa.int64()), pa.array(prints, pa.int64())], names=["host", "token", "print"])

    hashed = pages.select(F.xxhash64(host()).alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    per_token = map_batches(hashed, run, "host long, token long, print long").groupBy("host", "token").agg(F.sum("print").alias("print"), F.count("*").alias("pages")).where("pages > 2")
    sizes = hashed.groupBy("host").agg(F.count("*").alias("n")).where("n > 2")
    likely = cut(per_token.join(small(sizes, sizes.count()), "host").where(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("n") * least_share))))
    valid = likely.groupBy("host", "print", "pages").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    return likely.join(valid.select("host", "print", "pages"), ["host", "print", "pages"], "left_semi").groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("template"))


def excluded(page: Page, every: list[int], headed: list[int]) -> list[bool]:
    """Which elements lie in one that is apart, or that its name tells apart and that is not around the main text."""
    out = list(page.apart)
    for i in range(1, len(out)):
        told = page.named[i] and not (every[i] == every[0] or headed[i] and 2 * every[i] > every[0])
        out[i] = bool(out[i] or out[page.parent[i]] or told)
    return out


def main_text(html: str | None, template: frozenset[int] | set[int], main_share: float = 0.6) -> str:
    """The text in the slots of a page's main container."""
    if not html:
        return ""
    page = Page(html)
    n = len(page.name)
    # every run of text outside elements set apart: its block, element, text and whether it is fixed
    runs = []
    for k, block in enumerate(page.blocks):
        for element, value in block:
            if not page.apart[element]:
                text = entities.unescape(value)
                words = " ".join(text.split())
                runs.append((k, element, text, len(words), bool(words and template) and token_number(page.path[element], words) in template))
    own, slot, links, in_link = [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.name[i] == "a"
    for _, element, _, size, fixed in runs:
        own[element] += size
        links[element] += size * in_link[element]
        slot[element] += 0 if fixed or in_link[element] else size * (MAIN_WEIGHT if page.main[element] else 1)
    every = page.summed(own)
    headed = page.summed([int(name in ("h1", "main")) for name in page.name])

    noise = excluded(page, every, headed)
    for i in range(n):
        if noise[i]:
            slot[i] = 0
    slots = page.summed(slot)
    skeleton = [not template] * n
    skeleton[0] = True
    if template:
        for i in range(1, n):
            skeleton[i] = skeleton[page.parent[i]] and token_number(page.path[i]) in template
    container, best = 0, slots[0]
    for i in range(1, n):
        if page.name[i] in CONTAINERS and skeleton[i] and not noise[i] and slots[i] and slots[i] >= main_share * slots[0] and (slots[i] <= best or container == 0):
            container, best = i, slots[i]
    if page.main[container]:
        container = page.main[container]
    elif container and not headed[container]:
        up = page.parent[container]
        if page.name[up] not in ("", "html", "body") and not noise[up] and any(page.parent[i] == up and page.name[i] == "h1" for i in range(up + 1, n)):
            container = up
    inside = [False] * n
    inside[container] = True
    link_sums, n_links = page.summed(links), page.summed([int(name == "a") for name in page.name])
    for i in range(container + 1, n):
        inside[i] = inside[page.parent[i]] and not noise[i] and not (page.name[i] in BOXES and n_links[i] > 2 and link_sums[i] >= 0.8 * every[i])
    box = list(range(n))
    for i in range(1, n):
        box[i] = i if page.name[i] in CONTAINERS else box[page.parent[i]]
    blocks: dict[int, list[tuple[int, str, int, bool]]] = {}
    for k, element, text, size, fixed in runs:
        if inside[element]:
            blocks.setdefault(k, []).append((box[element], text, size, fixed or not size))
    varied = {k for k, b in blocks.items() if not all(fixed for *_, fixed in b)}
    # a fixed heading or paragraph in one box with varying ones is the article's, outside article and main elements only between them; a box that is fixed throughout is the site's
    spans: dict[int, tuple[int, int]] = {}
    for k in sorted(varied):
        for at, _, size, fixed in blocks[k]:
            if size and not fixed:
                spans[at] = (spans.get(at, (k, k))[0], k)
    held = lambda k, at: at in spans and (bool(page.main[container]) or spans[at][0] < k < spans[at][1])
    kept = {k for k, b in blocks.items() if k in varied or any(size and held(k, at) for at, _, size, _ in b)} or set(blocks)
    kept -= appended(page, blocks, kept, container, skeleton) if template else set()
    return " ".join(" ".join("".join(text for _, text, *_ in blocks[k]) for k in sorted(kept)).split())


def appended(page: Page, blocks: dict, kept: set[int], container: int, skeleton: list[bool], most_share: float = 0.25, direct_share: float = 0.6) -> set[int]:
    """Blocks in boxes that the host's pages put after an article's own text, as readers' comments and links to other articles.

    The article's text stands in the container itself (``direct_share`` of it at least); a box of the template that begins after the last of it and holds ``most_share`` of it at most is appended.
    """

    def under(at: int) -> int:
        """The outermost box around a block, inside the container."""
        while at and page.parent[at] and box_above[at] != container and at != container:
            at = box_above[at]
        return at

    box_above = [0] * len(page.name)
    near = list(range(len(page.name)))
    for i in range(1, len(page.name)):
        box_above[i] = near[page.parent[i]]
        near[i] = i if page.name[i] in CONTAINERS or i == container else near[page.parent[i]]
    home = near[container]
    size: dict[int, int] = {}
    where: dict[int, list[int]] = {}
    for k in sorted(kept):
        for at, _, chars, _ in blocks[k]:
            top = at if at == home else under(at)
            size[top] = size.get(top, 0) + chars
            if chars:
                where.setdefault(top, []).append(k)
    direct = size.get(home, 0)
    if not direct or direct < direct_share * sum(size.values()):
        return set()
    last = where[home][-1]
    return {k for top, at in where.items() if top != home and at[0] > last and size[top] <= most_share * direct and page.name[top] in ("div", "section") and skeleton[top] for k in at}


def extract(pages: DataFrame, least_size: int = 3, least_share: float = 0.6) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = cut(templates(pages, least_size, least_share))
    n_tokens = found.agg(F.sum(F.size("template"))).first()[0] or 0
    with_template = pages.select("page_id", "url", "html", F.xxhash64(host()).alias("host")).join(small(found, n_tokens, 1_000_000), "host", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[int, frozenset[int]] = {}
        texts = []
        for h, html, template in zip(*(batch.column(i) for i in (2, 3, 4))):
            h, html = h.as_py(), html.as_py()
            if h not in known:
                known[h] = frozenset(template.as_py() or ())
            texts.append(main_text(html, known[h]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(with_template.select("page_id", "url", "host", "html", "template"), run, "page_id long, url string, text string, n_chars long")
