"""Main text of web pages by wrapper inference.

A page becomes a stream of block tags and text, read into groups. Pages of one host are aligned one after another:
where two streams agree, in tags and in text, the pattern stays; a mismatch of tags becomes an optional group, neighbours
that repeat become a repeated group, and a mismatch of text becomes a text slot. The result is a union-free regular
expression per host, its wrapper: sequence, ``?``, ``+``, slots and template text, no alternatives. (A group with over MOST_ITEMS members is kept
as a repetition of optional ones, which any order matches.) Every page takes part: tasks fold their own pages into one
small wrapper per host, and these are folded again, first in SHARES shares of a host and then as a whole, so a host with a
third of all pages is no task of its own.

Text that is the same on nearly all pages of the host, EVIDENCE different ones at least, is its template; what differs is a slot. A page is
read by matching it against its host's wrapper. Its main region is the smallest of the matched groups that holds most of
what the slots put there outside links, or the article, main or content-named elements around or inside that. Where a host
shows no difference (too few pages, or copies) those elements decide, article first. Inside the region, template text other than
headings is left out, and so are groups that are menus, headers, footers, sidebars, notices, adverts, forms or reader
comments by their tag or name. A name counts as a whole, or where each of its parts is a known word (ad-box, but not
search-results). A weak name (related, discussion) is outvoted by text that differs from page to page. Names of elements that
hold prose (p, li, td and the like) count only where they can't mean anything else. An article's own header is part of it.

A task keeps at most MOST_SHAPES shapes of a host's pages apart before it folds them; the order of folding can then
decide which of two equal alignments a wrapper gets.

Defined results: null or empty html, or a page without text in the region, gives an empty text; a null url is a host
of its own; unclosed and truncated markup is read as far as it goes, in time proportional to its length: a tag without an end
is left out with what follows it, and after a quote that swallows all further tags, quotes don't count in that page.
Elements nested deeper than DEEP are read as part of the one around them, unless their tag or name says what they are.
Repeated rows give repeated results, however they are dealt out; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import html as _html
import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.common import materialise

SHARES = 128
#: A group with more members than this is kept as repeated optional ones, so wrappers stay small.
MOST_ITEMS = 64
#: Share of the text in slots that the main region must hold.
REGION_SHARE = 0.6
#: Different pages that must show a text, and the share of the host's pages that must have it, before it counts as the host's template.
EVIDENCE, NEARLY_ALL = 3, 0.9
#: Shapes of a host's pages that a task keeps apart; beyond, it folds them into one.
MOST_SHAPES = 200
DEEP = 200

# HTML elements by their role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("head script style noscript template iframe svg annotation annotation-xml audio video canvas textarea title".split())
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
SCOPES = frozenset("article aside body div footer form header html main nav section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements and names that are not the article; weak names can also name a part of it, so evidence decides there.
DROP_TAGS = frozenset("nav aside footer form menu dialog select button search optgroup".split())
DROP_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar comment comments commentlist respond disqus cookie cookies notice notices gdpr subscribe subscription newsletter signup login widget widgets popup modal overlay toolbar pagination pager hidden teaser outbrain taboola".split())
WEAK_NAMES = frozenset("discussion reply replies related recommended recommendations search share sharing social side foot skip copyright legal disclaimer alert alerts warning consent promotion promotions form".split())
CONTENT_NAMES = frozenset("article post content entry story main maincontent articlebody".split())
# What the names of elements add to those above, as in ad-box or site-header.
HOLDER_NAMES = frozenset("box bar block body bottom button buttons column container desktop group head inner item items left links list main mobile outer page panel posts right row section site slot sticky text title top unit user wrap wrapper zone".split())
# Elements that hold prose, and the names that count for them.
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th caption figcaption".split())
PROSE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo breadcrumb breadcrumbs sidebar comment comments commentlist disqus cookie cookies gdpr newsletter subscribe subscription notice notices hidden outbrain taboola".split())
#: All names that role() asks for; of others so many an attribute are kept, so that long lists don't part what belongs together.
ROLE_NAMES = DROP_NAMES | WEAK_NAMES | CONTENT_NAMES
MOST_NAMES = 4

_name = re.compile(r"[a-zA-Z][a-zA-Z0-9:_-]*")
_stop = re.compile(r"[>\"']")
_attr = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I | re.S)
_digits = re.compile(r"\d+")
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Slot:
    """A text slot: optional or not, its places in a page, the host's characters and link characters there, the text if it is the same wherever it stands (its hash; None: it differs), up to EVIDENCE pages that have it, and how many have it."""

    __slots__ = ("opt", "leaves", "chars", "links", "text", "seen", "pages")
    key = "#"

    def __init__(self, opt=False, leaves=(), chars=0, links=0, text=None, seen=(), pages=1):
        self.opt, self.leaves, self.chars, self.links, self.text, self.seen, self.pages = opt, list(leaves), chars, links, text, tuple(seen), pages

    def template(self, pages: int) -> bool:
        """Whether the host shows this very text on nearly all of its pages."""
        return self.text is not None and len(self.seen) >= EVIDENCE and self.pages >= NEARLY_ALL * pages


class Group:
    """An element: its key, whether optional and repeated, what it holds in order, and (a root's) the pages it was made of."""

    __slots__ = ("key", "opt", "rep", "items", "pages")

    def __init__(self, key, opt=False, rep=False, items=(), pages=1):
        self.key, self.opt, self.rep, self.items, self.pages = key, opt, rep, list(items), pages


@lru_cache(maxsize=100_000)
def _words(name: str) -> frozenset[str]:
    """What a name says: itself in lower case; its parts too if each of them is a known one (ad-box, siteHeader), not if it only contains one (search-results)."""
    parts = frozenset(p.lower() for p in _part.findall(name))
    return frozenset((name.lower(), *(parts if parts <= ROLE_NAMES | HOLDER_NAMES else ())))


def _key(tag: str, attrs: str) -> str:
    """Tag and names of an element, without numbers: of each attribute the first MOST_NAMES, and all that say what the element is."""
    if not attrs or ("=" not in attrs and "hidden" not in attrs):
        return tag
    names = []
    for m in _attr.finditer(attrs):
        kind = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            names.append("hidden")
        elif kind != "aria-hidden":
            own = _digits.sub("0", value).split()
            names += own[:MOST_NAMES] + [x for x in own[MOST_NAMES:] if _words(x) & ROLE_NAMES]
    return f"{tag}.{'.'.join(sorted(set(names)))}" if names else tag


def _markup(page: str):
    """(text before, closing, tag, attributes) for each tag of a page, and last the text after all; comments, declarations and the content of RAW elements are passed over. One pass."""
    at, n, begin, strict = 0, len(page), 0, True
    text: list[str] = []
    while (lt := page.find("<", at)) >= 0:
        m = _name.match(page, lt + 2 if page.startswith("/", lt + 1) else lt + 1)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
            elif page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt) - 2
                end = n if end < 0 else end
            else:  # no markup
                at = lt + 1
                continue
            text.append(page[begin:lt])
            begin = at = n if end < 0 else min(n, end + 3)
            continue
        end = _tag_end(page, m.end(), strict)
        if end < 0 and strict:
            strict = False
            end = _tag_end(page, m.end(), False)
        text.append(page[begin:lt])
        if end < 0:
            begin = at = n
            break
        closing, tag, attrs = page[lt + 1] == "/", m[0].lower(), page[m.end() : end]
        begin = at = end + 1
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                begin = at = _raw_end(page, at, tag)
            continue
        yield "".join(text), closing, tag, attrs
        text.clear()
    text.append(page[begin:])
    yield "".join(text), False, None, ""


def _tag_end(page: str, at: int, quotes: bool) -> int:
    """Where the > of a tag is, -1 if it has none; a quote that is never closed is a character like others."""
    while quotes and (m := _stop.search(page, at)):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        at = m.end() if close < 0 else close + 1
    return -1 if quotes else page.find(">", at)


@lru_cache(maxsize=64)
def _raw_close(tag: str):
    return re.compile(rf"</{tag}\s*>|<body\b" if tag == "head" else rf"</{tag}\s*>", re.I)


def _raw_end(page: str, at: int, tag: str) -> int:
    m = _raw_close(tag).search(page, at)
    return len(page) if m is None else m.start() if m[0].lower().startswith("<body") else m.end()


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


class _Open:
    """The elements that are open, with where each tag and the scopes stand, so that nothing is searched twice."""

    def __init__(self, root: Group):
        self.stack: list[tuple[str, Group, str]] = [("", root, "")]
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.roles: set[str] = set()  # of the groups below DEEP that are open

    def push(self, tag: str, group: Group, kind: str) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, group, kind))
        self.roles.add(kind)

    def pop(self) -> None:
        tag, _, kind = self.stack.pop()
        self.at[tag].pop()
        if tag in SCOPES:
            self.scopes.pop()
        if kind:
            self.roles.discard(kind)

    def close(self, tag: str) -> None:
        """Close the last element of that tag and what is open inside it; one outside the last scope can only be closed by a scope's own tag."""
        where = self.at.get(tag)
        if where and (tag in SCOPES or not self.scopes or where[-1] > self.scopes[-1]):
            last = where[-1]
            while len(self.stack) > last:
                self.pop()

    def open(self, tag: str, key: str) -> None:
        inner, kind = self.stack[-1][1], ""
        if len(self.stack) < DEEP:
            inner.items.append(group := Group(key))
        elif (said := role(key)) != "plain" and said not in self.roles:
            kind = said
            inner.items.append(group := Group(key))
        else:
            group = inner
        if tag not in VOID:
            self.push(tag, group, kind)


def tokenised(page: str) -> tuple[Group, list[tuple[str, int]]]:
    """The page's groups, not yet folded, and its texts in order: each with its link characters."""
    root = Group("root")
    now = _Open(root)
    leaves: list[tuple[str, int]] = []
    buf: list[str] = []
    link = link_chars = 0

    def flush():
        nonlocal link_chars
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                now.stack[-1][1].items.append(Slot(leaves=[len(leaves)], chars=len(text), links=min(link_chars, len(text)), text=_hash(text)))
                leaves.append((text, link_chars))
            buf.clear()
        link_chars = 0

    for text, closing, tag, attrs in _markup(page):
        if text:
            text = _html.unescape(text)
            buf.append(text)
            if link:
                link_chars += len(text.strip())
        if tag is None:
            break
        if tag not in BLOCKS:
            if tag == "a":
                link = 0 if closing else 1
            elif tag == "br":
                buf.append(" ")
            continue
        flush()
        if tag in ("html", "body"):
            continue
        if closing:
            now.close(tag)
            continue
        while len(now.stack) > 1 and tag in CLOSED_BY.get(now.stack[-1][0], ()):
            now.pop()
        now.open(tag, _key(tag, attrs))
    flush()
    mark = (_hash("\n".join(t for t, _ in leaves)),)
    for x in slots(root):
        x.seen = mark
    return root, leaves


def _joined(a, b, across: bool = True):
    """One item from two with the same key, of different pages (across) or of one: then its text is both, one after the other."""
    if a.key == "#":
        text = a.text if a.text == b.text else None
        if not across and a.text is not None and b.text is not None:
            text = _hash(f"{a.text} {b.text}")
        return Slot(a.opt or b.opt, a.leaves + b.leaves, a.chars + b.chars, a.links + b.links, text, sorted({*a.seen, *b.seen})[:EVIDENCE], a.pages + b.pages if across else max(a.pages, b.pages))
    return Group(a.key, a.opt or b.opt, a.rep or b.rep, aligned(a.items, b.items, across))


def _optional(x):
    x.opt = True
    return x


def aligned(a: list, b: list, across: bool = True) -> list:
    """One sequence that both match: common items in order, all others optional."""
    ka, kb = [x.key for x in a], [x.key for x in b]
    if ka == kb:
        return [_joined(x, y, across) for x, y in zip(a, b)]
    if len(a) > MOST_ITEMS or len(b) > MOST_ITEMS:
        found: dict = {}
        for x in [*a, *b]:
            found[x.key] = _joined(found[x.key], x, across) if x.key in found else x
            found[x.key].opt = True
            if x.key != "#":
                found[x.key].rep = True
        return list(found.values())
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, low = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = low[j + 1] + 1 if ka[i] == kb[j] else max(low[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if ka[i] == kb[j]:
            out.append(_joined(a[i], b[j], across))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    out += [_optional(x) for x in [*a[i:], *b[j:]]]
    return _repeats(out, across)


def _repeats(items: list, across: bool = False) -> list:
    """Neighbours that repeat, alone or in runs of two or three, become one repeated group each."""
    out = items
    for k in (1, 2, 3):
        if len(out) < 2 * k:
            break
        done: list = []
        i = 0
        while i < len(out):
            unit = out[i : i + k]
            keys = [x.key for x in unit]
            j = i + k
            if len(unit) == k and not (k > 1 and len(set(keys)) == 1):
                while [x.key for x in out[j : j + k]] == keys:
                    unit = [_joined(x, y, across) for x, y in zip(unit, out[j : j + k])]
                    j += k
            if j > i + k:
                if k == 1:
                    if unit[0].key != "#":
                        unit[0].rep = True
                    done += unit
                else:
                    done.append(Group("(" + " ".join(keys) + ")", rep=True, items=unit))
                i = j
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def folded(x):
    """A page's groups with repeated neighbours folded, from the inside out."""
    if x.key != "#":
        for y in x.items:
            folded(y)
        x.items = _repeats(x.items)
    return x


def skeleton(x) -> str:
    mark = "?" if x.opt else ""
    if x.key == "#":
        return "#" + mark
    return f"<{x.key}{'+' if x.rep else ''}{mark}{''.join(map(skeleton, x.items))}>"


def _weak(x):
    """Whether each group with a weak name is left out, as far as the page itself tells."""
    if x.key != "#":
        if role(x.key) == "weak":
            yield left_out(x)
        for y in x.items:
            yield from _weak(y)


def slots(x):
    """The slots below x in order."""
    if x.key == "#":
        yield x
    else:
        for y in x.items:
            yield from slots(y)


def dumped(x):
    if x.key == "#":
        return [int(x.opt), x.chars, x.links, x.text, x.pages, *x.seen]
    return [x.key, 2 * x.rep + x.opt, [dumped(y) for y in x.items], *([x.pages] if x.key == "root" else [])]


def loaded(v):
    if isinstance(v[0], int):
        return Slot(bool(v[0]), (), v[1], v[2], v[3], v[5:], v[4])
    return Group(v[0], bool(v[1] & 1), bool(v[1] & 2), map(loaded, v[2]), *v[3:])


@lru_cache(maxsize=100_000)
def role(key: str) -> str:
    """drop, weak, header, article, main, named or plain: what a group's tag and names say."""
    tag, _, names = key.partition(".")
    words = {w for name in names.split(".") for w in _words(name)}
    if tag in DROP_TAGS or "hidden" in words:
        return "drop"
    if tag == "article" and not words & {"comment", "comments", "reply", "teaser", "related"}:
        return "article"
    if tag == "main" or "articlebody" in words:
        return "main"
    if words & (PROSE_NAMES if tag in PROSE_TAGS else DROP_NAMES):
        return "drop"
    if tag == "header":
        return "header"
    if tag not in PROSE_TAGS and words & WEAK_NAMES:
        return "weak"
    return "named" if words & CONTENT_NAMES else "plain"


def left_out(x) -> bool:
    """Whether a group isn't main text. A weak name is outvoted by what the group's slots hold: text outside links that differs from page to page; in a section any text that isn't mostly links."""
    r = role(x.key)
    if r != "weak":
        return r == "drop"
    held = list(slots(x))
    chars, links = sum(s.chars for s in held), sum(s.links for s in held)
    return 2 * links >= chars or not (x.key.partition(".")[0] == "section" or any(s.text is None and s.chars > s.links for s in held))


def _varying(x) -> int:
    """Characters of text that differs from page to page, outside links and left-out groups."""
    if x.key == "#":
        return 0 if x.text is not None else max(0, x.chars - x.links)
    return 0 if role(x.key) == "header" or left_out(x) else sum(map(_varying, x.items))


def _plain(x) -> int:
    """Characters outside links and left-out groups."""
    if x.key == "#":
        return max(0, x.chars - x.links)
    return 0 if role(x.key) == "header" or left_out(x) else sum(map(_plain, x.items))


def _flat(items) -> list:
    """The items with runs of repeated groups opened."""
    return [y for x in items for y in (_flat(x.items) if x.key[0] == "(" else (x,))]


def region(wrapper: Group, seen: set[int], alone: list[Group]) -> list[Group]:
    """The groups that are a page's main text. seen: the ids of the wrapper's groups that the page matched; alone: the page's groups that matched none."""
    found: dict[str, list[Group]] = {"article": [], "main": [], "named": []}
    above: dict[int, tuple] = {}  # the groups around each one that the page matched
    own_ids: set[int] = set()

    def walk(x, around, own):
        if x.key == "#" or not (own or id(x) in seen):
            return
        r = role(x.key)
        if r == "header" or left_out(x):
            return
        above[id(x)] = around
        if own:
            own_ids.add(id(x))
        if r in found and all(role(y.key) != r for y in around):
            found[r].append(x)
        for y in _flat(x.items):
            walk(y, (*around, x), own)

    walk(wrapper, (), False)
    for x in alone:
        walk(x, (wrapper,), True)
    measure = _varying if _varying(wrapper) else _plain

    def met(x) -> int:
        """What the measure gives for the parts of x that the page matched; groups of the page's own count as plain text."""
        if x.key == "#":
            return measure(x)
        return 0 if id(x) not in above else _plain(x) if id(x) in own_ids else sum(map(met, _flat(x.items)))

    at, whole = wrapper, met(wrapper) + sum(map(met, alone))
    while whole:
        inner = [y for y in [*_flat(at.items), *(alone if at is wrapper else ())] if id(y) in above and any(z.key != "#" for z in y.items) and met(y) >= REGION_SHARE * whole]
        if not inner:
            break
        at = max(inner, key=met)
    if measure is _varying and whole:
        # what says what it is decides among the groups around and inside the one that the evidence picks
        near = {id(at), *map(id, above[id(at)])} if at is not wrapper else set()
        inside = lambda x: any(y is at for y in above[id(x)])
        for kind in ("article", "main", "named"):
            if at is wrapper:
                hit = [x for x in found[kind] if 2 * met(x) >= REGION_SHARE * whole]
            else:
                hit = [x for x in found[kind] if id(x) in near or inside(x)]
            if hit and kind == "article":
                return found[kind]
            if hit:
                return [max(hit, key=met)]
        if at is wrapper and found["article"] and sum(map(met, found["article"])) >= REGION_SHARE * whole:
            return found["article"]
        return [at]
    if found["article"]:
        return found["article"]
    for kind in ("main", "named"):
        if found[kind]:
            return [max(found[kind], key=_plain)]
    return [at]


def _pairs(w_items, p_items):
    """Each of a page's items in order, and the wrapper's item that it matches or None."""
    at, w_items = 0, _flat(w_items)
    for p in _flat(p_items):
        w = None
        for k in range(at, len(w_items)):
            if w_items[k].key == p.key:
                w, at = w_items[k], k + 1
                break
        else:
            w = next((x for x in w_items if x.key == p.key), None)
        yield w, p


def slot_flags(wrapper: Group, page: Group) -> list[bool]:
    """For each slot of a folded page whether it is main text, by matching the page against the wrapper."""
    seen, alone = {id(wrapper)}, []

    def meet(w_items, p_items):
        for w, p in _pairs(w_items, p_items):
            if p.key == "#" or role(p.key) == "header" or left_out(p if w is None else w):
                continue
            if w is None:
                alone.append(p)
            else:
                seen.add(id(w))
                meet(w.items, p.items)

    meet(wrapper.items, page.items)
    kept = {id(x) for x in region(wrapper, seen, alone)}
    flags: list[bool] = []

    def match(w_items, p_items, inside, heading_only, in_article, in_heading=False):
        for w, p in _pairs(w_items, p_items):
            if p.key == "#":
                flags.append(inside and not heading_only and not (w is not None and w.template(wrapper.pages) and not in_heading))
                continue
            r, heading = role(p.key), p.key.partition(".")[0] in HEADINGS
            now = (inside or id(w or p) in kept) and not (inside and left_out(w or p))
            article = in_article or (now and r == "article")
            # an article's own header is part of it; of any other only the headings are
            only = (heading_only or (r == "header" and now and not article)) and not heading
            if now or not inside:
                match(w.items if w else p.items, p.items, now, only, article, in_heading or heading)
            else:
                flags.extend(False for _ in slots(p))

    match(wrapper.items, page.items, id(wrapper) in kept, False, False)
    return flags


@lru_cache(maxsize=512)
def _wrapper(text: str) -> Group:
    return loaded(json.loads(text))


def main_text(page: str | None, wrapper: str | None, seen: dict) -> str:
    """Main text of a page. seen: keeps what matching found for a wrapper and a skeleton."""
    if not page:
        return ""
    root, leaves = tokenised(page)
    folded(root)
    known = (wrapper, skeleton(root), tuple(_weak(root)))
    if known not in seen:
        if len(seen) > 20_000:
            seen.clear()
        seen[known] = slot_flags(_wrapper(wrapper) if wrapper else root, root)
    at = sorted(i for s, yes in zip(slots(root), seen[known]) if yes for i in s.leaves)
    return "\n".join(leaves[i][0] for i in at)


def _fold_pages(batches):
    """One wrapper per host from a task's pages."""
    import pyarrow as pa

    hosts: dict = {}
    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not page:
                continue
            root = folded(tokenised(page)[0])
            own, name = hosts.setdefault(host, {}), skeleton(root)
            if name in own:  # the same shape: only its masses are added
                for s, t in zip(slots(own[name]), slots(root)):
                    s.chars, s.links, s.pages = s.chars + t.chars, s.links + t.links, s.pages + t.pages
                    s.text, s.seen = s.text if s.text == t.text else None, tuple(sorted({*s.seen, *t.seen})[:EVIDENCE])
                own[name].pages += 1
            else:
                own[name] = root
                if len(own) > MOST_SHAPES:
                    hosts[host] = {"": _fold_all(own.values())}
    out = [(h, json.dumps(dumped(_fold_all(own.values())))) for h, own in hosts.items()]
    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.string()), pa.array([w for _, w in out], pa.string())], names=["host", "wrapper"])


def _fold_all(wrappers) -> Group:
    it = iter(wrappers)
    out = next(it)
    for w in it:
        out = Group("root", items=aligned(out.items, w.items), pages=out.pages + w.pages)
    return out


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper: a wrapper for each host of pages (host, html)."""
    import pandas as pd

    def fold(key, pdf):
        text = json.dumps(dumped(_fold_all(loaded(json.loads(w)) for w in sorted(pdf["wrapper"]))))
        return pd.DataFrame({"host": [key[0]], "share": [0], "wrapper": [text]})

    own = pages.select("host", "html").mapInArrow(_fold_pages, "host string, wrapper string")
    own = own.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    for keys in (("host", "share"), ("host",)):
        own = own.groupBy(*keys).applyInPandas(fold, "host string, share int, wrapper string")
    return own.select("host", "wrapper")


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    found = materialise(infer(rows), "wrappers")  # its size is known from here on, and decides how it is joined
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        seen: dict = {}
        for b in batches:
            texts = [main_text(p, w, seen) for p, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
