"""Main-text extraction with wrappers inferred from the pages of a host.

A page is a stream of tokens: element opens, element closes, and runs of text.
The wrapper of a host is a union-free regular expression over such streams,
inferred by aligning its pages one after another. The first page is the
expression; each further stream is aligned with it element by element. Where the
two agree, tokens stand for each other by their place. Where they differ, the
mismatch is resolved: siblings that recur become a repeated group, what still has
no counterpart becomes optional, and text that differs becomes a slot. The runs
of text that stay the same on nearly all pages of a host are template.

An expression depends on the structure of pages only, so equal structures are
aligned once. Different ones are aligned in sorted order, a host's in salted
parts first and the parts' expressions then; a task holds one expression at a
time. A second pass matches each page to its host's expression and counts the
text of each slot. The group with most slot text in its own paragraphs is the
article's; what the template holds word for word in it is left out.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run of text is template if it stands on this share of the host's different pages, and on this many.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 4
#: Wrappers of all hosts up to this many bytes go to every task.
SENT_BYTES = 64 << 20
# Elements of HTML by what they mean for text.
BLOCKS = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset hgroup center nav header footer aside form menu dialog template noscript head title iframe svg button select textarea object canvas video audio search label legend datalist".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROPPED = set("head title script style noscript template iframe svg object canvas video audio nav footer aside form menu dialog button select textarea search label legend datalist".split())
#: Where one run of text stands for itself: template words between a host's slots are the article's in these, and noise elsewhere.
ITEMS = set("h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A form that holds this share of a page's text is no form but what the page is built in.
FORM_SHARE = 0.5
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure li dt dd td th tr tbody thead figcaption caption".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist".split())
# Names that pages give to parts beside the article. A name counts if all its words are among them.
BESIDE = set("ad ads adbox adslot adunit advert adverts advertisement advertisements nav navbar navigation menu footer sidebar banner comments comment commentlist commentform reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations promo sponsored sponsor sponsors breadcrumb breadcrumbs pagination pager toolbar widget widgets skip search masthead topbar site page section list box bar block area wrapper container content form links items left right top bottom main".split())
PLAIN = set("site page section list box bar block area wrapper container content form links items left right top bottom main".split())
CLOSES_P = BLOCKS - {"html", "body", "button", "object", "select", "textarea"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
OPEN, CLOSE, TEXT = 0, 1, 2
#: Siblings that recur in groups of up to this many elements are found as repeated groups.
PERIOD = 4
#: Children of one element beyond this many are one repeated group, so that an expression does not grow with its pages.
LONG = 64
#: Parts in which a host's structures are aligned before the parts are.
SALTS = 256
#: How much an element's tag adds to the weight of its slot text.
FAVOUR = {"article": 4.0, "main": 2.0}
# What a worker has worked out before: labels by tag and attributes, and expressions by their text.
_LABELS: dict[tuple[str, str], tuple[str, bool]] = {}
_READ: dict[str, "Group"] = {}


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's label (tag and first class, digits as 0) and whether its tag, role or name sets it beside the article."""
    known = _LABELS.get((tag, attributes))
    if known is None:
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        names = [*found.get("class", "").split(), found.get("id", "")]
        label = tag + "".join("." + re.sub(r"\d+", "0", n) for n in names[:-1][:1])
        beside = tag in DROPPED or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        beside = beside or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
        if tag in ("html", "body", "main", "article"):
            beside = False
        elif tag not in FLOW or tag in ("ul", "ol", "dl", "table"):
            for n in names:
                words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", n).lower()) if w}
                beside = beside or bool(words) and words <= BESIDE and bool(words - PLAIN)
        if len(_LABELS) > 100_000:
            _LABELS.clear()
        known = _LABELS[tag, attributes] = (label, beside)
    return known


def tree(page: str) -> list[tuple]:
    """The page's stream: (OPEN, label, beside, tag), (CLOSE,) and (TEXT, text). Inline markup, scripts, styles and comments are left out; every open has its close.

    One pass from left to right: whatever is searched for ahead is either found, and all up to it is done with, or known to be absent from here on.
    """
    out, stack, at, n, loose, opened = [], [], 0, len(page), False, Counter()
    last = {c: page.rfind(c) for c in "<>\"'"}
    gone: set[str] = set()

    def ahead(what: str, start: int) -> int:
        if what in gone:
            return -1
        found = page.find(what, start)
        if found < 0:
            gone.add(what)
        return found

    while at < n:
        mark = page.find("<", at) if at <= last["<"] else -1
        if mark < 0:
            out.append((TEXT, page[at:]))
            break
        if mark > at:
            out.append((TEXT, page[at:mark]))
        at = mark
        if page.startswith("<!--", at):
            end = ahead("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(page, at)
        if not name:
            if page[at + 1 : at + 2] in ("!", "?", "/") and at < last[">"]:
                at = page.find(">", at) + 1
            else:
                out.append((TEXT, "<"))
                at += 1
            continue
        # the tag's end: the first > outside of quotes; a quote that never closes is a character like any other
        end = name.end()
        while True:
            if end > last[">"]:
                end = -1
                break
            end = _STOP.search(page, end).start()
            c = page[end]
            if c == ">":
                break
            if loose:
                end += 1
                continue
            end = page.find(c, end + 1) + 1 if end < last[c] else end + 1
        if end < 0:
            # all > from here on stand in quotes: tags end at the next one whatever the quotes say
            loose = True
            out.append((TEXT, "<"))
            at += 1
            continue
        closing, tag, attributes = name[1], name[2].lower(), page[name.end() : end]
        at = end + 1
        if tag in RAW and not closing:
            if tag not in gone:
                shut = re.compile(rf"</{tag}(?![\w:-])[^>]*+>?", re.I).search(page, at)
                at = shut.end() if shut else n
                if not shut:
                    gone.add(tag)
            else:
                at = n
            out.append((TEXT, " "))
            continue
        if tag in ("br", "hr"):
            out.append((TEXT, " "))
        if tag in _VOID or tag not in BLOCKS:
            continue
        if closing:
            while opened[tag]:
                top = stack.pop()
                opened[top] -= 1
                out.append((CLOSE,))
                if top == tag:
                    break
            continue
        ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        while stack and stack[-1] in ends:
            opened[stack.pop()] -= 1
            out.append((CLOSE,))
        out.append((OPEN, *_label(tag, attributes), tag))
        if attributes.endswith("/"):
            out.append((CLOSE,))
        else:
            stack.append(tag)
            opened[tag] += 1
    out.extend([(CLOSE,)] * len(stack))
    return _forms_opened(out)


def _forms_opened(stream: list[tuple]) -> list[tuple]:
    """The stream in which forms that hold most of the page's text count as any container."""
    forms = [i for i, token in enumerate(stream) if token[0] == OPEN and token[3] == "form"]
    if not forms:
        return stream
    # characters of text up to each token, of what no other dropped element holds
    total, held, shut, spans = 0, [], 0, {}
    for i, token in enumerate(stream):
        if token[0] == OPEN:
            shut += token[2] and token[3] != "form"
            held.append((i, total))
        elif token[0] == CLOSE:
            at, before = held.pop()
            shut -= stream[at][2] and stream[at][3] != "form"
            if stream[at][3] == "form":
                spans[at] = total - before
        elif not shut:
            total += len(token[1].strip())
    for at, n in spans.items():
        if n >= FORM_SHARE * total and n:
            stream[at] = (OPEN, stream[at][1], False, "form")
    return stream


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Group:
    """An element of an expression: what it holds in order, whether it may be absent, whether it has text of its own. A `loop` is a repeated group of its children, each of another label and each optional in a turn."""

    __slots__ = ("label", "tag", "beside", "optional", "slot", "loop", "kids", "id")

    def __init__(self, label: str, tag: str, beside: bool = False, optional: bool = False, slot: bool = False, loop: bool = False):
        self.label, self.tag, self.beside, self.optional, self.slot, self.loop, self.kids, self.id = label, tag, beside, optional, slot, loop, [], 0

    def __eq__(self, other):
        return isinstance(other, Group) and written(self) == written(other)

    __hash__ = None


def written(root: Group) -> str:
    """The expression as lines, one for each open (flags, tag, label) and each close; `read` takes it back."""
    out, work = [], [root]
    while work:
        x = work.pop()
        if x is None:
            out.append("/")
            continue
        out.append(f"{x.beside + 2 * x.optional + 4 * x.slot + 8 * x.loop:x} {x.tag} {x.label}")
        work.append(None)
        work.extend(reversed(x.kids))
    return "\n".join(out)


def read(text: str) -> Group:
    """The expression that `written` gave; groups carry their place in it as id."""
    root, stack = None, []
    for n, line in enumerate(text.split("\n")):
        if line == "/":
            stack.pop()
            continue
        flags, tag, label = line.split(" ", 2)
        flags = int(flags, 16)
        x = Group(label, tag, bool(flags & 1), bool(flags & 2), bool(flags & 4), bool(flags & 8))
        x.id = n
        if stack:
            stack[-1].kids.append(x)
        else:
            root = x
        stack.append(x)
    return root


def _remembered(text: str) -> Group:
    known = _READ.get(text)
    if known is None:
        if len(_READ) > 256:
            _READ.clear()
        known = _READ[text] = read(text)
    return known


def folded(stream: list[tuple]) -> Group:
    """A page's stream as an expression: paragraphs, items and the like that recur below one element are a repeated group, all else stands by its place."""
    root = Group("#root", "#root")
    stack = [root]
    for token in stream:
        if token[0] == OPEN:
            x = Group(token[1], token[3], token[2])
            stack[-1].kids.append(x)
            stack.append(x)
        elif token[0] == CLOSE:
            stack.pop()
        elif token[1].strip():
            stack[-1].slot = True
    return _settled(deque([(root, None)]))


def aligned(a: Group, b: Group) -> Group:
    """The expression over the streams of both."""
    root = read(written(a))
    _settled(deque([(root, read(written(b)))]))
    return root


def _settled(work: deque) -> Group:
    """Work off pairs from the top down: (a, b) takes b into a, (a, None) folds what recurs below a."""
    first = work[0][0]
    while work:
        a, b = work.popleft()
        if b is None:
            a.kids = _recurring(a.kids, work)
            work.extend((k, None) for x in a.kids for k in (x.kids if x.loop else (x,)))
        else:
            a.beside, a.slot, a.optional = a.beside and b.beside, a.slot or b.slot, a.optional or b.optional
            _merged(a, b, work)
    return first


def _members(x: Group) -> list[Group]:
    return x.kids if x.loop else [x]


def _labels(x: Group) -> list[str]:
    return [k.label for k in _members(x)]


def _taken(loop: Group, x: Group, work: deque) -> None:
    """Take an element, or the members of another repeated group, into a repeated group."""
    loop.optional = loop.optional and x.optional
    known = {k.label: k for k in loop.kids}
    for k in _members(x):
        k.optional = False
        if k.label in known:
            work.append((known[k.label], k))
        else:
            loop.kids.append(k)
            known[k.label] = k


def _loop(items: list[Group], work: deque) -> Group:
    out = Group("#loop", "#loop", loop=True, optional=True)
    for x in items:
        _taken(out, x, work)
    return out


def _recurring(items: list[Group], work: deque, kinds=FLOW) -> list[Group]:
    """Within each stretch of elements of these kinds (None: any) what stands from a label's first place to its last is one repeated group."""
    out, i = [], 0
    while i < len(items):
        j = i
        while j < len(items) and (kinds is None or all(k.tag in kinds for k in _members(items[j]))):
            j += 1
        last = {label: n for n in range(i, j) for label in _labels(items[n])}
        at = i
        while at < j:
            end, n = at, at
            while n <= end:
                end = max([end, *(last[label] for label in _labels(items[n]))])
                n += 1
            out.append(items[at] if end == at else _loop(items[at : end + 1], work))
            at = end + 1
        if j < len(items):
            out.append(items[j])
            j += 1
        i = j
    return out


def _tandem(items: list[Group], work: deque) -> list[Group]:
    """Groups of up to PERIOD elements that follow themselves are repeated groups, and take neighbours that are in them."""
    out: list[Group] = []
    for x in items:
        out.append(x)
        again = True
        while again:
            again = False
            if len(out) > 1 and (out[-1].loop or out[-2].loop) and set(_labels(out[-1])) & set(_labels(out[-2])):
                out[-2:] = [_loop(out[-2:], work)]
                again = True
                continue
            for p in range(1, min(PERIOD, len(out) // 2) + 1):
                if [_labels(y) for y in out[-p:]] == [_labels(y) for y in out[-2 * p : -p]]:
                    out[-2 * p :] = [_loop(out[-2 * p :], work)]
                    again = True
                    break
    return out


def placed(items: list[Group], kids: list[list[str]]) -> list[tuple[int, int]]:
    """For children, given as the labels each may have: (item that it aligns with or -1, item that it stands before).

    At a mismatch either the items up to the child's are skipped, or the child is, whichever skips less.
    """
    where: dict[str, list[int]] = {}
    for n, x in enumerate(items):
        for label in _labels(x):
            where.setdefault(label, []).append(n)
    later: dict[str, list[int]] = {}
    for n, labels in enumerate(kids):
        for label in labels:
            later.setdefault(label, []).append(n)

    def next_of(places: dict[str, list[int]], labels: list[str], start: int) -> int:
        """The distance from `start` to the next place of one of the labels, or -1."""
        best = -1
        for label in labels:
            of = places.get(label, ())
            n = bisect_left(of, start)
            if n < len(of) and (best < 0 or of[n] - start < best):
                best = of[n] - start
        return best

    out, i = [], 0
    for j, labels in enumerate(kids):
        skip = next_of(where, labels, i)
        if skip > 0:
            wait = next_of(later, _labels(items[i]), j)
            if 0 <= wait < skip:
                skip = -1
        if skip < 0:
            # what comes after a repeated group's turns stands behind it
            i += bool(out) and out[-1][0] == i
            out.append((-1, i))
            continue
        i += skip
        out.append((i, i))
        i += not items[i].loop and len(labels) == 1
    return out


def _merged(a: Group, b: Group, work: deque) -> None:
    """b's children into a's."""
    left, right = a.kids, b.kids
    if [_labels(x) for x in left] != [_labels(x) for x in right] or [x.loop for x in left] != [x.loop for x in right]:
        left, right = _tandem(left, work), _tandem(right, work)
    places = placed(left, [_labels(x) for x in right])
    seen = {n for n, _ in places}
    for n, x in enumerate(left):
        x.optional = x.optional or n not in seen
    before: dict[int, list[Group]] = {}
    for x, (n, i) in zip(right, places):
        if n < 0:
            x.optional = True
            before.setdefault(i, []).append(x)
        elif left[n].loop or x.loop:
            absent = left[n].optional or x.optional
            if left[n].loop:
                _taken(left[n], x, work)
            else:
                left[n] = _loop([left[n], x], work)
            left[n].optional = absent
        else:
            work.append((left[n], x))
    if before:
        left = [y for n in range(len(left) + 1) for y in (*before.get(n, ()), *left[n : n + 1])]
        left = _recurring(left, work)
        if len(left) > LONG:
            left = _recurring(left, work, None)
    a.kids = left


def expression(root: Group) -> str:
    """The wrapper as text: (#) is a slot, ? optional, + repeated; of a repeated group of several each may be absent in a turn."""
    out, work = [], [root]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.loop:
            one = len(x.kids) == 1
            out.append("" if one else "(")
            work.append(("+" if one else ")+") + "?" * x.optional)
            for k in reversed(x.kids):
                work.extend([k] if one else ["?", k])
        else:
            out.append(f"<{x.label}>{'(#)' if x.slot else ''}")
            work.append("</>" + "?" * x.optional)
            work.extend(reversed(x.kids))
    return "".join(out)


def article(root: Group, chars: dict[int, int]) -> tuple[int, int]:
    """The article's group and its parent, by id: the one whose own and paragraphs' slots hold most text (chars, by id), FAVOUR for its tag. Ties go to the smaller label and the later group."""
    order, work = [], [(root, -1, False)]
    while work:
        x, parent, beside = work.pop()
        beside = beside or x.beside
        below = [k for y in x.kids for k in _members(y)]
        order.append((x, parent, beside, below))
        work.extend((k, x.id, beside) for k in below)
    total: dict[int, int] = {}
    best = ((-1.0, "", 0), root.id, -1)
    for x, parent, beside, below in reversed(order):
        own = 0 if beside else chars.get(x.id, 0)
        total[x.id] = own + sum(total[k.id] for k in below)
        if beside or x.tag in FLOW:
            continue
        own += sum(total[k.id] for k in below if k.tag in FLOW)
        weight = FAVOUR[x.tag] * total[x.id] if x.tag in FAVOUR else float(own)
        best = max(best, ((weight, x.label, x.id), x.id, parent))
    return best[1], best[2]


def matched(root: Group, stream: list[tuple]) -> dict[int, int]:
    """Where elements open in a stream (-1: the page): the id of the group that each stands for; those that the expression does not have are absent."""
    kids: dict[int, list[int]] = {-1: []}
    stack = [-1]
    for i, token in enumerate(stream):
        if token[0] == OPEN:
            kids[stack[-1]].append(i)
            kids[i] = []
            stack.append(i)
        elif token[0] == CLOSE:
            stack.pop()
    out, work = {-1: root.id}, [(root, -1)]
    while work:
        x, at = work.pop()
        if not kids[at]:
            continue
        below = [{k.label: k for k in _members(y)} for y in x.kids]
        for i, (n, _) in zip(kids[at], placed(x.kids, [[stream[i][1]] for i in kids[at]])):
            if n >= 0:
                y = below[n][stream[i][1]]
                out[i] = y.id
                work.append((y, i))
    return out


def runs(stream: list[tuple]):
    """(where its element opens, text) of each run of text between tokens, references decoded and white space as one blank."""
    stack, text = [-1], []
    for i, token in enumerate([*stream, (OPEN,)]):
        if token[0] == TEXT:
            text.append(token[1])
            continue
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            text = []
            if block:
                yield stack[-1], i, block
        if token[0] == OPEN:
            stack.append(i)
        else:
            stack.pop()


def main_text(page: str | None, wrapper: Group | None = None, region: tuple[int, int] = (0, -1), template: frozenset = frozenset()) -> str:
    """The article's blocks of one page, by its host's wrapper and region (group, parent) where the page has it, else by its own expression. template: (group, run) hashes that are the host's, not the page's."""
    if not page:
        return ""
    stream = tree(page)
    of = matched(wrapper, stream) if wrapper is not None else {}
    if region[0] not in of.values():
        wrapper = read(written(folded(stream)))
        of, chars, template = matched(wrapper, stream), Counter(), frozenset()
        for at, _, block in runs(stream):
            chars[of.get(at, -1)] += len(block)
        region = article(wrapper, chars)
    group, parent = region
    tags = {n: stream[i][3] for i, n in of.items() if i >= 0}
    kind = tags.get(group, "")
    inside, rest, titled = [], [], _titled(stream)
    # (where it opens, beside, within the region, left out as a header, tag)
    stack = {-1: (False, group == of[-1], False, "")}
    opened = [-1]
    texts = {end: (at, block) for at, end, block in runs(stream)}
    for i, token in enumerate([*stream, (CLOSE,)]):
        if i in texts:
            at, block = texts[i]
            beside, within, header, tag = stack[at]
            if not beside and not header:
                rest.append(block)
                if within:
                    # an element that the wrapper lacks counts with the nearest one around it that it has
                    inside.append((block, of.get(at, -1 - at), tag, bool(template) and _mixed(of.get(at, -1), block) in template))
        if token[0] == OPEN:
            beside, within, header, _ = stack[opened[-1]]
            # articles beside the region's are the page's too, whatever they are called, unless their names say otherwise
            here = within or of.get(i) == group or kind == token[3] == "article" and of.get(opened[-1]) == parent and not _named_beside(token[1])
            # a header that titles the article is part of it, and so is what an article itself calls one; elsewhere it is the site's
            called = "header" in token[1] and token[3] not in FLOW and bool(re.search(r"\bheader\b", token[1]))
            is_header = called and not (within and (i in titled or kind in ("article", "main") and token[3] != "header"))
            stack[i] = (beside or token[2], here, header or is_header, token[3])
            opened.append(i)
        elif token[0] == CLOSE:
            opened.pop()
    return "\n\n".join([block for block, *_ in _without_template(inside)] or rest)


def _without_template(blocks: list[tuple]) -> list[tuple]:
    """Blocks (text, chain, tag, template) without the host's own: of template runs only headings and items stay, between two slots or in a group that has slots on this page."""
    slots = [i for i, b in enumerate(blocks) if not b[3]]
    if len(slots) == len(blocks) or not slots:
        return [blocks[i] for i in slots]
    groups = {blocks[i][1] for i in slots}
    return [b for i, b in enumerate(blocks) if not b[3] or b[2] in ITEMS and (slots[0] < i < slots[-1] or b[1] in groups)]


def _named_beside(label: str) -> bool:
    """Whether a label's names are all of parts beside an article."""
    return any(words and words <= BESIDE and words - PLAIN for n in label.split(".")[1:] if (words := {w for w in re.split(r"[^a-z]+", n.lower()) if w}))


def _titled(stream: list[tuple]) -> set[int]:
    """Where elements open that hold a heading."""
    out, stack = set(), []
    for i, token in enumerate(stream):
        if token[0] == OPEN:
            if token[3] in HEADINGS:
                # those further out are in already once one of them is
                for j in reversed(stack):
                    if j in out:
                        break
                    out.add(j)
            stack.append(i)
        elif token[0] == CLOSE:
            stack.pop()
    return out


def _mixed(chain: int, block: str) -> int:
    return _hash(f"{chain} {_hash(block)}")


def host_of(url) -> "F.Column":
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/?#:]*)", 1), F.lit("")))


def _structures(batches):
    """(host, wrapper): the different expressions of single pages in a slice."""
    for piece in common.slices(batches, "html"):
        rows = sorted({(host, written(folded(tree(page)))) for host, page in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist())})
        yield pa.record_batch([pa.array([r[n] for r in rows], pa.string()) for n in (0, 1)], ["host", "wrapper"])


def _in_turn(batches):
    """(host, part, wrapper): rows that follow one another with the same host and part aligned into one."""
    key, whole = None, None

    def row():
        return pa.record_batch([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([written(whole)], pa.string())], ["host", "part", "wrapper"])

    for batch in batches:
        for host, part, text in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "wrapper"))):
            if key == (host, part):
                _settled(deque([(whole, read(text))]))
                continue
            if key is not None:
                yield row()
            key, whole = (host, part), read(text)
    if key is not None:
        yield row()


def _slots(batches):
    """(host, page, node, run, chars): the runs of text of each page by the wrapper's group."""
    kinds = [("host", pa.string()), ("page", pa.int64()), ("node", pa.int32()), ("run", pa.int64()), ("chars", pa.int64())]
    for piece in common.slices(batches, "html"):
        rows = set()
        for host, page, text in zip(*(piece.column(c).to_pylist() for c in ("host", "html", "wrapper"))):
            stream, mark = tree(page), _hash(page)
            of = matched(_remembered(text), stream)
            rows.update((host, mark, of.get(at, -1), _hash(block), len(block)) for at, _, block in runs(stream))
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], [k for k, _ in kinds])


def _regions(batches):
    """(host, wrapper, region, around, template) from wrappers and their slots."""
    for batch in batches:
        regions, templates = [], []
        for text, slots, fixed in zip(*(batch.column(c).to_pylist() for c in ("wrapper", "slots", "fixed"))):
            regions.append(article(read(text), {x["node"]: x["chars"] for x in slots or ()}))
            templates.append(sorted(_hash(f"{x['node']} {x['run']}") for x in fixed or ()))
        yield pa.record_batch([batch.column("host"), batch.column("wrapper"), pa.array([r[0] for r in regions], pa.int32()), pa.array([r[1] for r in regions], pa.int32()), pa.array(templates, pa.list_(pa.int64()))], ["host", "wrapper", "region", "around", "template"])


def _small(wrappers: DataFrame, size: "F.Column") -> bool:
    """Whether what there is of all hosts may go to every task."""
    return (wrappers.agg(F.sum(size)).first()[0] or 0) <= SENT_BYTES


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, region, around, template): each host's expression (see `read`), the group of its article and the group around that, and the runs that are template, as hashes. Pages with null html teach nothing; equal pages teach what is template once."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").filter(F.col("html").isNotNull())
    structures = rows.mapInArrow(_structures, "host string, wrapper string").distinct().withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int"))
    form = "host string, part int, wrapper string"
    some = structures.select("host", "part", "wrapper").repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(_in_turn, form)
    some = some.withColumn("part", F.lit(0)).repartition("host").sortWithinPartitions("host", "wrapper")
    wrappers = common.stored(some.mapInArrow(_in_turn, form).select("host", "wrapper"))
    small = _small(wrappers, F.length("host") + F.length("wrapper"))
    found = rows.join(F.broadcast(wrappers) if small else wrappers, "host").mapInArrow(_slots, "host string, page long, node int, run long, chars long")
    found = common.stored(found.distinct())
    different = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all"))
    counted = found.groupBy("host", "node", "run").agg(F.count("*").alias("n"), F.max("chars").alias("chars"))
    # one short row a host: fewer bytes than the wrappers
    counted = counted.join(F.broadcast(different) if small else different, "host")
    counted = counted.withColumn("same", (F.col("n") >= TEMPLATE_PAGES) & (F.col("n") >= TEMPLATE_SHARE * F.col("all")))
    # what is template on a host is no slot: its characters count for nothing
    slots = counted.groupBy("host", "node").agg(F.sum(F.when(F.col("same"), 0).otherwise(F.col("n") * F.col("chars"))).alias("chars"), F.collect_list(F.when(F.col("same"), F.struct("node", "run"))).alias("fixed"))
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("node", "chars")).alias("slots"), F.flatten(F.collect_list("fixed")).alias("fixed"))
    out = wrappers.join(slots, "host", "left").select("host", "wrapper", "slots", "fixed")
    out = common.stored(out.mapInArrow(_regions, "host string, wrapper string, region int, around int, template array<long>"))
    common.deleted(found, wrappers)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html).

    Null or empty html gives an empty text; pages with a null url are one host. Repeated rows are extracted each. The
    depth of nesting and the length of a page are not limited; other columns of the pages, whatever their names, are not looked at.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = infer_wrappers(pages)
    small = _small(wrappers, F.length("host") + F.length("wrapper") + 8 * (F.size("template") + 2))
    rows = rows.join(F.broadcast(wrappers) if small else wrappers, "host", "left").drop("host")

    def run(batches):
        for piece in common.slices(batches, "html"):
            out = []
            for page, text, region, around, template in zip(*(piece.column(c).to_pylist() for c in ("html", "wrapper", "region", "around", "template"))):
                out.append(main_text(page, _remembered(text), (region, around), frozenset(template)) if page and text else main_text(page))
            yield pa.record_batch([piece.column("page_id"), piece.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    return extract(common.read_table(spark, sf_dir, "pages"))
