"""HTML as a flat list of text blocks with the features of their neighbourhood."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements that part blocks; every other element is inline.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
section summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is never content.
SILENT_TAGS = frozenset("head title select option button textarea noscript template svg math iframe object canvas audio "
                        "video datalist map".split())
# The start tags that leave a head open whose end tag was left out.
HEAD_TAGS = frozenset("title meta link base basefont bgsound noframes style script noscript template".split())
FURNITURE_TAGS = frozenset("nav footer aside menu dialog".split())
ARTICLE_TAGS = frozenset(("article", "main"))
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu "
                            "menubar toolbar".split())
# Words of class and id names, whole or in the plural.
FURNITURE_WORDS = frozenset("""ad advert advertisement adsense banner sponsor sponsored promo promotion sidebar menu nav
navbar navigation breadcrumb cookie consent gdpr notice popup modal overlay newsletter subscribe subscription signup
login share sharing social comment disqus respond reply related recommended recommendation widget footer masthead
topbar search copyright pagination pager tagcloud toc skip hidden""".split())
ARTICLE_WORDS = frozenset("article content post story entry main body text".split())
# Furniture words of parts that hold articles of their own: readers' comments and teasers.
COMMENT_WORDS = frozenset("comment disqus respond reply related recommended".split())
# In a name, these make what follows a feature of the element ("has-sidebar", "overflow-hidden").
QUALIFIERS = frozenset("has have with without no non not overflow backface".split())
# A name that ends in one of these and holds an article word tells what is wrapped ("content-sidebar-wrap").
WRAP_WORDS = frozenset("wrap wrapper container layout grid".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
# One attribute, or the end of the tag. Names hold anything but white space, "/", ">" and
# (after the first character) "="; values without quotes end at white space or ">".
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)|(?=>)))?)""")
RAW_TAGS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "xmp", "title", "textarea")}
TOLD_BY = frozenset(("class", "id", "role", "hidden", "aria-hidden"))
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

PAGE_FORM_SHARE = 2 / 3  # of the words that are no other furniture

FEATURES = ("furniture", "article", "heading", "item", "words", "link_density",
            "words_before", "link_density_before", "words_after", "link_density_after")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    article: bool
    heading: bool
    item: bool
    cleared: bool  # in an article element that lies in a form or a wrapper with a furniture name
    form: bool  # furniture by a form alone


@dataclass
class _Open:
    tag: str = ""
    furniture: bool = False
    named: bool = False  # furniture by class and id names alone
    form: bool = False
    cleared: bool = False
    article: bool = False
    silent: bool = False


@dataclass
class _Reader:
    """Collects the text between block tags; knows the open elements."""
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: int = 0

    def text(self, raw: str) -> None:
        if self.in_head() and not raw.isspace():
            self.end("head")
        if raw and not (self.stack and self.stack[-1].silent):
            raw = html.unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.in_link:
                self.linked += len(raw.split())

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1] if self.stack else _Open()
            tags = {o.tag for o in self.stack[-3:]}
            self.blocks.append(Block(text, len(text.split()), self.linked, top.furniture or top.named or top.form, top.article,
                                     bool(tags & HEADINGS), bool(tags & {"li", "dt", "dd", "td", "th"}), top.cleared,
                                     top.form and not (top.furniture or top.named)))
        self.parts, self.linked = [], 0

    def in_head(self) -> bool:
        return bool(self.stack) and self.stack[-1].tag == "head"

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if self.in_head() and tag not in HEAD_TAGS:
            self.end("head")
        if tag == "br" or tag == "wbr":
            self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.end_block()
            self._imply_end(tag)
        if tag in VOID_TAGS:
            return
        if tag == "a":
            self.in_link += 1
            return
        if tag not in BLOCK_TAGS and tag not in SILENT_TAGS and "class" not in attributes and "role" not in attributes:
            return
        top = self.stack[-1] if self.stack else _Open()
        furniture, by_name, article, article_element = marks(tag, attributes)
        if tag == "header" and not top.article:
            furniture = True
        by_name |= top.named
        form = top.form or tag == "form"
        cleared = (by_name or form) and article_element
        self.stack.append(_Open(tag, top.furniture or furniture, by_name and not cleared, form and not cleared, top.cleared or cleared,
                                top.article or article, top.silent or tag in SILENT_TAGS))

    def _imply_end(self, tag: str) -> None:
        """A new paragraph or item ends the one still open, and links with it."""
        self.in_link = 0
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
        while self.stack and self.stack[-1].tag in ("p", *HEADINGS, *ends):
            self.stack.pop()
        if tag == "body":  # what was left open in the head
            self.stack = [o for o in self.stack if o.tag == "html"]

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
            return
        if tag in BLOCK_TAGS:
            self.end_block()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                if any(o.tag in BLOCK_TAGS for o in self.stack[i:]):
                    self.end_block()
                del self.stack[i:]
                return


def marks(tag: str, attributes: dict[str, str]) -> tuple[bool, bool, bool, bool]:
    """Whether an element is furniture by its tag, role or a name of ``COMMENT_WORDS``,
    furniture by other names, an article by any of these, and an article element."""
    furniture, by_name, article, element = tag in FURNITURE_TAGS, False, False, tag in ARTICLE_TAGS
    for key, value in attributes.items():
        if key == "role":
            furniture |= value.strip().lower() in FURNITURE_ROLES
            element |= value.strip().lower() in ("main", "article")
        elif key in ("hidden", "aria-hidden"):
            furniture |= value.lower() != "false"
        elif tag not in ("html", "body"):
            for name in value.split():
                words = [w.lower() for w in NAME_WORDS.findall(name)]
                article |= not ARTICLE_WORDS.isdisjoint(words)
                found = furniture_words(words)
                furniture |= not COMMENT_WORDS.isdisjoint(found)
                by_name |= bool(found)
    return furniture, by_name, article or element, element


def furniture_words(words: list[str]) -> list[str]:
    """The words of one name, in the singular, that mark its element as furniture."""
    found = []
    for w in words:
        if w in QUALIFIERS:
            break
        w = w[:-1] if w.endswith("s") and w[:-1] in FURNITURE_WORDS else w
        if w in FURNITURE_WORDS:
            found.append(w)
    if found and words[-1] in WRAP_WORDS and not ARTICLE_WORDS.isdisjoint(words):
        found = [w for w in found if w in COMMENT_WORDS]
    return found


def attributes_from(page: str, at: int) -> tuple[int, dict[str, str]]:
    """Where the tag whose attributes begin at ``at`` ends, and those of ``TOLD_BY`` (the
    first of a name, values as written). A tag that never ends takes the rest of the page."""
    if page.startswith(">", at):
        return at + 1, {}
    found: dict[str, str] = {}
    while m := ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            return at, found
        name = m[2].lower()
        if name in TOLD_BY:
            found.setdefault(name, m[3] or m[4] or m[5] or "")
    return len(page), found


def read(page: str, r: _Reader) -> None:
    """One pass over the page: text, comments, raw elements and tags. Every character is
    looked at a bounded number of times, whatever is left open."""
    done = at = 0
    open_ended = set()  # raw elements without an end tag from here on
    while (at := page.find("<", at)) >= 0:
        tag = None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            end = end + 3 if end >= 0 else len(page)
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = end + 1 if end >= 0 else len(page)
        elif m := TAG.match(page, at):
            tag = m[2].lower()
            end, attributes = attributes_from(page, m.end())
        else:  # a sign, not a tag
            at += 1
            continue
        if at > done:
            r.text(page[done:at])
        at = done = end
        if tag and m[1]:
            r.end(tag)
        elif tag in RAW_TAGS:
            close = None if tag in open_ended else RAW_TAGS[tag].search(page, at)
            if not close:
                open_ended.add(tag)
            if close or tag not in ("title", "textarea"):  # without an end these two hold markup
                at = done = close.start() if close else len(page)
            if tag in SILENT_TAGS:
                r.start(tag, attributes)
        elif tag:
            r.start(tag, attributes)
    r.text(page[done:])


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; markup, scripts, styles and comments are gone.

    Articles in forms and in wrappers with furniture names are the page's text if they
    hold more words than its other articles, and teasers or the like if not. A form
    around the page (it holds most of the words, and no article is elsewhere) is no
    furniture."""
    r = _Reader()
    read(page, r)
    r.end_block()
    formed = sum(b.words for b in r.blocks if b.form)
    if not any(b.article and not b.furniture for b in r.blocks) and formed > PAGE_FORM_SHARE * sum(b.words for b in r.blocks if not b.furniture or b.form):
        for b in r.blocks:
            b.furniture &= not b.form
    inside = [b for b in r.blocks if b.article and not b.furniture]
    cleared = [b for b in inside if b.cleared]
    if cleared and 2 * sum(b.words for b in cleared) <= sum(b.words for b in inside):
        for b in cleared:
            b.furniture = True
    return r.blocks


def features(found: list[Block]) -> list[tuple]:
    """A row of FEATURES for each block."""
    density = [b.linked / b.words for b in found]
    size = [b.words for b in found]
    out = []
    for i, b in enumerate(found):
        before = (size[i - 1], density[i - 1]) if i else (0, 0.0)
        after = (size[i + 1], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        out.append((float(b.furniture), float(b.article), float(b.heading), float(b.item), b.words, density[i],
                    *before, *after))
    return out
