"""HTML -> leaf blocks in page order, and training pages whose blocks are known."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("br hr".split())
#: An opening tag ends an open one of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Up to these an implied end reaches.
SCOPE = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table td th ul menu".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|title|textarea)(?=[\s/>])[^>]*(?<!/)>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
#: Left out with all they hold, if they end; those of NESTED may hold one another.
DROPPED = frozenset("noscript template svg iframe select button object canvas".split())
NESTED = frozenset("template svg object".split())
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|\d+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags and the words of their class, id and role, outermost first
    link_chars: int


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return (tag,)
    words = [w.lower() for m in NAMES.finditer(attributes) for w in PARTS.findall(m[1] or m[2] or m[3] or "")]
    return (tag, *(f".{w}" for w in dict.fromkeys(words)))


def ends_of(tokens: list[re.Match]) -> dict[int, int]:
    """For each dropped element that ends, the places of its tags among the tokens; self-closed ones and those without an end tag have none."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        tag = (m[3] or m[6] or "").lower()
        if tag not in DROPPED:
            continue
        places = opened.setdefault(tag, [])
        if m[2] or m[5]:
            if places:
                ends[places.pop()] = i
        elif not m[0].endswith("/>"):
            if tag not in NESTED:
                places.clear()
            places.append(i)
    return ends


def blocks_of(page: str) -> list[Block]:
    """Runs of text between block tags, white space made single. Scripts, styles, form controls, titles, comments and markup are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    state = [0, 0]  # characters inside links, and whether a link is open

    def flush():
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, tuple(n for _, names in stack for n in names), min(state[0], len(whole))))
            text.clear()
        state[0] = 0

    def add(piece: str):
        text.append(piece)
        if state[1]:
            state[0] += len(piece)

    at = 0
    tokens = list(TOKEN.finditer(page))
    dropped = ends_of(tokens)
    for i, m in enumerate(tokens):
        if m.start() < at:  # inside a dropped element
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if i in dropped:
            at = tokens[dropped[i]].end()
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing = m[2] or m[5]
        if tag == "a":
            state[1] = 0 if closing else 1
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        ends = CLOSES.get(tag, set()) | {"p"}
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ends:
                del stack[i:]
                break
            if stack[i][0] in SCOPE:
                break
        stack.append((tag, names_of(tag, m[4] or m[7] or "")))
    if at < len(page):
        add(page[at:])
    flush()
    return out


SYLLABLES = "an be co de el fa gi ho in ka lo me no or pa qui re sa ti un ver wa xi yo za ion ent est ura".split()
BOILER = (
    "home about contact login register menu search subscribe newsletter cookies cookie privacy policy accept terms share tweet follow facebook related popular "
    "recent comments comment reply posted copyright rights reserved advertisement sponsored advert sign up download app read more next previous tags archive "
    "categories rss sitemap help careers press shop cart account"
).split()


class PageMaker:
    """Random page layouts; every leaf block is tagged in its text by a mark that says if it belongs to the article."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def boiler(self, low: int, high: int) -> str:
        r = self.r
        return " ".join(r.choice(BOILER) if r.random() < 0.5 else self.words(1, 1) for _ in range(r.randint(low, high)))

    def prose(self, low: int = 1, high: int = 90) -> str:
        text = self.words(low, high).capitalize() + self.r.choice([".", ".", ".", "", "!", "?"])
        return text if self.r.random() < 0.9 else re.sub(r" ", self.r.choice(["*** ", " | ", "!! ", ", "]), text)

    def name(self, names: str) -> str:
        r = self.r
        word = r.choice(names.split())
        if r.random() < 0.3:
            word = f"{r.choice(['site', 'page', 'x', 'block', 'wrap', 'js'])}-{word}"
        if r.random() < 0.2:
            word += f"-{r.choice(['inner', 'box', 'item', 'area', str(r.randint(1, 9))])}"
        return f' {r.choice(["class", "class", "id"])}="{word}"'

    def plain(self) -> str:
        """An attribute that says nothing, or none."""
        r = self.r
        word = r.choice(["row", "col", "inner", "wrap", "box", "a", "b", "x", "grid", "outer", "clearfix", "section", "module", "layout", "unit"])
        word += r.choice(["", "", str(r.randint(1, 40)), f"-{r.randint(1, 12)}", " inner", " col wrap"])
        return r.choice(["", f' class="{word}"', f' id="{word.replace(" ", "")}"'])

    def nested(self, inside: str, most: int = 8) -> str:
        depth = self.r.randint(0, most) if self.r.random() < 0.3 else self.r.randint(0, 1)
        return "".join(f"<div{self.plain()}>" for _ in range(depth)) + inside + "</div>" * depth

    def bar(self, mark: str) -> str:
        """Links in a row, without a list."""
        word = lambda: f'<a href="/w">{self.boiler(1, 2)}</a>' if self.r.random() < 0.7 else self.boiler(1, 2)
        return mark + self.r.choice([" | ", " &middot; ", " / ", " "]).join(word() for _ in range(self.r.randint(2, 6)))

    def unnamed(self, where: str) -> str:
        """Boilerplate whose tags don't tell: text, links and the place must."""
        r, o = self.r, "\x01"
        legal = f"{r.choice(['Copyright', '&copy;', '(c)'])} {r.randint(1996, 2026)} {r.choice([self.boiler(1, 8), self.words(1, 4).title()])}{r.choice(['', '.', '. All rights reserved.', ' - all rights reserved'])}"
        call = f"{r.choice(['Subscribe', 'Sign up', 'Join', 'Follow', 'Share', 'Download'])} {self.boiler(2, 9)}"
        kinds = {
            "top": [lambda: f"<div{self.plain()}>{self.bar(o)}</div>", lambda: f"<div{self.plain()}>{self.links(o)}</div>", lambda: f'<div role="{r.choice(["navigation", "banner", "search"])}">{self.bar(o)}</div>'],
            "any": [lambda: f"<div{self.plain()}>{o}{call}</div>", lambda: f'<div role="{r.choice(["complementary", "dialog", "alert", "note"])}"><p>{o}{self.prose(2, 25)}</p></div>'],
            "side": [lambda: f'<div role="complementary"><h3>{o}{self.boiler(1, 3)}</h3>{self.links(o)}<p>{o}{self.prose(2, 20)}</p></div>', lambda: f"<div{self.plain()}>{self.links(o)}</div>"],
            "end": [
                lambda: f"<div{self.plain()}>{o}{legal}</div>", lambda: f"<div{self.plain()}>{self.bar(o)}</div><div{self.plain()}>{o}{legal}</div>", lambda: f'<div role="contentinfo">{o}{legal}</div>',
                lambda: f"<section>{''.join(f'<article><p>{o}{self.prose(1, 30)}</p></article>' for _ in range(r.randint(1, 5)))}</section>",
                lambda: f"<div{self.plain()}>{o}{call}</div>",
            ],
        }
        return r.choice(kinds[where])()

    def links(self, mark: str, low: int = 2, high: int = 9) -> str:
        item = lambda: f'<li><a href="/x">{mark}{self.boiler(1, 4) if self.r.random() < 0.6 else self.words(1, 4)}</a></li>'
        return f"<ul>{''.join(item() for _ in range(self.r.randint(low, high)))}</ul>"

    def junk(self, where: str) -> str:
        r, o = self.r, "\x01"
        link = f'<a href="/y">{self.boiler(1, 3)}</a>'
        kinds = {
            "top": [
                lambda: f"<nav{self.name('nav menu main-nav') if r.random() < 0.5 else ''}>{self.links(o)}</nav>",
                lambda: f"<header><div{self.name('logo brand')}>{o}{self.words(1, 3)}</div>{self.links(o)}</header>",
                lambda: f"<header><h1>{o}{self.words(1, 4)}</h1><p>{o}{self.words(2, 8)}</p></header>",
                lambda: f"<div{self.name('menu navbar topbar navigation header')}>{self.links(o)}</div>",
                lambda: f"<div{self.name('breadcrumb breadcrumbs')}>{o}{link} &gt; {link}</div>",
            ],
            "any": [
                lambda: f"<div{self.name('ad ads advert advertisement sponsored promo banner')}>{o}{self.prose(2, 30)}</div>",
                lambda: f"<aside>{o}{self.prose(2, 25)}</aside>",
                lambda: f"<div{self.name('cookie cookies consent notice alert gdpr popup')}><p>{o}{self.prose(4, 30)}</p>{o}{self.boiler(1, 2)}</div>",
                lambda: f"<div{self.name('share social sharing follow')}>{o}{link} {link}</div>",
                lambda: f"<form{self.name('newsletter subscribe search login signup')}><label>{o}{self.boiler(1, 6)}</label><input name=\"q\"></form>",
                lambda: f"<form action=\"/s\"><p>{o}{self.prose(2, 12)}</p></form>",
            ],
            "side": [
                lambda: f"<aside{self.name('sidebar widget related')}><h3>{o}{self.boiler(1, 3)}</h3>{self.links(o)}</aside>",
                lambda: f"<div{self.name('sidebar related popular widget recommended')}><h2>{o}{self.words(1, 4)}</h2>{self.links(o)}<p>{o}{self.prose(3, 20)}</p></div>",
            ],
            "end": [
                lambda: self.comments(),
                lambda: f"<footer>{o}&copy; {self.boiler(2, 15)}</footer>",
                lambda: f"<footer>{self.links(o)}<p>{o}{self.prose(3, 25)}</p></footer>",
                lambda: f"<div{self.name('footer bottom copyright legal')}>{o}{self.prose(2, 20)} {link}</div>",
                lambda: f"<div{self.name('related more recommended')}><h3>{o}{self.words(1, 3)}</h3>{self.links(o)}</div>",
                lambda: f"<div{self.name('tags pagination pager')}>{o}{link} {link}</div>",
            ],
        }
        return self.nested(r.choice(kinds[where])() if r.random() < 0.75 else self.unnamed(where))

    def comments(self) -> str:
        r, o = self.r, "\x01"
        one = lambda: f"<{k}{self.name('comment reply') if r.random() < 0.8 else ''}><b>{o}{self.words(1, 2)}</b><p>{o}{self.prose(1, 50)}</p></{k}>"
        k = r.choice(["div", "li", "article"])
        box = r.choice(["section", "div", "div", "ol" if k == "li" else "section"])
        return f"<{box}{self.name('comments comment-list disqus responses discussion')}><h3>{o}{self.boiler(1, 2)}</h3>{''.join(one() for _ in range(r.randint(1, 6)))}</{box}>"

    def article(self) -> str:
        r, c = self.r, "\x02"
        parts = []
        title = f"<h1>{c}{self.prose(1, 12)}</h1>"
        if r.random() < 0.8:
            parts.append(f"<header>{title}</header>" if r.random() < 0.2 else title)
        for _ in range(r.randint(1, 16)):
            x = r.random()
            if x < 0.68:
                parts.append(f"<p>{c}{self.prose()}</p>")
            elif x < 0.74:
                parts.append(f"<p><b>{c}{self.prose(1, 12)}<br>")
            elif x < 0.79:
                parts.append(f"<h{r.randint(2, 4)}>{c}{self.words(1, 8)}</h{r.randint(2, 4)}>")
            elif x < 0.83:
                parts.append(f"<ul>{''.join(f'<li>{c}{self.prose(1, 20)}</li>' for _ in range(r.randint(1, 5)))}</ul>")
            elif x < 0.86:
                parts.append(f"<blockquote>{c}{self.prose(3, 40)}</blockquote>")
            elif x < 0.88:
                parts.append(f"<pre>{c}{self.words(2, 20)}</pre>")
            elif x < 0.90:
                parts.append(f"<table><tr><td>{c}{self.words(1, 4)}</td><td>{c}{self.words(1, 4)}</td></tr></table>")
            elif x < 0.93:
                parts.append(f"<p>{c}{self.words(2, 20)} <a href=\"/z\">{self.words(1, 4)}</a> {self.prose(2, 30)}</p>")
            else:
                parts.append(self.junk("any"))
        body = "".join(parts)
        kind = r.random()
        if kind < 0.5:
            return f"<article{self.name('post article entry story') if r.random() < 0.4 else ''}>{body}</article>"
        if kind < 0.65:
            return f"<main>{body}</main>" if r.random() < 0.7 else f'<div role="{r.choice(["main", "article"])}">{body}</div>'
        if kind < 0.86:
            return f"<div{self.name('content post entry article story body text main-content prose')}>{body}</div>"
        return f"<div{self.plain()}>{body}</div>"

    def tables(self) -> str:
        """A page laid out by a table: rows of bars around a cell with the article."""
        r = self.r
        side = f"<td>{self.junk('side')}</td>" if r.random() < 0.6 else ""
        cells = [f"<td>{self.article()}</td>", side]
        r.shuffle(cells)
        wide = ' colspan="2"' if side else ""
        head = f"<tr><td{wide}>{self.bar(chr(1)) if r.random() < 0.7 else self.junk('top')}</td></tr>"
        return f"<table{self.plain()}>{head}<tr>{''.join(cells)}</tr><tr><td{wide}>{self.unnamed('end')}</td></tr></table>"

    def page(self) -> str:
        r = self.r
        top = "".join(self.junk(r.choice(["top", "top", "top", "any"])) for _ in range(r.randint(0, 3)))
        ads = f"<div{self.name('ad ads banner promo')}>\x01{self.prose(2, 20)}</div>" if r.random() < 0.4 else ""
        if r.random() < 0.18:
            return f"<html><head><title>{self.words(2, 8)}</title></head><body>{self.tables()}</body></html>"
        middle = self.nested(self.article())
        if r.random() < 0.4:
            middle = f"<div{self.name('wrapper container row page')}>{middle}{self.junk('side')}</div>" if r.random() < 0.6 else f"<div>{self.junk('side')}{middle}</div>"
        end = "".join(self.junk(r.choice(["end", "end", "end", "any"])) for _ in range(r.randint(0, 4)))
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{top}{ads}{middle}{end}</body></html>"


def marked_pages(n: int, seed: int = 0) -> list[list[tuple[Block, int]]]:
    """For each page its blocks and 1 for those of the article."""
    maker, out = PageMaker(seed), []
    for _ in range(n):
        rows = []
        for b in blocks_of(maker.page()):
            label = int("\x02" in b.text)
            rows.append((Block(b.text.replace("\x01", "").replace("\x02", ""), b.path, b.link_chars), label))
        out.append(rows)
    return out
