"""Annotated pages to learn from: random layouts of articles and what surrounds them, made by rule from a seed.

The text of every block that belongs to the article starts with ``MARK``. Words are random, so that nothing can be
learnt from them. Layouts use semantic elements, named or unnamed boxes, or tables; names are whole tokens, parts of
longer names, or meaningless, and tags may stay open.
"""

from __future__ import annotations

import random

MARK = ""
ALPHABETS = ["etaoinshrdlucmfwypvbg", "enisratdhulcgmobwfkzäöü", "esaitnrulodcmpévqfbghèêç", "eaosrnidltcumpbgvyqhñó", "аеинорстлвкмдп"]

#: Names by role, as sites give them.
NAMES = {
    "main": ["article", "main", "content", "post", "entry", "story", "body", "text", "article body", "entry content", "post content", "main content", "page content", "articleBody", "markdown", "document", "prose"],
    "box": ["wrapper", "container", "row", "col", "page", "site", "inner", "grid", "layout", "section", "block", "wrap", "app", "root", "primary", "outer"],
    "nav": ["nav", "menu", "navbar", "navigation", "top menu", "main nav", "links", "tabs", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip"],
    "header": ["header", "masthead", "site header", "banner", "logo", "topbar", "branding", "tagline", "head"],
    "footer": ["footer", "site footer", "copyright", "legal", "bottom", "colophon", "imprint", "credits"],
    "side": ["sidebar", "aside", "widget", "rail", "related", "recommended", "trending", "popular", "tags", "categories", "archive", "more", "teaser", "secondary", "promo box", "most read", "recent posts"],
    "notice": ["cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "cookie banner", "message", "warning", "announcement", "paywall", "disclaimer", "privacy", "toast"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "ad slot", "adsense", "dfp", "outbrain", "taboola", "commercial"],
    "form": ["form", "search", "login", "signup", "newsletter", "subscribe", "contact", "register", "feedback", "survey"],
    "share": ["share", "social", "follow", "sharing", "buttons", "actions", "toolbar", "print", "likes"],
    "comments": ["comments", "comment", "comment list", "discussion", "replies", "responses", "reader comments", "disqus", "respond", "feedback", "thread", "reviews"],
}
ELEMENTS = {"main": ["article", "main", "section"], "nav": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "notice": ["aside", "dialog", "section"], "ad": ["aside"],
            "form": ["form"], "share": ["div"], "comments": ["section"], "box": ["section"]}


class Page:
    """One page. ``layout`` is semantic, named, mixed, unnamed, table or bare."""

    LAYOUTS = ["semantic", "named", "mixed", "unnamed", "table", "bare"]
    SHARES = [30, 25, 25, 8, 6, 6]

    def __init__(self, seed: int, layout: str | None = None):
        self.rng = rng = random.Random(seed)
        self.layout = layout or rng.choices(self.LAYOUTS, self.SHARES)[0]
        self.alphabet = rng.choice(ALPHABETS)
        self.closed = rng.random() < 0.75  # are paragraphs and items closed
        self.style = rng.choice(["plain", "dash", "camel", "bem", "prefix"])
        self.known = ["".join(rng.choices(self.alphabet, k=min(12, 1 + int(rng.expovariate(0.25))))) for _ in range(150)]

    # Words

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        n = min(high, max(low, int(rng.lognormvariate(0, 0.6) * (low + high) / 2)))
        return " ".join(rng.choices(self.known, k=n))

    def prose(self, low: int, high: int) -> str:
        rng, words = self.rng, self.words(low, high).split()
        for k in range(len(words)):
            if rng.random() < 0.07:
                words[k] += rng.choice([".", ".", ",", ",", ";", "!", "?", " &amp;", "&nbsp;", " 12", " 3.5", "%", "***", "###"])
        return " ".join(words) + rng.choice([".", ".", ".", "", "!"])

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.rng.randrange(9999)}">{self.words(low, high)}</a>'

    def inline(self, text: str) -> str:
        """Some of a paragraph's words in links or emphasis."""
        rng, words = self.rng, text.split(" ")
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(words))
            words[k] = rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>", "<code>{}</code>", "{}<br>"]).format(words[k])
        return " ".join(words)

    # Elements

    def name(self, role: str) -> str:
        rng, name = self.rng, self.rng.choice(NAMES[role])
        if rng.random() < 0.15:
            name += " " + rng.choice(["top", "left", "right", "large", "box", "list", "item", "area", "v2", "js", "0"])
        parts = name.split(" ")
        if self.style == "dash":
            return "-".join(parts)
        if self.style == "camel":
            return parts[0] + "".join(p.title() for p in parts[1:])
        if self.style == "bem":
            return "__".join(parts)
        if self.style == "prefix":
            return rng.choice(["c-", "o-", "site-", "js-", "td-"]) + "-".join(parts)
        return name

    def attributes(self, role: str) -> str:
        rng = self.rng
        if self.layout in ("unnamed", "table", "bare"):
            return rng.choice(["", "", f' class="{self.nonsense()}"'])
        if rng.random() < (0.35 if self.layout == "semantic" else 0.08):
            return ""
        out = f' {rng.choice(["class", "class", "id"])}="{self.name(role)}"'
        if rng.random() < 0.1:
            out += {"nav": ' role="navigation"', "main": ' role="main"', "footer": ' role="contentinfo"', "header": ' role="banner"', "side": ' role="complementary"', "form": ' role="search"', "notice": ' role="dialog"'}.get(role, "")
        if role == "notice" and rng.random() < 0.2:
            out += rng.choice([' style="display:none"', " hidden"])
        return out

    def nonsense(self) -> str:
        return "".join(self.rng.choice("bcdfghjkqvwxz") for _ in range(4)) + str(self.rng.randrange(99))

    def box(self, role: str, inside: str) -> str:
        rng = self.rng
        semantic = self.layout == "semantic" or self.layout == "mixed" and rng.random() < 0.5
        element = rng.choice(ELEMENTS[role]) if semantic and role != "box" else "div"
        return f"<{element}{self.attributes(role)}>{inside}</{element}>"

    def p(self, text: str) -> str:
        return f"<p>{text}</p>" if self.closed else f"<p>{text}"

    def items(self, rows: list[str]) -> str:
        end = "</li>" if self.closed else ""
        kind = self.rng.choice(["ul", "ul", "ol"])
        return f"<{kind}>" + "".join(f"<li>{r}{end}" for r in rows) + f"</{kind}>"

    # Parts around the article

    def nav(self) -> str:
        rng, rows = self.rng, [self.link(1, 3) for _ in range(self.rng.randrange(2, 12))]
        inside = rng.choice([self.items(rows), " | ".join(rows), " ".join(rows), "".join(f"<div>{r}</div>" for r in rows), " &gt; ".join([*rows[:3], self.words(1, 5)]),
                             self.items([self.words(1, 3) for _ in rows])])
        return self.box("nav", inside)

    def header(self) -> str:
        rng = self.rng
        rows = [rng.choice([f"<h1>{self.link(1, 3)}</h1>", f"<div>{self.words(1, 4)}</div>", f"<h2>{self.words(1, 4)}</h2>"])]
        if rng.random() < 0.6:
            rows.append(self.p(self.prose(2, 12)))
        if rng.random() < 0.4:
            rows.append(self.nav())
        return self.box("header", "".join(rows))

    def footer(self) -> str:
        rng, rows = self.rng, []
        if rng.random() < 0.6:
            rows.append(self.items([self.link() for _ in range(rng.randrange(2, 9))]))
        rows += [rng.choice([self.p, str])(rng.choice(["&copy; 2024 ", "© ", ""]) + self.prose(2, 30)) for _ in range(rng.randrange(1, 4))]
        return self.box("footer", "".join(rows))

    def side(self) -> str:
        rng, out = self.rng, []
        for _ in range(rng.randrange(1, 4)):
            rows = [rng.choice([f"<h3>{self.words(1, 4)}</h3>", f"<h4>{self.words(1, 3)}</h4>", ""])]
            rows.append(rng.choice([self.items([self.link(2, 9) for _ in range(rng.randrange(2, 8))]), self.p(self.prose(8, 40)), self.p(self.prose(5, 25)) + self.p(self.link(1, 3)),
                                    "".join(f"<div>{self.link(2, 8)}{self.p(self.prose(5, 30))}</div>" for _ in range(rng.randrange(2, 5)))]))
            out.append(self.box("side", "".join(rows)) if rng.random() < 0.4 else "".join(rows))
        return self.box("side", "".join(out))

    def notice(self) -> str:
        text = self.prose(5, 45)
        return self.box("notice", self.rng.choice([self.p(text), text]) + self.rng.choice(["", self.link(1, 2), f"<button>{self.words(1, 2)}</button>", f"<div>{self.link(1, 3)}{self.link(1, 3)}</div>"]))

    def ad(self) -> str:
        text = self.prose(2, 30)
        return self.rng.choice([f"<!-- ad {self.rng.randrange(99)} -->", ""]) + self.box("ad", self.rng.choice([text, text, self.p(text), f"<a href='/x'>{text}</a>", f"<span>{self.words(1, 1)}</span>{self.p(text)}"]))

    def form(self) -> str:
        rng = self.rng
        rows = [rng.choice(["", f"<h3>{self.words(1, 5)}</h3>", self.p(self.prose(3, 25))])]
        rows += [rng.choice([f"<label>{self.words(1, 3)}</label><input type=text>", f"<div>{self.words(1, 3)} <input name=q></div>", f"<select><option>{self.words(1, 1)}</select>"]) for _ in range(rng.randrange(1, 4))]
        inside = "".join(rows) + f"<button type=submit>{self.words(1, 2)}</button>"
        return self.box("form", inside if rng.random() < 0.5 else f"<form action='/s'>{inside}</form>")

    def share(self) -> str:
        rows = [self.link(1, 2) for _ in range(self.rng.randrange(2, 6))]
        return self.box("share", self.rng.choice([" ".join(rows), self.items(rows), self.words(1, 3) + " " + " ".join(rows)]))

    def comments(self) -> str:
        rng, rows = self.rng, []
        for _ in range(rng.randrange(1, 8)):
            by = rng.choice([f"<b>{self.words(1, 2)}</b> ", f"<div>{self.words(1, 2)} 12.3.2021</div>", f"<h4>{self.words(1, 2)}</h4>", self.link(1, 2), ""])
            body = by + rng.choice([self.p, str])(self.prose(3, 70)) + rng.choice(["", "", f"<div>{self.link(1, 1)}</div>"])
            rows.append(body if rng.random() < 0.3 else self.box("comments", body))
        top = rng.choice([f"<h2>{self.words(1, 4)}</h2>", f"<h3>{rng.randrange(99)} {self.words(1, 2)}</h3>", ""])
        listed = rng.choice([self.items(rows), "".join(f"<div>{r}</div>" for r in rows), "".join(rows)])
        return self.box("comments", top + listed + (self.form() if rng.random() < 0.3 else ""))

    # The article

    def article(self) -> str:
        rng, mark = self.rng, MARK
        size = rng.choice([1, 2, 3, 5, 8, 14, 30])
        low, high = rng.choice([(3, 20), (15, 60), (30, 120), (80, 300)])
        title = mark + self.words(2, 10)
        rows = [rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>", "", ""])]
        if rng.random() < 0.2:
            rows.append(f"<p><b>{mark}{self.prose(2, 10)}<br>")
        div = self.layout != "semantic" and rng.random() < 0.1
        for _ in range(size):
            text = mark + self.inline(self.prose(low, high))
            rows.append(f"<div>{text}</div>" if div else self.p(text))
            chance = rng.random()
            if chance < 0.08:
                rows.append(f"<h{rng.choice([2, 3, 4])}>{mark}{self.words(1, 8)}</h2>")
            elif chance < 0.13:
                rows.append(self.items([mark + self.inline(self.prose(2, 25)) for _ in range(rng.randrange(2, 7))]))
            elif chance < 0.17:
                rows.append(f"<blockquote>{self.p(mark + self.prose(5, 40))}</blockquote>")
            elif chance < 0.19:
                rows.append(f"<figure><img src=x><figcaption>{mark}{self.prose(3, 15)}</figcaption></figure>")
            elif chance < 0.21:
                rows.append(f"<pre>{mark}{self.prose(3, 30)}</pre>")
            elif chance < 0.23:
                rows.append("<table>" + "".join(f"<tr><td>{mark}{self.words(1, 4)}</td><td>{mark}{rng.randrange(999)}</td></tr>" for _ in range(rng.randrange(2, 6))) + "</table>")
            elif chance < 0.25:
                rows.append(self.p(mark + self.words(1, 5)))
            elif chance < 0.33:
                rows.append(rng.choice([self.ad, self.ad, self.share, self.side, self.notice, self.form])())
        if not self.closed and rng.random() < 0.3:
            rows.append(f"<p><b>{mark}{self.prose(2, 10)}<br>")
        return "".join(rows)

    def html(self) -> str:
        rng = self.rng
        parts = [self.article() if rng.random() < 0.96 else ""]
        if self.layout == "bare":
            body = parts[0]
        else:
            before = [f for f, share in ((self.notice, 0.25), (self.header, 0.5), (self.nav, 0.8), (self.nav, 0.2), (self.ad, 0.4), (self.form, 0.15)) if rng.random() < share]
            within_before = [f for f, share in ((self.side, 0.15), (self.nav, 0.1), (self.share, 0.1), (self.ad, 0.15)) if rng.random() < share]
            within_after = [f for f, share in ((self.share, 0.2), (self.comments, 0.35), (self.side, 0.4), (self.form, 0.15), (self.ad, 0.2)) if rng.random() < share]
            after = [f for f, share in ((self.side, 0.2), (self.comments, 0.1), (self.form, 0.1), (self.nav, 0.1), (self.footer, 0.85), (self.notice, 0.2)) if rng.random() < share]
            main = self.box("main", parts[0]) if self.layout != "unnamed" or rng.random() < 0.7 else parts[0]
            for _ in range(rng.choice([0, 0, 1, 2])):
                main = self.box("box", main)
            if self.layout == "table":
                cells = ["".join(f() for f in within_before), main, "".join(f() for f in within_after)]
                middle = "<table><tr>" + "".join(f"<td>{c}</td>" for c in cells if c) + "</tr></table>"
            else:
                middle = "".join(f() for f in within_before) + main + "".join(f() for f in within_after)
                if rng.random() < 0.3:
                    middle = self.box("main", middle)
            body = "".join(f() for f in before) + middle + "".join(f() for f in after)
            for _ in range(rng.choice([0, 0, 1, 2])):
                body = self.box("box", body)
        scripts = '<style>p{margin:0}</style><script>var t="</p>";</script>'
        top = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(1, 6)}</title>{scripts}</head><body{rng.choice(["", "", f" class={self.nonsense()}"])}>'
        if self.layout == "bare" and rng.random() < 0.5:
            return body
        return top + body + rng.choice(["</body></html>", ""])
