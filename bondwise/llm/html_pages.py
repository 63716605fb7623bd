"""Labelled pages for training: page plans of several makers of sites, filled with random words.

Every block of a plan is known to belong to the article or not, so the labels need no markup in the page. Names of classes come from lists
of usual ones and are left out at random, as are the telling tags, so that no single feature decides.
"""

from __future__ import annotations

import random

# fixed values: usual names of page parts
NAMES = {
    "article": "article post entry content story main body text blog single page hentry".split(),
    "nav": "nav menu navbar navigation breadcrumb topbar links tabs".split(),
    "header": "header masthead banner logo top branding site".split(),
    "footer": "footer bottom copyright legal colophon credits".split(),
    "side": "sidebar aside widget related recent popular tags rail more".split(),
    "notice": "notice cookie consent alert banner gdpr popup newsletter subscribe message modal".split(),
    "ad": "ad ads advert advertisement sponsor promo sponsored banner".split(),
    "form": "form search login signup contact".split(),
    "comments": "comments comment replies discussion disqus respond reply thread".split(),
}
LETTERS = "abcdefghijklmnopqrstuvwxyzéèüñ"


class Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.labels: list[tuple[str, bool]] = []
        self.named = rng.random() < 0.85
        self.semantic = rng.random() < 0.6

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high)))

    def sentences(self, count: int) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.rng.choice((".", ".", ".", "!", "?")) for _ in range(count))

    def paragraph(self) -> str:
        """Mostly sentences; now and then cells and bars, a shout, a few words, numbers or an address."""
        kind = self.rng.random()
        if kind < 0.85:
            return self.sentences(self.rng.randint(1, 6))
        if kind < 0.91:
            return self.rng.choice((" | ", " · ", " » ")).join(self.words(1, 2) for _ in range(self.rng.randint(3, 40)))
        if kind < 0.94:
            return self.words(1, 4).capitalize() + self.rng.choice(("", ".", "!!"))
        if kind < 0.97:
            return self.sentences(1).upper() + f" {self.rng.randint(1, 10**9)}"
        return f"{self.words(1, 3)} {self.words(1, 1)}@{self.words(1, 1)}.com © {self.words(2, 9)}"

    def attr(self, kind: str) -> str:
        if not self.named or self.rng.random() < 0.1:
            return ""
        name = self.rng.choice(NAMES[kind])
        extra = self.rng.choice(("", "", "-wrap", "-box", " clearfix", "-1", "_inner"))
        return f' {self.rng.choice(("class", "class", "id"))}="{name}{extra}"'

    def tag(self, kind: str, telling: str) -> tuple[str, str]:
        name = telling if self.semantic and self.rng.random() < 0.9 else self.rng.choice(("div", "div", "section"))
        return f"<{name}{self.attr(kind)}>", f"</{name}>"

    def say(self, text: str, main: bool) -> str:
        self.labels.append((text, main))
        return text

    def links(self, kind: str, telling: str, low: int, high: int) -> str:
        a, b = self.tag(kind, telling)
        items = [f'<a href="/x">{self.say(self.words(1, 4), False)}</a>' for _ in range(self.rng.randint(low, high))]
        style = self.rng.randrange(3)
        if style == 0:
            return f"{a}<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>{b}"
        if style == 1:
            return a + "".join(f"<div>{x}</div>" for x in items) + b
        return a + "".join(f"<p>{x}</p>" for x in items) + b

    def box(self, kind: str, telling: str, texts: list[str]) -> str:
        a, b = self.tag(kind, telling)
        inner = self.rng.choice(("p", "div", "span"))
        if inner == "span" or (len(texts) == 1 and self.rng.random() < 0.5):
            return a + " ".join(self.joined(texts)) + b
        return a + "".join(f"<{inner}>{self.say(t, False)}</{inner}>" for t in texts) + b

    def joined(self, texts: list[str]) -> list[str]:
        self.labels.append((" ".join(texts), False))
        return texts

    def comments(self) -> str:
        a, b = self.tag("comments", "section")
        out = [f"<h3>{self.say(self.words(1, 3), False)}</h3>"]
        for _ in range(self.rng.randint(1, 4)):
            inner = self.attr("comments")
            out.append(f"<div{inner}><p>{self.say(self.words(1, 3), False)}</p><p>{self.say(self.sentences(self.rng.randint(1, 3)), False)}</p></div>")
        return a + "".join(out) + b

    def form(self) -> str:
        label, button = self.say(self.words(1, 4), False), self.words(1, 2)
        return f"<form{self.attr('form')}><label>{label}</label><input type=text><button>{button}</button></form>"

    def aside_inside(self) -> str:
        kind = self.rng.choice(("ad", "notice", "side", "form"))
        if kind == "form":
            return self.form()
        if kind == "side":
            return self.links("side", "aside", 2, 4)
        return self.box(kind, "aside", [self.sentences(1)])

    def body(self) -> str:
        rng = self.rng
        out = [f"<h1>{self.say(self.words(3, 14).capitalize(), True)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.68:
                text = self.paragraph()
                if rng.random() < 0.2:
                    head, _, rest = text.partition(" ")
                    self.say(text, True)
                    out.append(rng.choice((f"<p><b>{head}</b> {rest}</p>", f"<p><b>{head} {rest}<br><p>", f'<p><a href="/y">{head}</a> {rest}</p>')))
                else:
                    out.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>")).format(self.say(text, True)))
            elif kind < 0.78:
                level = rng.choice(("h2", "h3"))
                out.append(f"<{level}>{self.say(self.words(2, 7).capitalize(), True)}</{level}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.say(self.sentences(1), True)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.say(self.sentences(2), True)}</blockquote>")
            elif kind < 0.915:
                out.append(f'<figure><img src="x.png"><figcaption>{self.say(self.words(1, 9).capitalize(), True)}</figcaption></figure>')
            elif kind < 0.935:
                out.append("<table><tr>" + "".join(f"<td>{self.say(self.words(1, 4), True)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(self.aside_inside())
        if rng.random() < 0.15:
            out.append(f"<p>{self.say(self.words(1, 3).capitalize(), True)}</p>")
        return "".join(out)

    def bare(self) -> str:
        """An article with nothing or little around it: paragraphs in the body, one block of text, lines with breaks, or bare text in a box."""
        rng = self.rng
        style, parts = rng.randrange(4), [self.sentences(rng.randint(1, 6)) for _ in range(rng.randint(1, 4))]
        before = self.links("nav", "nav", 2, 6) if rng.random() < 0.25 else ""
        head = f"<h1>{self.say(self.words(2, 9).capitalize(), True)}</h1>" if rng.random() < 0.4 else ""
        if style == 0:
            text = head + "".join(f"<p>{self.say(t, True)}</p>" for t in parts)
        elif style == 1:
            text = head + f"<p>{self.say(parts[0], True)}"
        else:
            # breaks are white space inside one block
            box = "" if style == 2 else self.attr("article")
            text = f"{head}<{(tag := rng.choice(('div', 'section', 'td')))}{box}>{rng.choice(('<br><br>', '<br>')).join(parts)}</{tag}>"
            self.say(" ".join(parts), True)
            text = f"<table><tr>{text}</tr></table>" if tag == "td" and not head else text.replace("<td", "<div").replace("</td", "</div")
        after = self.box("footer", "footer", ["&copy; " + self.words(1, 6)]) if rng.random() < 0.25 else ""
        return before + text + after

    def columns(self) -> str:
        """A layout table: a cell of links beside the cell that holds the article."""
        items = [self.words(1, 3) for _ in range(self.rng.randint(2, 8))]
        links = "".join(f'<a href="/x">{t}</a>{self.rng.choice(("<br>", " "))}' for t in items)
        self.labels.append((" ".join(items), False))
        return f"<table><tr><td>{links}</td><td>{self.body()}</td></tr></table>"

    def page(self) -> str:
        rng, out = self.rng, []
        plan = rng.random()
        if plan < 0.2:
            inner = self.bare() if plan < 0.14 else self.columns()
            return f"<html><head><title>{self.words(2, 6)}</title></head><body>{inner}</body></html>" if rng.random() < 0.7 else f"<body>{inner}"
        if rng.random() < 0.5:
            out.append(self.box("header", "header", [self.words(1, 5)]))
        if rng.random() < 0.2:
            out.append(self.box("notice", "div", [self.sentences(rng.randint(1, 2)), self.words(1, 2)]))
        for kind in rng.sample(("nav", "ad", "side", "form"), rng.randint(1, 3)):
            if kind == "nav":
                out.append(self.links("nav", "nav", 2, 8))
            elif kind == "ad":
                out.append(self.box("ad", "div", [self.sentences(1)]))
            elif kind == "side":
                out.append(self.links("side", "aside", 2, 6))
            else:
                out.append(self.form())
        a, b = self.tag("article", rng.choice(("article", "main")))
        out.append(a + self.body() + (self.comments() if rng.random() < 0.1 else "") + b)
        for kind in rng.sample(("side", "ad", "comments", "notice", "form"), rng.randint(0, 3)):
            if kind == "side":
                out.append(self.links("side", "aside", 2, 6))
            elif kind == "comments":
                out.append(self.comments())
            elif kind == "form":
                out.append(self.form())
            else:
                out.append(self.box(kind, "div", [self.sentences(rng.randint(1, 2))]))
        if rng.random() < 0.9:
            out.append(self.box("footer", "footer", [rng.choice(("&copy; ", "", "")) + self.words(1, 6) + rng.choice(("", " &middot; " + self.sentences(1), "."))]))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{''.join(out)}</body></html>"


def labelled(count: int, seed: int) -> list[tuple[str, list[tuple[str, bool]]]]:
    """(page, its blocks' texts in order, each with whether it belongs to the article)."""
    out = []
    for k in range(count):
        maker = Maker(random.Random(seed * 1_000_003 + k))
        page = maker.page()
        out.append((page, maker.labels))
    return out
