"""Labelled training pages: invented articles in varied page layouts, whose main text is known."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ter an su ves ro pen dil gra bo ni ché ül ña sto rim fa ze qu or tha ing ed".split()

# Names that sites give to the parts of a page.
MAIN_BOX = [("article", ""), ("main", ""), ("div", "content"), ("div", "main-content"), ("div", "post-body"), ("div", "entry-content"), ("div", "article-body"), ("section", "story"), ("div", "post"), ("div", "text"), ("div", ""), ("section", "")]
BOILER = {
    "nav": [("nav", ""), ("div", "menu"), ("div", "navbar"), ("ul", "nav main-nav"), ("div", "navigation"), ("div", "breadcrumb"), ("nav", "breadcrumbs"), ("div", "pagination")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-header top"), ("div", "banner")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "bottom copyright"), ("div", "legal")],
    "aside": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("section", "related"), ("div", "related-posts"), ("div", "recommended more"), ("div", "trending popular"), ("div", "social share"), ("div", "tags")],
    "notice": [("div", "notice"), ("div", "cookie-banner"), ("div", "cookie consent"), ("div", "alert"), ("div", "gdpr privacy"), ("div", "popup modal"), ("div", "paywall subscribe")],
    "ad": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("div", "promo"), ("section", "promotion"), ("ins", "adsbygoogle"), ("div", "sponsor banner")],
    "form": [("form", ""), ("form", "search"), ("form", "newsletter"), ("div", "signup newsletter"), ("form", "login"), ("div", "contact-form")],
    "comments": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "disqus thread"), ("div", "replies discussion"), ("div", "comment respond")],
}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        out = ["".join(r.choices(SYLLABLES, k=r.choice((1, 2, 2, 3, 4)))) for _ in range(n)]
        for i in range(9, n, 11):
            out[i] += r.choice((".", ",", "."))
        return " ".join(out).capitalize()

    def sentence(self, low: int, high: int) -> str:
        return self.words(self.r.randint(low, high)) + self.r.choice((".", ".", ".", "", "!", "?"))

    @staticmethod
    def box(kind: tuple[str, str], inner: str, r: random.Random) -> str:
        tag, names = kind
        attr = f' {r.choice(("class", "class", "id"))}="{names}"' if names else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f'<li><a href="/">{self.words(self.r.randint(1, 4))}</a></li>' for _ in range(n)) + "</ul>"
        return " | ".join(f'<a href="/">{self.words(self.r.randint(1, 3))}</a>' for _ in range(n))

    def boiler(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            inner = self.links(r.randint(2, 8))
        elif kind == "header":
            inner = r.choice((f"<h1>{self.words(2)}</h1>", f"<a href='/'>{self.words(2)}</a>", f"<div>{self.words(3)}</div>")) + r.choice(("", self.links(3), f"<p>{self.sentence(3, 9)}</p>"))
        elif kind == "footer":
            inner = r.choice(("&copy; ", "© 2024 ", "Copyright ", "")) + self.sentence(3, 14) + r.choice(("", self.links(4), f"<p>{self.sentence(4, 20)}</p>"))
        elif kind == "aside":
            inner = r.choice((f"<h3>{self.words(2)}</h3>", "")) + r.choice((self.links(r.randint(2, 6)), f"<p>{self.sentence(5, 30)}</p>"))
        elif kind in ("notice", "ad"):
            inner = r.choice((self.sentence(3, 30), f"<p>{self.sentence(4, 40)}</p>", f"<p>{self.sentence(4, 30)}</p><button>{self.words(1)}</button>", f'<a href="/">{self.words(4)}</a>'))
        elif kind == "form":
            inner = f"<label>{self.words(2)}</label><input name='q'>" + r.choice(("", f"<p>{self.sentence(4, 20)}</p>")) + f"<button>{self.words(1)}</button>"
        else:
            one = lambda: r.choice(("<li><b>{}</b><p>{}</p></li>", "<div class='comment'><span>{}</span><p>{}</p></div>", "<div><p>{}</p><p>{}</p></div>")).format(self.words(2), self.sentence(4, 60))
            inner = r.choice((f"<h3>{self.words(2)}</h3>", "")) + "".join(one() for _ in range(r.randint(1, 6)))
        return self.box(r.choice(BOILER[kind]), inner, r)

    def article(self, mark: str) -> str:
        """Main text with a mark in front of each block, by which its label is known."""
        r, out = self.r, []
        if r.random() < 0.8:
            head = f"<h{(n := r.choice((1, 1, 2)))}>{mark}{self.words(r.randint(2, 12))}</h{n}>"
            out.append(f"<header>{head}</header>" if r.random() < 0.1 else head)
        for _ in range(r.choice((1, 2, 4, 7, 12, 20))):
            kind = r.random()
            if kind < 0.56:
                text = self.sentence(*r.choice(((1, 5), (8, 30), (25, 90))))
                if r.random() < 0.25:
                    text = f"{text} <a href='/'>{self.words(2)}</a> {self.words(4)}"
                out.append(f"<p>{mark}{text}" + r.choice(("</p>", "</p>", "")))
            elif kind < 0.64:
                out.append(f"<p><b>{mark}{self.sentence(1, 12)}<br><p>{mark}{self.sentence(2, 40)}</p>")
            elif kind < 0.7:
                out.append(f"<h{r.choice((2, 3))}>{mark}{self.words(r.randint(1, 6))}</h2>")
            elif kind < 0.76:
                out.append("<ul>" + "".join(f"<li>{mark}{self.sentence(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.79:
                out.append(f"<blockquote>{mark}{self.sentence(5, 30)}</blockquote>")
            elif kind < 0.82:
                out.append("<table>" + "".join(f"<tr><td>{mark}{self.words(2)}</td><td>{mark}{r.randint(1, 99)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.86:
                out.append(f"<div>{mark}{self.sentence(5, 60)}</div>")
            else:
                out.append(self.boiler(r.choice(("ad", "ad", "aside", "notice", "form", "comments", "nav"))))
        return "".join(out)

    def plain_page(self, mark: str) -> str:
        """A page without names and boxes: text in paragraphs, one box, or nothing at all, perhaps below a line of links."""
        r = self.r
        blocks = [f"{mark}{self.sentence(*r.choice(((1, 3), (4, 12), (10, 60))))}" for _ in range(r.choice((1, 1, 2, 3, 6)))]
        kind = r.choice(("p", "p", "p", "div", "none", "section", "center", "td"))
        body = "<br><br>".join(blocks) if kind == "none" else "".join(f"<{kind}>{b}</{kind}>" for b in blocks)
        if kind == "none":  # each line break ends a block only where a block element stands; here all is one
            body = mark + body.replace(mark, "").replace("<br><br>", " ")
        head = f"<h1>{mark}{self.words(r.randint(1, 6))}</h1>" if r.random() < 0.4 else ""
        links = self.links(r.randint(3, 7)) if r.random() < 0.3 else ""
        foot = "<hr>" + r.choice((f"<a href='/'>{self.words(1)}</a>", f"&copy; {self.sentence(2, 6)}")) if r.random() < 0.2 else ""
        inner = f"{links}{head}{body}{foot}"
        return r.choice((inner, f"<body>{inner}</body>", f"<html><head><title>{self.words(2)}</title></head><body>{inner}</body></html>"))

    def page(self, mark: str) -> str:
        r = self.r
        if r.random() < 0.15:
            return self.plain_page(mark)
        before = [self.boiler(k) for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < 0.5]
        after = [self.boiler(k) for k in ("aside", "ad", "comments", "nav", "form", "notice", "footer") if r.random() < 0.5]
        main = self.box(r.choice(MAIN_BOX[:2] if r.random() < 0.5 else MAIN_BOX), self.article(mark), r)
        for _ in range(r.choice((0, 0, 1, 2))):
            main = self.box(r.choice((("div", "container"), ("div", "wrapper"), ("main", ""), ("div", "page"), ("div", "row"))), main, r)
        return f"<html><head><title>{self.words(3)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


#: A private-use character, which no page has at its start of a block.
MARK = "\ue000"


def labelled_pages(n: int, seed: int) -> list[str]:
    """Pages whose main blocks start with MARK."""
    pages = Pages(seed)
    return [pages.page(MARK) for _ in range(n)]
