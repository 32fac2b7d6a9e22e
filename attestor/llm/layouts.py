"""Web pages laid out at random around given text, for fitting the extraction of main text. Main text carries MARK."""

from __future__ import annotations

import html
import random

#: Before every piece of main text; a character for private use that parsing keeps.
MARK = ""

# Names that sites give to their parts; the page's own code picks among them.
MAIN = "content main post entry article story text body article-body post-content entry-content main-content story__body page-content contentMain articleText single-post".split()
NEUTRAL = "wrap wrapper container row col inner outer layout grid box block clearfix section panel holder site page flex u-mb-2 col-md-8 region unit left right".split()
PARTS = {
    "nav": "nav navbar menu main-menu site-nav navigation topnav nav-links breadcrumb breadcrumbs pagination pager tabs toc skip-links mobileMenu".split(),
    "header": "header site-header masthead topbar page-header branding logo head header-inner siteHeader tagline".split(),
    "footer": "footer site-footer foot colophon bottom copyright footer-widgets legal page-footer siteFooter".split(),
    "aside": "sidebar side sidebar-right aside widget rail related related-posts recommended trending more-stories teaser popular sideBar".split(),
    "notice": "notice cookie-notice cookies consent gdpr-banner alert popup modal overlay announcement privacy-notice disclaimer toast warning".split(),
    "advert": "ad ads advert advertisement sponsored promo banner ad-slot ad-container adsbygoogle sponsor-box promoted affiliate".split(),
    "form": "form search search-box login newsletter subscribe signup contact-form register poll survey-form".split(),
    "comment": "comments comment-list comment discussion responses replies reviews thread reader-comments disqus_thread feedback respond".split(),
    "share": "share social share-bar social-links follow-us sharing toolbar tools".split(),
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "notice": "dialog"}
SYLLABLES = "ka lo mi ren tu sha vel or in dra pe ston qui ba lef ur ma te gno".split()


class Layout:
    """One page's choices: random ones of a seed, with paragraphs taken from texts or made up."""

    def __init__(self, seed: int, texts: list[str]):
        self.r = random.Random(seed)
        self.texts = texts if texts and self.r.random() < 0.8 else []

    def words(self, n: int) -> str:
        made = ["".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(max(n, 1))]
        out, left = [], 0
        for w in made:
            out.append(w if left else w.capitalize())
            left = left or self.r.randint(3, 14)
            left -= 1
            if not left:
                out[-1] += self.r.choice([".", ".", ".", "?", "!"])
            elif self.r.random() < 0.08:
                out[-1] += ","
        return " ".join(out)

    def prose(self, most: int = 90) -> str:
        n = min(self.r.randint(1, 12) if self.r.random() < 0.3 else int(self.r.expovariate(1 / 35)) + 4, most)
        if self.texts and self.r.random() < 0.7:
            taken = self.r.choice(self.texts).split()
            start = 0 if self.r.random() < 0.7 else self.r.randrange(len(taken))
            return " ".join(taken[start : start + (n if len(taken) > most or self.r.random() < 0.3 else most)])
        return self.words(n)

    def text(self, main: bool, most: int = 90) -> str:
        return (MARK if main else "") + self.inline(html.escape(self.prose(most)))

    def inline(self, text: str) -> str:
        """text with some words in inline elements, links among them."""
        if self.r.random() < 0.75:
            return text
        words = text.split(" ")
        k = self.r.randrange(len(words))
        kind = self.r.choice(["a href='/x'", "b", "em", "strong", "span class='hl'", "code", "i"])
        words[k] = f"<{kind}>{words[k]}" + ("" if kind == "b" and self.r.random() < 0.2 else f"</{kind.split()[0]}>")
        return (" <br>" if self.r.random() < 0.1 else " ").join(words)

    def named(self, names: list[str], chance: float = 0.9) -> str:
        """Attributes that name a part, mixed with those that say nothing."""
        out = ""
        if self.r.random() < chance:
            name = self.r.choice(names)
            kind = self.r.choice(["class", "class", "class", "id"])
            more = f" {self.r.choice(NEUTRAL)}" if kind == "class" and self.r.random() < 0.3 else ""
            out = f' {kind}="{name}{more}"'
        if self.r.random() < 0.1:
            out += ' data-x="1"'
        return out

    def part(self, kind: str, inner: str) -> str:
        """A part of this kind around inner: an element that says so, or a neutral one with a name."""
        tag = TAGS.get(kind)
        if tag and self.r.random() < 0.5:
            return f"<{tag}{self.named(PARTS[kind], 0.5)}>{inner}</{tag}>"
        tag = self.r.choice(["div", "div", "div", "section", "ul" if "<li" in inner[:4] else "div"])
        return f"<{tag}{self.named(PARTS[kind], 1)}>{inner}</{tag}>"

    def links(self, most: int = 10) -> str:
        items = [f'<a href="/{k}">{html.escape(self.prose(self.r.randint(1, 7)))}</a>' for k in range(self.r.randint(2, most))]
        shape = self.r.random()
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if shape < 0.8 else " ").join(items)

    def boilerplate(self, kind: str) -> str:
        r, p = self.r, lambda most=40: f"<p>{self.text(False, most)}</p>"
        if kind == "nav" or kind == "share":
            return self.part(kind, self.links(12))
        if kind == "header":
            title = r.choice(["<h1>{}</h1>", '<a href="/">{}</a>', "<div>{}</div>", "<p>{}</p>"]).format(html.escape(self.prose(5)))
            return self.part(kind, title + (p(12) if r.random() < 0.4 else "") + (self.boilerplate("nav") if r.random() < 0.6 else ""))
        if kind == "footer":
            line = f"&copy; {r.randint(1995, 2030)} {html.escape(self.prose(20))}"
            return self.part(kind, r.choice([line, f"<p>{line}</p>", line + self.links(), self.links() + f"<div>{line}</div>", line + p(60)]))
        if kind == "aside":
            boxes = [f"<h3>{html.escape(self.prose(5))}</h3>" + r.choice([self.links(8), p(60), p(25) + p(25), self.links(4) + p(20)]) for _ in range(r.randint(1, 4))]
            return self.part(kind, "".join(boxes))
        if kind == "notice":
            return self.part(kind, r.choice([self.text(False, 50), p(60), p(30) + p(30)]) + r.choice(["", "<button>OK</button>", '<a href="#">X</a>', f"<button>{self.prose(3)}</button>"]))
        if kind == "advert":
            return self.part(kind, r.choice([self.text(False, 25), p(50), f'<a href="/ad">{self.prose(8)}</a>', f"<h4>{self.prose(6)}</h4>" + p(30), p(30) + p(40)]))
        if kind == "form":
            fields = "".join(f"<label>{html.escape(self.prose(4))}</label><input name=x>" for _ in range(r.randint(1, 4)))
            return self.part(kind, r.choice(["", p(40), f"<h3>{self.prose(6)}</h3>"]) + fields + r.choice(["<button>Go</button>", "<textarea>x</textarea>", "<select><option>a</select>"]))
        posts = []
        for _ in range(r.randint(1, 8)):
            by = f"<{r.choice(['b', 'span', 'div', 'cite', 'h4'])}>{html.escape(self.prose(3))}"
            tag = r.choice(["li", "div", "article"])
            says = "".join(p(90) for _ in range(r.randint(1, 3))) if r.random() < 0.8 else self.text(False)
            posts.append(f"<{tag}{self.named(['comment', 'comment-body', 'reply', 'post', 'review', 'item'], 0.6)}>{by}</{by.split('>')[0][1:]}>{says}</{tag}>")
        return self.part("comment", (f"<h2>{r.randint(1, 99)} {self.prose(2)}</h2>" if r.random() < 0.6 else "") + "".join(posts) + (self.boilerplate("form") if r.random() < 0.3 else ""))

    def article(self) -> str:
        """The main text in its element, with what sites put between."""
        r = self.r
        shape = r.choice(["p", "p", "p", "p", "div", "br", "open p"])
        count, out = 1 + min(int(r.expovariate(1 / 8)), 40), []
        between = r.choice([0, 0, 0, 0.05, 0.15])
        for _ in range(count):
            kind, say = r.random(), lambda most=90: self.text(True, most)
            if kind < 0.8:
                out.append({"p": "<p>{}</p>", "div": "<div>{}</div>", "br": "{}<br><br>", "open p": "<p>{}"}[shape].format(say()))
            elif kind < 0.87:
                out.append("<h{0}>{1}</h{0}>".format(r.randint(2, 4), say(8)))
            elif kind < 0.92:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{say(15)}" + r.choice(["", "</li>"]) for _ in range(r.randint(1, 7))) + f"</{tag}>")
            elif kind < 0.95:
                out.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(say())}</blockquote>")
            elif kind < 0.98:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{say(4)}</td>" for _ in range(r.randint(2, 4))) + "</tr>" for _ in range(r.randint(1, 5))) + "</table>")
            else:
                out.append(f"<figure><img src=x><figcaption>{say(12)}</figcaption></figure>")
            if r.random() < between:
                out.append(self.boilerplate(r.choice(["advert", "advert", "share", "aside", "notice", "form", "nav"])))
        head = ""
        if r.random() < 0.85:
            head = f"<h1>{self.text(True, 12)}</h1>"
            if r.random() < 0.3:
                head += f"<{r.choice(['p', 'div', 'time'])} class=\"{r.choice(['byline', 'meta', 'date', 'author'])}\">{self.text(True, 6)}</p>"
            if r.random() < 0.15:
                head = f"<header>{head}</header>"
        tail = "".join(self.boilerplate(k) for k, c in (("share", 0.12), ("comment", 0.15), ("nav", 0.06), ("footer", 0.06), ("aside", 0.06), ("form", 0.06)) if r.random() < c)
        text = head + "".join(out) + tail
        for _ in range(r.choice([0, 1, 1, 1, 2])):
            tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
            names = self.named(MAIN, 0.3 if tag in ("article", "main") else 0.7)
            text = f"<table><tr><td{names}>{text}</td></tr></table>" if tag == "td" else f"<{tag}{names}>{text}</{tag}>"
        return text

    def page(self) -> str:
        r = self.r
        before = [k for k, c in (("header", 0.5), ("nav", 0.65), ("notice", 0.3), ("advert", 0.35), ("form", 0.15), ("aside", 0.15), ("nav", 0.15)) if r.random() < c]
        after = [k for k, c in (("share", 0.15), ("comment", 0.4), ("aside", 0.4), ("advert", 0.25), ("form", 0.2), ("notice", 0.15), ("nav", 0.2)) if r.random() < c]
        r.shuffle(after)
        if r.random() < 0.08:
            before = after = []
        around = [*(self.boilerplate(k) for k in before), self.article() if r.random() < 0.95 else "", *(self.boilerplate(k) for k in after)]
        if r.random() < 0.5:  # some neighbours share a wrapper, of whatever name
            a, b = sorted((r.randint(0, len(around)), r.randint(0, len(around))))
            names = self.named([*NEUTRAL, "content-wrap", "has-sidebar", "content-sidebar", "with-ads", "main-wrapper", "site-content"], 0.9)
            around[a:b] = [f"<div{names}>{''.join(around[a:b])}</div>"]
        if before and r.random() < 0.75:
            around.append(self.boilerplate("footer"))
        for _ in range(r.choice([0, 0, 1, 2])):
            around = [f"<div{self.named(NEUTRAL)}>", *around, "</div>"]
        start = f"<!DOCTYPE html><html><head><title>{html.escape(self.prose(6))}</title><script>var a='</p>';</script><style>p{{}}</style></head><body>"
        return (start if r.random() < 0.9 else "") + "".join(around) + ("</body></html>" if r.random() < 0.8 else "")


def page(seed: int, texts: list[str]) -> str:
    """A page of main text and what pages have around it, its paragraphs taken from texts where there are any."""
    return Layout(seed, texts).page()
