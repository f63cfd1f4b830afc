"""Generated web pages whose main text is marked, to train and test extraction."""

from __future__ import annotations

import random

#: Leads every piece of main text in a generated page.
MARK = ""

_SYLLABLES = "an be co da en fi go hu in jo ka le mi no or pa qui re so ta un ve wo xi ya zu ment tion ing ung lich eau ción".split()
#: Names that pages give to their parts.
_NAMES = {
    "menu": "nav menu navigation navbar main-menu topnav site-nav links tabs navlist".split(),
    "header": "header masthead site-header top banner branding page-header topbar".split(),
    "footer": "footer site-footer bottom colophon page-footer foot legal copyright".split(),
    "sidebar": "sidebar side widget widget-area rail secondary right-column sidebar-left aside".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot banner-ad adsbox commercial".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert privacy-notice popup overlay modal disclaimer".split(),
    "comments": "comments comment-list commentlist discussion responses replies disqus respond reader-comments".split(),
    "comment": "comment comment-body reply comment-content response".split(),
    "related": "related related-posts more-stories recommended read-more see-also trending popular".split(),
    "share": "share social sharing share-buttons social-links follow".split(),
    "letter": "newsletter subscribe signup mailing login search search-form contact-form".split(),
    "crumbs": "breadcrumb breadcrumbs crumbs path".split(),
    "byline": "byline meta author post-meta date published entry-meta tags category".split(),
    "main": "content main-content article-body post-content entry-content story post entry article text body-copy page-content".split(),
}
_PHRASES = "Home About Contact Archive Privacy Terms Login Register Next Previous Menu Search Help News Sports Politik Startseite Accueil Inicio Contacto Impressum".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(200)]
        self.named = rng.random() < 0.8  # whether parts have names at all

    def phrase(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(lo, hi)))

    def sentence(self) -> str:
        s = self.phrase(4, 16)
        if self.r.random() < 0.3:
            s = s.replace(" ", ", ", 1)
        return s[0].upper() + s[1:] + self.r.choice("....!?")

    def prose(self, lo: int, hi: int) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))
        return out.replace(" ", self.r.choice([" ", "\n", " &amp; "]), 1)

    def name(self, kind: str) -> str:
        if not self.named or self.r.random() < 0.1:
            return ""
        v = self.r.choice(_NAMES[kind])
        if self.r.random() < 0.3:
            v = v.title().replace("-", "")
            v = v[0].lower() + v[1:]
        extra = f" {self.r.choice(self.words)}" if self.r.random() < 0.2 else ""
        return f' {self.r.choice(["class", "class", "id"])}="{v}{extra}"'

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{text}</a>'

    def label(self) -> str:
        return self.r.choice(_PHRASES) if self.r.random() < 0.4 else self.phrase(1, 3)

    def box(self, kind: str, inside: str, *tags: str) -> str:
        tag = self.r.choice(tags or ("div",))
        return f"<{tag}{self.name(kind)}>{inside}</{tag}>"

    def menu(self, lo=3, hi=9) -> str:
        items = [self.link(self.label()) for _ in range(self.r.randint(lo, hi))]
        how = self.r.random()
        if how < 0.6:
            return "<ul>" + "".join(f"<li>{x}{'</li>' if self.r.random() < 0.8 else ''}" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items) if how < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def rest(self, kind: str) -> str:
        """A part that is not main text."""
        r = self.r
        if kind == "menu":
            return self.box(kind, self.menu(), "nav", "nav", "div")
        if kind == "header":
            return self.box(kind, f"<{r.choice(['h1', 'h2', 'div', 'p'])}>{self.label()}</{'h1'}>" + (f"<p>{self.phrase(3, 9)}</p>" if r.random() < 0.5 else "") + (self.menu() if r.random() < 0.5 else ""), "header", "header", "div")
        if kind == "footer":
            inside = r.choice([f"&copy; {self.label()}.example &middot; {self.prose(1, 3)}", f"<p>&copy; {r.randint(1999, 2026)} {self.label()}</p>{self.menu()}", self.menu() + f"<p>{self.prose(1, 2)}</p>", f"<div>Copyright {self.label()}. {self.sentence()}</div>"])
            return self.box(kind, inside, "footer", "footer", "div")
        if kind == "sidebar":
            inside = "".join(r.choice([f"<h3>{self.label()}</h3>{self.menu()}", f"<h4>{self.label()}</h4><p>{self.prose(1, 3)}</p>", f"<div>{self.prose(1, 2)}</div>"]) for _ in range(r.randint(1, 4)))
            return self.box(kind, inside, "aside", "aside", "div", "section")
        if kind == "ad":
            return r.choice(["", f"<!-- ad {r.randint(0, 99)} -->"]) + self.box(kind, r.choice([self.prose(1, 3), self.link(self.prose(1, 1)), f"<p>{self.prose(1, 2)}</p>"]), "div", "div", "aside", "section")
        if kind == "notice":
            return self.box(kind, f"<p>{self.prose(1, 3)}</p><button>{self.label()}</button>", "div", "div", "section", "aside", "dialog")
        if kind == "comments":
            one = lambda: self.box("comment", f"<cite>{self.label()}</cite> <p>{self.prose(1, 4)}</p>" + (self.link("Reply") if r.random() < 0.4 else ""), "div", "li", "article" if r.random() < 0.3 else "div")
            return self.box(kind, f"<h3>{r.randint(2, 40)} {self.label()}</h3>" + "".join(one() for _ in range(r.randint(1, 6))) + (self.rest("letter") if r.random() < 0.4 else ""), "section", "div", "div", "ol")
        if kind == "related":
            return self.box(kind, f"<h3>{self.label()}</h3>" + r.choice([self.menu(), "".join(f"<p>{self.link(self.phrase(3, 9))}</p>" for _ in range(3))]), "div", "section", "aside")
        if kind == "share":
            return self.box(kind, " ".join(self.link(x) for x in ("Facebook", "Twitter", "E-Mail", "Share")[: r.randint(2, 4)]))
        if kind == "letter":
            return f'<form{self.name(kind)}><label>{self.phrase(2, 6)}</label><input name="q"><p>{self.phrase(3, 9)}</p><button>{self.label()}</button></form>'
        if kind == "crumbs":
            return self.box(kind, " &gt; ".join(self.link(self.label()) for _ in range(3)), "div", "nav", "p")
        return self.box("byline", f"{self.label()} {r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 26)}", "div", "p", "span", "time")

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.9:
            t = f"{MARK}{self.sentence() if r.random() < 0.5 else self.phrase(3, 12)}"
            head = r.choice(["h1", "h1", "h1", "h2"])
            out.append(f"<{head}>{t}</{head}>" if r.random() < 0.85 else f"<header><{head}>{t}</{head}></header>")
        if r.random() < 0.3:
            out.append(self.rest("byline"))
        for _ in range(r.randint(1, 14)):
            how, text = r.random(), f"{MARK}{self.prose(1, 7)}"
            if r.random() < 0.08:  # tables in plain text, and noise
                text = text.replace(" ", r.choice([" | ", " | ", "### ", "$$$ ", " · "]))
            if r.random() < 0.25:
                cut = text.split(" ")
                k = r.randrange(len(cut))
                cut[k] = f"<{r.choice(['b', 'i', 'em', 'strong', 'span'])}>{cut[k]}</b>" if r.random() < 0.4 else self.link(cut[k])
                text = " ".join(cut)
            if how < 0.66:
                out.append(r.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text}</p>"]))
            elif how < 0.72:
                out.append(f"<h2>{MARK}{self.phrase(2, 7)}</h2>")
            elif how < 0.8:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.phrase(2, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif how < 0.85:
                out.append(f"<blockquote>{text}</blockquote>")
            elif how < 0.9:
                out.append(f"<div>{text}</div>")
            elif how < 0.93:
                out.append(f"<table><tr><td>{MARK}{self.phrase(1, 5)}</td><td>{MARK}{self.phrase(1, 5)}</td></tr></table>")
            else:
                out.append(f"<p>{MARK}{self.phrase(1, 5)}.</p>")
            if r.random() < 0.06:
                out.append(self.rest(r.choice(["ad", "related", "share", "letter", "sidebar"])))
        inside = "".join(out)
        wrap = r.random()
        if wrap < 0.55:
            inside = f"<article{self.name('main') if r.random() < 0.3 else ''}>{inside}</article>"
        elif wrap < 0.65:
            inside = f"<main>{inside}</main>"
        elif wrap < 0.95:
            inside = self.box("main", inside, "div", "div", "section")
        return f"<main>{inside}</main>" if r.random() < 0.1 else self.box("main", inside, "div", "section") if r.random() < 0.15 else inside

    def html(self) -> str:
        r = self.r
        before = [k for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.7), ("crumbs", 0.2), ("ad", 0.4), ("sidebar", 0.15)) if r.random() < p]
        after = [k for k, p in (("share", 0.2), ("related", 0.3), ("ad", 0.25), ("comments", 0.4), ("sidebar", 0.35), ("letter", 0.2), ("menu", 0.1), ("footer", 0.8), ("notice", 0.1)) if r.random() < p]
        body = "".join(map(self.rest, before)) + self.article() + "".join(map(self.rest, after))
        if r.random() < 0.2:
            body = f'<div id="{r.choice(["page", "wrapper", "container", "root"])}">{body}</div>'
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.label()}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        page = head + body + "</body></html>"
        return page[: -r.randint(1, 60)] if r.random() < 0.1 else page


def pages(n: int, seed: int) -> list[str]:
    """n pages, the same for equal seeds."""
    return [_Page(random.Random(seed * 1_000_003 + i)).html() for i in range(n)]
