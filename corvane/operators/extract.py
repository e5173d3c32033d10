"""Extractors: one document to many rows.

HTML, Markdown, CSS and scripts have no parser in Spark. Documents are parsed in
Arrow batches by functions over one text, and the extracted parts come back as
arrays, so everything after (links, checks, counts) is Spark again. The HTML
reader is an event parser without tree repair; the Markdown reader knows blocks
of code, code spans, links, images, HTML and directives.

Edge cases: null texts are read as empty ones; broken markup is read as far as it goes,
and what is never closed ends with the text; repeated rows are read one by one; texts
may have any length (style sheets have stated bounds, beyond which they are an error);
rows come back in their order, so ties don't arise; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.batches import each
from corvane.functions.canonical import FRAGMENT, READ_FRAGMENT, Denied, Unsafe, artefact_leak, built_url_problem, canonical, json_leak, leak, safe_url, source_leak

MAX_NESTING = 8
#: Bounds of a style sheet: characters, nesting, parts; and of style blocks and style attributes of a page.
MAX_CSS, MAX_CSS_DEPTH, MAX_CSS_PARTS = 1_000_000, 128, 20_000
MAX_STYLE_BLOCKS, MAX_INLINE_STYLES = 64, 10_000
#: Elements that end a run of text.
BLOCKS = frozenset(
    {
        "address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "dialog", "div", "dl", "dt",
        "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
        "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary",
        "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
    }
)
#: Attributes with URLs, attributes with readable text, metas whose contents readers see.
URL_ATTRIBUTES = frozenset({"action", "cite", "formaction", "href", "poster", "src"})
READABLE_ATTRIBUTES = frozenset({"alt", "aria-description", "aria-label", "aria-placeholder", "aria-roledescription", "aria-valuetext", "placeholder", "title"})
PUBLIC_METAS = frozenset({"author", "description", "og:description", "og:image:alt", "og:title", "twitter:description", "twitter:title"})
#: Media types of scripts; an empty type and `module` are scripts too.
SCRIPT_TYPES = frozenset(
    {
        "application/ecmascript", "application/javascript", "application/x-ecmascript", "application/x-javascript",
        "text/ecmascript", "text/javascript", "text/javascript1.0", "text/javascript1.1", "text/javascript1.2", "text/javascript1.3",
        "text/javascript1.4", "text/javascript1.5", "text/jscript", "text/livescript", "text/x-ecmascript", "text/x-javascript",
    }
)
HTML_SCHEMA = "text string, runs array<string>, readable array<string>, urls array<string>, srcdocs array<string>, styles array<string>, style_blocks array<string>, scripts array<string>, script_types array<string>, metas array<struct<name:string,content:string>>"
MARKDOWN_SCHEMA = "text string, links array<string>, images int, html int, directives array<string>, headings array<string>, residual array<string>"


_CODE_ATTRIBUTE = re.compile(r"\s(srcdoc|on[a-z]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: What a page with code or nested pages has somewhere.
_MAY_HOLD_CODE = re.compile(r"<(?:script|style)|\s(?:srcdoc|on[a-z]+)\s*=", re.I)


class _Ranges(HTMLParser):
    """Where style blocks, scripts, event handlers and nested pages stand in a page."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=True)
        self.coded = bool(_MAY_HOLD_CODE.search(text))
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))] if self.coded else []
        self.ranges: list[tuple[str, int, int]] = []
        self.open: tuple[str, int] | None = None

    def place(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self.coded:
            return
        source, at = self.get_starttag_text() or "", self.place()
        for m in _CODE_ATTRIBUTE.finditer(source):
            group = next(k for k in (2, 3, 4) if m[k] is not None)
            self.ranges.append(("srcdoc" if m[1].lower() == "srcdoc" else "handler", at + m.start(group), at + m.end(group)))
        if tag in ("script", "style"):
            self.open = (tag, at + len(source))

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.open[0] == tag:
            self.ranges.append(("script" if tag == "script" else "style", self.open[1], self.place()))
            self.open = None

    def code(self) -> list[tuple[str, int, int]]:
        return sorted(self.ranges, key=lambda r: r[1:])


class _Page(_Ranges):
    """The parts of a page, and where code stands in it if its text is given."""

    def __init__(self, text: str = "") -> None:
        super().__init__(text)
        self.out: dict[str, list] = {k: [] for k in ("runs", "readable", "urls", "srcdocs", "styles", "style_blocks", "scripts", "script_types", "metas")}
        self.run: list[str] = []
        self.inside: list[str] = []
        self.type = ""

    def end_run(self) -> None:
        if text := " ".join("".join(self.run).split()):
            self.out["runs"].append(text)
        self.run = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        if tag in BLOCKS:
            self.end_run()
        values = {k: v or "" for k, v in attrs}
        for k, v in values.items():
            if k in URL_ATTRIBUTES or k == "data" and tag == "object":
                self.out["urls"].append(v)
            elif k == "srcset":
                self.out["urls"] += [c.split()[0] for c in v.split(",") if c.split()]
            elif k in READABLE_ATTRIBUTES:
                self.out["readable"].append(v)
            elif k == "srcdoc":
                self.out["srcdocs"].append(v)
            elif k == "style":
                self.out["styles"].append(v)
            elif k.startswith("on"):
                self.out["scripts"].append(v)
                self.out["script_types"].append("")
        if tag == "meta":
            name = values.get("name") or values.get("property") or values.get("http-equiv")
            if name:
                self.out["metas"].append({"name": name, "content": values.get("content", "")})
            if "description" in values.get("itemprop", "").lower().split() and (name or "").lower() not in PUBLIC_METAS:
                self.out["metas"].append({"name": "description", "content": values.get("content", "")})
            if values.get("http-equiv", "").lower() == "refresh" and (m := re.search(r"url\s*=\s*['\"]?([^'\"\s]+)", values.get("content", ""), re.I)):
                self.out["urls"].append(m[1])
        if tag in ("script", "style", "template"):
            self.inside.append(tag)
            self.type = values.get("type", "")

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        if tag in BLOCKS:
            self.end_run()
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.inside and self.inside[-1] in ("script", "style"):
            if data.strip() and self.inside[-1] == "script":
                self.out["scripts"].append(data)
                self.out["script_types"].append(self.type)
            elif data.strip():
                self.out["style_blocks"].append(data)
        elif not self.inside:
            self.run.append(data)


    def read(self, text: str) -> dict[str, list]:
        self.feed(text)
        self.close()
        self.end_run()
        return self.out


def read_html(text: str) -> dict[str, object]:
    out = _Page().read(text)
    return {"text": " ".join(out["runs"]), **out}


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_LINK = re.compile(r"(?<!\\)(!?)\[((?:[^\[\]\\]|\\.)*)\]\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_AUTO = re.compile(r"<([a-z][a-z0-9+.-]{1,31}:[^\s<>]*)>", re.I)
_TAG = re.compile(r"<(?:/?[a-z][a-z0-9-]*(?:\s[^<>]*)?/?|!--.*?--|!\w[^>]*|\?.*?\?)>", re.I | re.S)
_NAME = re.compile(r"[a-z][a-z0-9-]*", re.I | re.A)
_LABEL = re.compile(r"\[[^\]\r\n]*\]")
_ATTRIBUTES = re.compile(r"\{[^{}\r\n]*\}")
#: Marks of the start and the end of a code span; characters of the private use area, which texts that hold them already lose.
CODE_START, CODE_END = "\ue002", "\ue003"


def directive_places(text: str, code_ends: frozenset[int] = frozenset()) -> list[tuple[int, int]]:
    """(start, end) of directive syntax: up to three colons, a name, a label and attributes.

    One colon needs a label; more need a label, attributes, or to stand at the start of a line or right after code
    (code_ends: where code spans end). Nothing after a backslash or a further colon is a directive.
    """
    out, at = [], 0
    while (at := text.find(":", at)) >= 0:
        stop = at
        while text[stop : stop + 1] == ":":
            stop += 1
        colons, before = stop - at, text[at - 1 : at]
        name = _NAME.match(text, stop)
        if not name:
            at = stop
            continue
        end = name.end()
        label = _LABEL.match(text, end)
        end = label.end() if label else end
        attributes = _ATTRIBUTES.match(text, end)
        end = attributes.end() if attributes else end
        free = before in ("", "\n", "\r") or at in code_ends
        if colons <= 3 and before != "\\" and (label or colons > 1 and (attributes or free)):
            out.append((at, end))
        at = end
    return out


def directives(text: str) -> list[str]:
    """The directives of a text without code, as written."""
    return [text[a:b] for a, b in directive_places(text)]


def _spans(marked: str) -> tuple[str, list[tuple[int, int]]]:
    """The text without code marks, and where in it the code spans lie."""
    out, spans, size, start = [], [], 0, 0
    for part in re.split(f"([{CODE_START}{CODE_END}])", marked):
        if part == CODE_START:
            start = size
        elif part == CODE_END:
            spans.append((start, size))
        else:
            out.append(part)
            size += len(part)
    return "".join(out), spans


def residual_directives(block: str) -> list[str]:
    """Directives of a paragraph or heading (its code spans between CODE_START and CODE_END) that don't lie within one span of code.

    The block is judged in canonical form. Decoding across a mark may make a directive that decoding with the marks in
    place doesn't show, so those of the text without marks count as well, unless they are the same ones.
    """
    text, spans = _spans(canonical(block))
    ends = frozenset(end for _, end in spans)
    places = directive_places(text, ends)
    out = [text[a:b] for a, b in places if not any(s <= a and b <= e for s, e in spans)]
    bare = canonical(block.replace(CODE_START, "").replace(CODE_END, ""))
    count = Counter(text[a:b].lower() for a, b in places)
    across = Counter(bare[a:b].lower() for a, b in directive_places(bare, ends))
    return out or sorted({*(across - count), *(count - across)})


def read_markdown(text: str) -> dict[str, object]:
    """Visible text (texts, code spans and code blocks, joined by spaces), link targets in order, and what isn't allowed."""
    kept: list[str] = []
    text = re.sub("[\ue000-\ue003]", "\ufffd", text)

    def hold(m: re.Match) -> str:
        if m.re is _FENCE:
            kept.append(m[2].strip("\n"))
            return f"\n\n\ue004{len(kept) - 1}\ue001\n\n"
        kept.append(re.sub(r"^ (.*\S.*) $", r"\1", m[2].replace("\n", " ")))
        return f"\ue000{len(kept) - 1}\ue001"

    body = _CODE.sub(hold, _FENCE.sub(hold, text))
    links, images = [], 0

    def link(m: re.Match) -> str:
        nonlocal images
        if m[1]:
            images += 1
            return " "
        links.append(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", m[3] if m[3] is not None else m[4]))
        return m[2]

    def auto(m: re.Match) -> str:
        links.append(m[1])
        return m[1]

    body = _AUTO.sub(auto, _LINK.sub(link, body))
    body, html = _TAG.subn(" ", body)
    blocks = _inline_blocks(body, kept)
    headings = [h.strip() for h in re.findall(r"^ {0,3}#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", body, re.M)]
    found = directives(body)
    body = re.sub(r"^ {0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d{1,9}[.)][ \t]+|(?:[-*_][ \t]*){3,}$)", "", body, flags=re.M)
    body = re.sub(r"(?<!\\)(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\1", r"\2", body)
    body = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", body)
    body = re.sub("[\ue000\ue004](\\d+)\ue001", lambda m: f" {kept[int(m[1])]} ", body)
    return {"text": " ".join(body.split()), "links": links, "images": images, "html": html, "directives": found, "headings": headings, "residual": blocks}


def _inline_blocks(body: str, kept: list[str]) -> list[str]:
    """Directives outside code in each paragraph and heading, whose emphasis marks are gone and whose code spans are marked."""
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n|\n(?= {0,3}#{1,6}[ \t])", body):
        block = re.sub(r"^ {0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d{1,9}[.)][ \t]+)", "", block.strip("\n"), flags=re.M)
        block = re.sub(r"(?<!\\)(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\1", r"\2", block.replace(CODE_START, "").replace(CODE_END, ""), flags=re.S)
        marked = re.sub("\ue000(\\d+)\ue001", lambda m: f"{CODE_START}{kept[int(m[1])]}{CODE_END}", block)
        if ":" in marked or "%" in marked or "&" in marked:
            try:
                out += residual_directives(marked)
            except Unsafe:
                pass  # a text without canonical form is reported as a leak
    return out


def reader_links(text: str, denied: Denied = Denied(), pages: tuple[str, ...] = ("prologue", "sources")) -> list[str]:
    """Link targets of a reader's Markdown in order, in canonical form; an unsafe one is an error."""
    return [safe_url(u, denied, pages) for u in read_markdown(text)["links"]]


_CSS_TOKEN = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)|[{}()\[\];:,]|[^\s{}()\[\];:,\"'/]+|/", re.S)
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_CSS_NO_NAMES = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", re.S)
_CSS_ESCAPE = re.compile(r"\\(?:([0-9a-f]{1,6})\s?|(.))", re.I | re.S)
_CSS_URL = re.compile(r"url\(\s*(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|([^)\s\"']*))\s*\)", re.I | re.S)
_CSS_IMPORT = re.compile(r"@import\s+(?:\"([^\"]*)\"|'([^']*)')", re.I)
_CSS_CONTENT = re.compile(r"(?:^|[;{])\s*content\s*:\s*([^;}]*)", re.I)
_CSS_STRING = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'", re.S)
_PSEUDO = re.compile(r"::?(?:before|after|marker|first-line|first-letter|placeholder|selection|backdrop)\b", re.I)


def check_css(text: str) -> None:
    """An error for a style sheet beyond the bounds: characters, nesting, and parts (words, strings and marks)."""
    if len(text) > MAX_CSS:
        raise Unsafe("style sheet too long")
    depth = parts = 0
    for m in _CSS_TOKEN.finditer(text):
        if m[0].startswith("/*"):
            continue
        parts += m[0] not in (";", ",", ":")
        depth += (m[0] in ("{", "(", "[")) - (m[0] in ("}", ")", "]"))
        if depth > MAX_CSS_DEPTH:
            raise Unsafe("style sheet nested too deep")
        if parts > MAX_CSS_PARTS:
            raise Unsafe("style sheet has too many parts")


def pseudo_ranges(text: str) -> list[tuple[int, int]]:
    """(start, end) of the colons and names of pseudo-elements outside comments and strings: no directives, though they look like some."""
    blank = _CSS_NO_NAMES.sub(lambda m: " " * len(m[0]), text)
    return [m.span() for m in _PSEUDO.finditer(blank)]


def _unescaped(string: str) -> str:
    """What a string or URL of a style sheet says."""

    def one(m: re.Match) -> str:
        if not m[1]:
            return m[2]
        return chr(int(m[1], 16)) if 0 < int(m[1], 16) <= 0x10FFFF else "\ufffd"

    return _CSS_ESCAPE.sub(one, string) if "\\" in string else string


def css_parts(text: str) -> dict[str, list[str]]:
    """URLs and strings of generated content in a style sheet; comments don't count, a sheet beyond the bounds is an error."""
    check_css(text)
    text = _CSS_COMMENT.sub(" ", text)
    urls = [_unescaped(m[1] or m[2] or m[3] or "") for m in _CSS_URL.finditer(text)]
    urls += [_unescaped(m[1] or m[2]) for m in _CSS_IMPORT.finditer(text)]
    content = []
    for rule in _CSS_CONTENT.finditer(text):
        strings = [_unescaped(m[1] if m[1] is not None else m[2]) for m in _CSS_STRING.finditer(rule[1])]
        if strings:
            content.append("".join(strings))
    return {"urls": urls, "content": content}


_SCRIPT_MARK = re.compile(r"//|/\*|[\"'`{}]")
_SCRIPT_ESCAPE = re.compile(r"\\(?:x([0-9a-f]{2})|u([0-9a-f]{4})|u\{([0-9a-f]{1,6})\}|(\r\n|.))", re.I | re.S)
_ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": "", "\u2028": "", "\u2029": ""}


def script_literal(source: str) -> str:
    """What the source of a literal says: its escapes and continued lines resolved."""

    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code is None:
            return _ESCAPED.get(m[4], m[4])
        return chr(int(code, 16)) if int(code, 16) <= 0x10FFFF and not 0xD800 <= int(code, 16) < 0xE000 else "\ufffd"

    return _SCRIPT_ESCAPE.sub(one, source) if "\\" in source else source


def _closing(text: str, at: int, mark: str) -> int:
    """Where a literal ends: at its mark, the end of the line (but for templates), or of the text; escaped characters don't count."""
    while at < len(text) and text[at] != mark and (mark == "`" or text[at] != "\n"):
        if mark == "`" and text.startswith("${", at):
            break
        at += 2 if text[at] == "\\" else 1
    return min(at, len(text))


def script_texts(text: str) -> list[str]:
    """String literals, chunks of templates (nested ones too) and comments of a script, as the language reads them."""
    out, at, open_braces = [], 0, [0]  # of the script, and of each expression within a template
    while m := _SCRIPT_MARK.search(text, at):
        mark, at = m[0], m.end()
        if mark in ("//", "/*"):
            end = text.find("\n" if mark == "//" else "*/", at)
            end = len(text) if end < 0 else end
            out.append(text[at:end])
            at = end + (2 if mark == "/*" else 0)
        elif mark == "{":
            open_braces[-1] += 1
        elif mark == "}" and not (len(open_braces) > 1 and open_braces[-1] == 0):
            open_braces[-1] -= 1
        else:
            if mark == "}":  # the end of an expression: its template goes on
                open_braces.pop()
                mark = "`"
            end = _closing(text, at, mark)
            out.append(script_literal(text[at:end]))
            at = end + 1
            if mark == "`" and text.startswith("${", end):
                open_braces.append(0)
                at = end + 2
    return out


def rendered_texts(text: str) -> list[str]:
    """Text between the tags of JSX or of a template, without its expressions."""
    bare = re.sub(r"\{[^{}]*\}", "\n", text)
    return [t for m in re.finditer(r">([^<>{}]+)<", bare) if (t := " ".join(m[1].split()))]


def script_kind(media_type: str | None) -> str:
    """javascript, json or inert, by the type of a script element."""
    name = (media_type or "").strip().lower()
    essence = name.split(";", 1)[0].strip()
    if name in ("", "module") or essence in SCRIPT_TYPES:
        return "javascript"
    return "json" if name in ("importmap", "speculationrules") or essence == "application/json" or essence.endswith("+json") else "inert"


def script_leaks(text: str, media_type: str | None, denied: Denied, jsx: bool = False) -> list[str]:
    """Problems of an embedded script: of its strings and comments (and rendered texts), its JSON values, or its text, by its type."""
    kind = script_kind(media_type)
    if kind == "json":
        return [p] if (p := json_leak(text, denied)) else []
    texts = [text] if kind == "inert" else [*script_texts(text), *(rendered_texts(text) if jsx else [])]
    return [p for t in texts if (p := leak(t, denied, FRAGMENT))]


def masked(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text with the characters of these ranges blank."""
    out, at = [], 0
    for a, b in sorted(ranges):
        if b > at:
            out += [text[at : max(at, a)], " " * (b - max(at, a))]
            at = b
    return "".join([*out, text[at:]])


def template_leaks(text: str, denied: Denied) -> list[str]:
    """Problems of a component template: of its whole text, of its script, and of what it shows."""
    parts = template_parts(text)
    found = [source_leak(text, denied, schemes=False), *script_leaks(str(parts["script"]), None, denied)]
    found += [leak(t, denied, READ_FRAGMENT) for k in ("runs", "readable") for t in parts[k]]
    found += [p for t, kind in zip(parts["scripts"], parts["script_types"]) for p in script_leaks(t, kind, denied)]
    return [p for p in found if p]


def template_parts(text: str) -> dict[str, object]:
    """A component template: the script between its first --- lines, and the rest read as HTML without its expressions."""
    m = re.match(r"\s*---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text, re.S)
    body = text[m.end() :] if m else text
    return {"script": m[1] if m else "", **read_html(re.sub(r"\{[^{}]*\}", " ", body))}


def html_ranges(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in characters of what is code or a nested page, in order: style, script, handler, srcdoc."""
    reader = _Ranges(text)
    if reader.coded:
        reader.feed(text)
        reader.close()
    return reader.code()


def page_leak(text: str, denied: Denied, code: Callable[[], list[tuple[str, int, int]]] | None = None) -> str | None:
    """The first leak in a page as it stands: comments, all attributes, templates, styles and scripts too.

    Schemes count outside code and nested pages, directives outside the names of pseudo-elements. code gives the
    html_ranges() of the text, if they are known.
    """
    if (found := artefact_leak(text, denied)) not in ("raw directive", "dangerous scheme"):
        return found
    places = html_ranges(text) if code is None else code()
    if not places:
        return found
    pseudo = [(a + x, a + y) for kind, a, b in places if kind == "style" for x, y in pseudo_ranges(text[a:b])]
    return artefact_leak(text, denied, directives=masked(text, pseudo), schemes=masked(text, [(a, b) for _, a, b in places]))


def scan_html(text: str, denied: Denied, nesting: int = 0, page_path: str = "") -> list[tuple[str, str]]:
    """(where, problem) of a page: its whole text, its text runs, readable attributes, public metas, links, styles, scripts and nested pages.

    Relative links start from page_path, the page's place in its site; without one the page lies at the root.
    """
    if nesting > MAX_NESTING:
        return [("srcdoc", "nested too deep")]
    reader = _Page(text)
    page = reader.read(text)
    out = [("text", p)] if (p := page_leak(text, denied, reader.code)) else []
    out += [(where, p) for where in ("runs", "readable") for t in page[where] if (p := leak(t, denied, READ_FRAGMENT))]
    out += [("metas", p) for m in page["metas"] if m["name"].lower() in PUBLIC_METAS and (p := leak(m["content"], denied))]
    out += [("urls", p) for u in page["urls"] if (p := built_url_problem(u, page_path, denied))]
    if len(page["style_blocks"]) > MAX_STYLE_BLOCKS or len(page["styles"]) > MAX_INLINE_STYLES:
        return [*out, ("styles", "too many style blocks or attributes")]
    for css in [*page["styles"], *page["style_blocks"]]:
        try:
            out += [("styles", p) for t in css_parts(css)["content"] if (p := leak(t, denied, READ_FRAGMENT))]
        except Unsafe as e:
            out.append(("styles", str(e)))
    out += [("scripts", p) for text, kind in zip(page["scripts"], page["script_types"]) for p in script_leaks(text, kind, denied)]
    for inner in page["srcdocs"]:
        out += [(f"srcdoc.{where}", p) for where, p in scan_html(inner, denied, nesting + 1, page_path)]
    return out


def scan_markdown(text: str, denied: Denied) -> list[tuple[str, str]]:
    """(where, problem) of a reader's Markdown: no HTML, images or directives outside code, safe links, no leaks."""
    parts = read_markdown(text)
    out = [(k, "not allowed") for k in ("html", "images", "directives") if parts["residual" if k == "directives" else k]]
    for url in parts["links"]:
        try:
            safe_url(url, denied)
        except Unsafe as e:
            out.append(("links", str(e)))
    if p := leak(text, denied) or leak(str(parts["text"]), denied):
        out.append(("text", p))
    return out


def _udf(function: Callable[[str], dict], schema: str, names: list[str]):
    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(each(lambda t: function(t or ""), zip(texts)), columns=names)

    return run


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in re.sub(r"<[^<>]*(?:<[^<>]*>)?[^<>]*>", "", schema).split(", ")]


def html_parts(text: Column) -> Column:
    return _udf(read_html, HTML_SCHEMA, _names(HTML_SCHEMA))(text)


def markdown_parts(text: Column) -> Column:
    return _udf(read_markdown, MARKDOWN_SCHEMA, _names(MARKDOWN_SCHEMA))(text)


def style_parts(text: Column) -> Column:
    def safe(t: str) -> dict:
        try:
            return {**css_parts(t), "error": None}
        except Unsafe as e:
            return {"urls": [], "content": [], "error": str(e)}

    return _udf(safe, "urls array<string>, content array<string>, error string", ["urls", "content", "error"])(text)


def ranges(text: Column) -> Column:
    """array<struct<kind, start, end>> of html_ranges()."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(each(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in html_ranges(t or "")], zip(texts)), dtype=object)

    return run(text)


def residual(text: Column) -> Column:
    """Directives of a reader's Markdown outside code."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(each(lambda t: read_markdown(t or "")["residual"], zip(texts)), dtype=object)

    return run(text)


def problems(text: Column, denied: Denied, kind: str, page: Column | None = None) -> Column:
    """array<struct<where, problem>> of a page (html), whose place in its site may be given, or an entry (markdown)."""
    scan = {"html": lambda t, p: scan_html(t, denied, page_path=p), "markdown": lambda t, p: scan_markdown(t, denied)}[kind]

    @F.pandas_udf("array<struct<where:string,problem:string>>")
    def run(texts: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series(each(lambda t, p: [{"where": w, "problem": x} for w, x in scan(t or "", p or "")], zip(texts, pages)), dtype=object)

    return run(text, F.lit("") if page is None else page)
