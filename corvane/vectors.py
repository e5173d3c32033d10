"""Registered queries that apply the text and path functions to vectors: each row of `part` takes one of a list of inputs.

A vector is (input, expected values...); {n} in either stands for the row's key,
so every row is judged by itself. The SQL of a query says what is expected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import batches, canonical, paths
from corvane.functions import text as T
from corvane.operators import extract

#: What must not leak in these queries.
DENIED = canonical.Denied(organisation="acme", repository="vault", roots=("drafts", "notes-raw"))
CONTROL, OFTEN = "control or format character", "encoded more often than allowed"
COORDINATE, IDENTIFIER, PATH, DIRECTIVE, SCHEME = "repository coordinate", "internal identifier", "local path", "raw directive", "dangerous scheme"
NESTED = "%25" + "25" * 11 + "41"
LINKS = ("prologue", "sources")


@dataclass(frozen=True)
class Vectors:
    columns: tuple[str, ...]
    rows: list[tuple]
    apply: Callable[[Column], list[Column]]
    kinds: tuple[str, ...] = ()

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        batches.small_batches(spark)
        part = batches.dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"))
        value = F.element_at(F.array(*[F.lit(r[0]) for r in self.rows]), (F.pmod("p_partkey", F.lit(len(self.rows))) + 1).cast("int"))
        given = part.select("p_partkey", F.replace(value, F.lit("{n}"), F.col("p_partkey").cast("string")).alias("v"))
        return given.select("p_partkey", *[c.alias(n) for c, n in zip(self.apply(F.col("v")), self.columns)])

    def sql(self) -> str:
        kinds = self.kinds or ("VARCHAR",) * len(self.columns)

        def literal(x: object) -> str:
            if isinstance(x, str):
                return f"replace('{x.replace(chr(39), chr(39) * 2)}', '{{n}}', p_partkey::VARCHAR)"
            return "NULL" if x is None else str(x).lower()

        cases = (f"CASE p_partkey % {len(self.rows)} " + " ".join(f"WHEN {k} THEN {literal(r[c])}" for k, r in enumerate(self.rows)) + " END" for c in range(1, len(self.columns) + 1))
        return "SELECT p_partkey, " + ", ".join(f"({c})::{kind} AS {n}" for c, kind, n in zip(cases, kinds, self.columns)) + " FROM part"


def _canonical(v: Column) -> list[Column]:
    c = canonical.canonical_text(v)
    return [c["value"], c["error"]]


def _tolerant(v: Column) -> list[Column]:
    c = canonical.tolerant_text(v)
    return [c["value"], c["excessive"], c["error"]]


def _checked(v: Column) -> list[Column]:
    c = canonical.checked_url(v, DENIED, LINKS)
    return [c["value"], c["error"]]


def _variants(v: Column) -> list[Column]:
    own = canonical.judged
    return [
        canonical.leak_of(v, DENIED),
        canonical.leak_of(v, DENIED, canonical.FRAGMENT),
        own(lambda t: canonical.artefact_leak(t, DENIED), v),
        own(lambda t: canonical.artefact_leak(t, DENIED, strict=False), v),
        own(lambda t: canonical.source_leak(t, DENIED, private=False), v),
    ]


def _markdown(v: Column) -> list[Column]:
    p = extract.markdown_parts(v)
    return [p["text"], F.array_join(p["links"], " "), F.array_join(p["residual"], " "), F.array_join(p["directives"], " ")]


def _html(v: Column) -> list[Column]:
    p, r = extract.html_parts(v), extract.ranges(v)
    at = lambda x: F.concat_ws(" ", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return [F.array_join(p["runs"], "|"), F.array_join(p["readable"], "|"), F.array_join(p["urls"], "|"), F.array_join(F.transform(r, at), ",")]


def _problems(kind: str) -> Callable[[Column], list[Column]]:
    def run(v: Column) -> list[Column]:
        found = extract.problems(v, DENIED, kind, F.lit("en/a.html") if kind == "html" else None)
        return [F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: F.concat_ws(": ", p["where"], p["problem"])))), ", ")]

    return run


def _css(v: Column) -> list[Column]:
    c = extract.style_parts(v)
    text = lambda t: ",".join(f"{a}-{b}" for a, b in extract.pseudo_ranges(t))
    return [F.array_join(c["urls"], " "), F.array_join(c["content"], "|"), c["error"], canonical.judged(text, v)]


def _script(v: Column) -> list[Column]:
    kind, body = F.substring_index(v, "|", 1), F.substr(v, F.length(F.substring_index(v, "|", 1)) + 2)
    named = F.when(kind != "", kind)
    return [
        canonical.judged(lambda b, k: extract.script_kind(k), body, named),
        canonical.judged(lambda b, k: ", ".join(extract.script_leaks(b, k, DENIED, jsx=True)), body, named),
    ]


VECTORS: dict[str, Vectors] = {
    # F27 to F30: folding, entities and percent codes to a fixed point
    "canonical_vectors": Vectors(
        ("value", "error"),
        [
            ("a%2Fb{n}", "a/b{n}", None),
            ("a%252Fb{n}", "a/b{n}", None),
            ("a&sol;b&bsol;c{n}", "a/b\\c{n}", None),
            ("&#x41;&#66;&num;&colon;{n}", "AB#:{n}", None),
            ("ａ‑ｂ⁄ｃ∖{n}", "a-b/c\\{n}", None),
            ("a+b%2B&plus;{n}", "a+b+&plus;{n}", None),
            ("%ff{n}", None, "percent encoding isn't UTF-8: %ff"),
            ("&#1114112;{n}", None, "entity out of range: &#1114112;"),
            ("&#xD800;{n}", None, "entity out of range: &#xD800;"),
            ("a\u202eb{n}", None, CONTROL),
            ("%E2%80%8B{n}", None, CONTROL),
            (NESTED + "{n}", None, OFTEN),
            ("&amp;percnt;&percnt;41{n}", "&amp;percnt;A{n}", None),
            ("plain {n}\tline\n", "plain {n}\tline\n", None),
        ],
        _canonical,
    ),
    # F31
    "tolerant_vectors": Vectors(
        ("value", "excessive", "error"),
        [
            ("%ff%2F{n}", "%ff%2F{n}", False, None),
            ("%ff-%2F{n}", "%ff-/{n}", False, None),
            ("&#1114112;&sol;{n}", "&#1114112;/{n}", False, None),
            ("a\u202eb{n}", None, None, CONTROL),
            ("%C2%AD{n}", None, None, CONTROL),
            ("a%07b{n}", "a\x07b{n}", False, None),
            ("%25" + "25" * 8 + "41{n}", "%2541{n}", True, None),
            ("%25" + "25" * 6 + "41{n}", "A{n}", False, None),
            ("ｘ⧵{n}", "x\\{n}", False, None),
        ],
        _tolerant,
        ("VARCHAR", "BOOLEAN", "VARCHAR"),
    ),
    # F32
    "mixed_paths": Vectors(
        ("resolved",),
        [("a\\b/../c{n}", "a/c{n}"), ("/a/./b//c{n}", "/a/b/c{n}"), ("//host/x/../y{n}", "//host/y{n}"), ("C:\\u\\..\\v{n}", "C:/v{n}"), ("../x{n}/", "../x{n}"), ("a/../../b{n}", "../b{n}"), ("", ""), ("{n}/..", "")],
        lambda v: [paths.resolve_segments(v)],
    ),
    # F33, F35, F36
    "leak_vectors": Vectors(
        ("leak",),
        [
            ("see acme/vault/x{n}", COORDINATE),
            ("acme%2F.%2Fvault", COORDINATE),
            ("acme\\x\\..\\vault.git {n}", COORDINATE),
            ("acme⁄vault {n}", COORDINATE),
            ("acme/vaults{n} xacme/vault", None),
            ("the object-ring{n}", IDENTIFIER),
            ("interl&percnt;75de&hyphen;q{n}", IDENTIFIER),
            ("an object {n}", None),
            ("in /home/me/x{n}", PATH),
            ("C:\\x{n} and", PATH),
            ("drafts/a{n}", PATH),
            ("see drafts/ {n}", PATH),
            ("x=~/a{n}", PATH),
            ("//host/share{n}", PATH),
            ("https://example.org/home/me/{n}", None),
            ("https://example.org/x?file=drafts%252Fc{n}", PATH),
            ("and/or {n} 1/2", None),
            ("a\u200bb{n}", CONTROL),
            ("%fe{n}", "percent encoding isn't UTF-8"),
        ],
        lambda v: [canonical.leak_of(v, DENIED)],
    ),
    # F34
    "url_remainders": Vectors(
        ("kept",),
        [("see https://e.org/a?q={n}#f now", "see  ?q={n}#f  now"), ("HTTPS://E.org/home/x {n}", "   {n}"), ("http://e.org/a?q={n}", "http://e.org/a?q={n}"), ("none {n}", "none {n}"), ("https:// {n}", "https:// {n}")],
        lambda v: [canonical.judged(lambda t: canonical.URL.sub(canonical._query_and_fragment, t), v)],
    ),
    # the scans of prose, fragments, artefacts (strict and tolerant) and sources
    "sentinel_variants": Vectors(
        ("prose", "fragment", "strict", "lenient", "source"),
        [
            ("object-x{n}", IDENTIFIER, None, None, None, None),
            ("a ::{n} b: c", None, None, None, None, None),
            ("::note-{n}", None, DIRECTIVE, DIRECTIVE, DIRECTIVE, DIRECTIVE),
            (":a[b{n}]", None, DIRECTIVE, DIRECTIVE, DIRECTIVE, DIRECTIVE),
            ("java\tscript:{n}", None, SCHEME, SCHEME, SCHEME, SCHEME),
            ("acme/<!---->vault{n}", None, None, None, None, None),
            ("x<!--acme/vault--> {n}", None, None, COORDINATE, COORDINATE, None),
            ("/home/a/{n}", PATH, PATH, PATH, PATH, None),
            ("%ff acme/vault {n}", "percent encoding isn't UTF-8", "percent encoding isn't UTF-8", "percent encoding isn't UTF-8", COORDINATE, "percent encoding isn't UTF-8"),
            ("\x07{n}", CONTROL, CONTROL, CONTROL, None, CONTROL),
            ("%25" + "25" * 9 + "41{n}", OFTEN, OFTEN, OFTEN, OFTEN, OFTEN),
            ("calm {n}", None, None, None, None, None),
        ],
        _variants,
    ),
    # F41
    "safe_url_vectors": Vectors(
        ("value", "error"),
        [
            ("#%78-{n}", "#x-{n}", None),
            ("/book/med%69a/a-{n}/", "/book/media/a-{n}/", None),
            ("/book/objects/ring-{n}/#part-1", "/book/objects/ring-{n}/#part-1", None),
            ("/book/", "/book/", None),
            ("/book/sources/", "/book/sources/", None),
            ("/book//", None, "internal route"),
            ("/book/sources//", None, "internal route"),
            ("/book/objects/object-{n}/", None, "internal identifier"),
            ("/book/media/a..b{n}/", None, "internal route"),
            ("https://example.org/x?q={n}", "https://example.org/x?q={n}", None),
            ("http://example.org/{n}", None, PATH),
            ("https://u:p@example.org/{n}", None, "scheme, host or credentials"),
            ("https&#x3a;//e.org&sol;{n}", "https://e.org/{n}", None),
            ("https://example.org/a%20b{n}", None, "decoded control, blank or backslash"),
            ("https://example.org/%2{n}%", None, "control, blank, backslash or broken percent code"),
            ("#A{n}", None, "anchor"),
            ("/other/{n}", None, "scheme, host or credentials"),
            ("javascript:{n}", None, "scheme, host or credentials"),
        ],
        _checked,
    ),
    # F42
    "built_url_vectors": Vectors(
        ("problem",),
        [
            ("/a/../b{n}", None),
            ("../x{n}", None),
            ("../../x{n}", "leads out of the site"),
            ("~/../x{n}", "leads out of the site"),
            ("//h/x{n}", "network path"),
            ("java%73cript:{n}", SCHEME),
            ("data:text/html,{n}", SCHEME),
            ("mailto:a@b{n}", None),
            ("sms:{n}", None),
            ("ftp:{n}", None),
            ("#acme%2Fvault", COORDINATE),
            ("/drafts/{n}", PATH),
            ("a\\b{n}", "control, blank or backslash"),
            ("/a%20b{n}", "control, blank or backslash"),
            ("?q={n}", None),
            ("::box-{n}", DIRECTIVE),
            ("https://e.org/a{n}", None),
        ],
        lambda v: [canonical.judged(lambda u: canonical.built_url_problem(u, "en/a.html", DENIED), v)],
    ),
    # F43, F44
    "reference_vectors": Vectors(
        ("scan", "url_problem"),
        [
            ("/acme/vault", "private", "private reference"),
            ("/acme%2Fvault.git?x={n}", "private", "private reference"),
            ("/acme%255Cvault", "private", "private reference"),
            ("/ACME//vault", "private", "private reference"),
            ("/acme/vaults{n}", "safe", None),
            ("/acme/vault.github{n}", "safe", None),
            ("/xacme/vault{n}", "safe", None),
            ("/x%zz{n}", "invalid", "invalid reference"),
            ("/%ff{n}", "invalid", "invalid reference"),
            ("/100%25-{n}", "safe", None),
            ("/100%25", "safe", None),
            ("/" + NESTED + "{n}", "invalid", "invalid reference"),
        ],
        lambda v: [canonical.judged(lambda t: canonical.reference_scan(t, DENIED), v), canonical.judged(lambda t: canonical.public_url_problem(f"https://e.org{t}", DENIED), v)],
    ),
    "external_urls": Vectors(
        ("problem",),
        [("https://e.org/{n}", None), ("http://e.org/{n}", "not https"), ("https://u@e.org/{n}", "credentials"), ("https:///{n}", "not a URL"), ("{n}", "not a URL"), ("https://e.org:99999/{n}", "not a URL"), ("https://e.org/?r=acme%2Fvault", "private reference")],
        lambda v: [canonical.judged(lambda t: canonical.public_url_problem(t, DENIED), v)],
    ),
    # F46
    "path_leaks": Vectors(
        ("leak",),
        [("src/a{n}.md", None), ("acme/vault/{n}", COORDINATE), ("a/..%2Facme/vault{n}.md", None), ("drafts/{n}.md", PATH), ("a%5Cb{n}", "backslash"), ("a/::box-{n}", DIRECTIVE), ("a/data:{n}", SCHEME), ("a\u00adb{n}", CONTROL)],
        lambda v: [canonical.judged(lambda t: canonical.path_leak(t, DENIED), v)],
    ),
    # F51, F50
    "json_leaks": Vectors(
        ("leak",),
        [
            ('{"a": ["x{n}", {"b": "acme/vault"}]}', COORDINATE),
            ('{"acme\\u002fvault": {n}}', COORDINATE),
            ('{"a": 1, "\\u0061": {n}}', "repeated key"),
            ('{"a": {n}', "not JSON"),
            ('{"a": {n}, "b": ["fine", null, 1.5]}', None),
            ('["java\\nscript:{n}"]', SCHEME),
            ('"{n}"', None),
        ],
        lambda v: [canonical.judged(lambda t: canonical.json_leak(t, DENIED), v)],
    ),
    # nested values, key order, numbers
    "canonical_json_vectors": Vectors(
        ("value", "error"),
        [
            ('{"b":[1,2.0,{}],"a":"é","":[]}', '{\n  "": [],\n  "a": "é",\n  "b": [\n    1,\n    2,\n    {}\n  ]\n}\n', None),
            ('[{"y":{n},"x":null}]', '[\n  {\n    "x": null,\n    "y": {n}\n  }\n]\n', None),
            ('{"\ufffd":1,"\U00010000":2}', '{\n  "\U00010000": 2,\n  "\ufffd": 1\n}\n', None),
            ("[]", "[]\n", None),
            ('{"a":1,"a":2}', None, "repeated key"),
            ("[1e999]", None, "number isn't finite"),
            ("[NaN]", None, "number NaN"),
        ],
        lambda v: [canonical.canonical_json_text(v)["value"], canonical.canonical_json_text(v)["error"]],
    ),
    # F48
    "unit_indexes": Vectors(
        ("at_1", "at_3", "at_7", "at_8"),
        [("aé\U00010000b", 1, 2, 4, 5), ("abcdefghij", 1, 3, 7, 8), ("жжжж", 0, 1, 3, 4)],
        lambda v: [canonical.judged(lambda t, k=k: str(canonical.unit_index(t, k)), v).cast("int") for k in (1, 3, 7, 8)],
        ("INTEGER",) * 4,
    ),
    # bytes in hex
    "utf8_checks": Vectors(
        ("valid",),
        [("61", True), ("c3a9", True), ("ff", False), ("eda080", False), ("f4908080", False), ("", True), ("e282", False)],
        lambda v: [F.is_valid_utf8(F.unhex(v).cast("string"))],
        ("BOOLEAN",),
    ),
    # F14, F15
    "navigation": Vectors(
        ("section", "error_page", "active"),
        [("/site/history/", "history", False, False), ("/site/", "home", False, False), ("/site/404.html", "home", True, False), ("/en/404/", "home", True, False), ("/book/x{n}/", "home", False, True), ("/book", "home", False, True), ("/bookish/", "home", False, False)],
        lambda v: [paths.section_of(v, ("history", "material")), paths.is_error_route(v), paths.is_active(F.lit("/book/"), v)],
        ("VARCHAR", "BOOLEAN", "BOOLEAN"),
    ),
    # F21, F22, F23, F25
    "path_rules": Vectors(
        ("inside", "normal", "kind", "stem", "route"),
        [
            (f"{paths.CONTENT_ROOT}/entries/chapter-01.md", True, True, "entry", "chapter-01", None),
            (f"{paths.CONTENT_ROOT}/entries/chapter-1.md", True, True, None, "chapter-1", None),
            (f"{paths.CONTENT_ROOT}/objects/object-{{n}}.json", True, True, "object", "object-{n}", None),
            (f"{paths.IMAGE_ROOT}/a{{n}}.webp", True, True, "image", "a{n}", None),
            (f"{paths.IMAGE_ROOT}/a..b.svg", True, True, None, "a..b", None),
            ("../../a{n}", False, True, None, "a{n}", None),
            ("../a/..", False, False, None, ".", None),
            ("a/../b{n}", True, False, None, "b{n}", None),
            ("./a{n}", True, False, None, "a{n}", None),
            ("/../a{n}", False, False, None, "a{n}", None),
            ("a//b{n}", True, False, None, "b{n}", None),
            ("a%20{n}", True, False, None, "a%20{n}", None),
            ("C:\\x{n}", False, False, None, "C:\\x{n}", None),
            ("object-ring-{n}", True, True, None, "object-ring-{n}", "/book/objects/ring-{n}/"),
            ("media-x{n}", True, True, None, "media-x{n}", "/book/media/x{n}/"),
            ("note-{n}", True, True, None, "note-{n}", "#note-{n}"),
        ],
        lambda v: [paths.is_inside(v), paths.is_normal(v), paths.payload_kind(v), paths.stem(v), paths.route_of(v)],
        ("BOOLEAN", "BOOLEAN", "VARCHAR", "VARCHAR", "VARCHAR"),
    ),
    # A5: names that differ in normal form only
    "normal_forms": Vectors(
        ("nfc", "same"),
        [("e\u0301{n}", "é{n}", False), ("é{n}", "é{n}", True), ("\u1100\u1161", "\uac00", False), ("abc{n}", "abc{n}", True)],
        lambda v: [canonical.normalized(v), canonical.normalized(v) == v],
        ("VARCHAR", "BOOLEAN"),
    ),
    # D1, D2, D3, D5, D6, D7
    "markdown_vectors": Vectors(
        ("text", "links", "residual", "directives"),
        [
            ("# T{n}\n\nSee [a *b*](https://e.org/x_(y) \"t\").", "T{n} See a b.", "https://e.org/x_(y)", "", ""),
            ("`::map{id=\"m\"}` beside ::scale{of=\"s\"} {n}", '::map{id="m"} beside ::scale{of="s"} {n}', "", '::scale{of="s"}', '::scale{of="s"}'),
            ("Look, ::ch*art*{ref=\"{n}\"} there", 'Look, ::chart{ref="{n}"} there', "", '::chart{ref="{n}"}', ""),
            ("`:::aside` beside `:tip[z]` {n}", ":::aside beside :tip[z] {n}", "", "", ""),
            ("%3A%3Ahidden%5Btext%5D {n}", "%3A%3Ahidden%5Btext%5D {n}", "", "::hidden[text]", ""),
            ("```js\n::note{a}\n```\n\n<https://f.org/{n}>", "::note{a} https://f.org/{n}", "https://f.org/{n}", "", ""),
            ("Here \\::table{id=\"{n}\"} stays", 'Here ::table{id="{n}"} stays', "", "", ""),
            ("- one\n- *two* {n}\n\n> quote", "one two {n} quote", "", "", ""),
        ],
        _markdown,
    ),
    # D2 with canonical links, as a check
    "reader_links": Vectors(
        ("links",),
        [("[a](#%78-{n}) [b](/book/med%69a/x-{n}/)", "#x-{n} /book/media/x-{n}/"), ("[a](/other/)", "scheme, host or credentials"), ("none {n}", "")],
        lambda v: [canonical.judged(_links, v)],
    ),
    # D4
    "markdown_problems": Vectors(
        ("problems",),
        [
            ("fine [x](#a-{n})", ""),
            ("<b>x</b> {n}", "html: not allowed"),
            ("![i](j{n}.png)", "images: not allowed"),
            ("::box-{n}", "directives: not allowed"),
            ("[x](mailto:a@b{n})", "links: scheme, host or credentials"),
            ("acme/**vault** {n}", "text: repository coordinate"),
            ("`claim-{n}`", "text: internal identifier"),
        ],
        _problems("markdown"),
    ),
    # D8, D9
    "html_vectors": Vectors(
        ("runs", "readable", "urls", "ranges"),
        [
            ("<p>a<b>b</b><br>c{n}</p>", "ab|c{n}", "", "", ""),
            ('<img src="i{n}.png" srcset="j.png 2x, k.png" alt="t"><object data="o"></object>', "", "t", "i{n}.png|j.png|k.png|o", ""),
            ("<style>a{}</style><script>f()</script>x{n}", "x{n}", "", "", "style 7 10,script 26 29"),
            ("<p onclick='g()'>y{n}</p>", "y{n}", "", "", "handler 12 15"),
            ('<iframe srcdoc="&lt;b&gt;"></iframe>', "", "", "", "srcdoc 16 25"),
            ("<template>no</template><table><caption>c</caption><tr><td>d{n}", "c|d{n}", "", "", ""),
            ('<meta http-equiv="refresh" content="0; url=/r{n}">', "", "", "/r{n}", ""),
        ],
        _html,
    ),
    # D10, D15 to D17
    "html_problem_vectors": Vectors(
        ("problems",),
        [
            ("<p>fine {n}</p>", ""),
            ("<p>acme/<b>vault</b></p>", "runs: repository coordinate"),
            ('<a href="//h/x{n}">x</a>', "text: local path, urls: network path"),
            ('<iframe srcdoc="&lt;a href=&quot;java&#10;script:x&quot;&gt;"></iframe>', "srcdoc.text: dangerous scheme, srcdoc.urls: dangerous scheme"),
            ("<style>p::before{content:'acme' '/vault'}</style>", "styles: repository coordinate"),
            ("<script>// acme/vault\n</script>", "scripts: repository coordinate, text: repository coordinate"),
            ('<script type="application/ld+json">{"a":1,"a":2}</script>', "scripts: repeated key"),
            ('<meta property="og:title" content="claim-{n}">', "metas: internal identifier"),
            ('<img alt="drafts/x{n}">', "readable: local path, text: local path"),
            ("<p>x</p><!-- see acme/vault {n} -->", "text: repository coordinate"),
            ('<p data-from="acme\\vault" id="p{n}">x</p>', "text: repository coordinate"),
            ('<input name="n{n}" value="acme/./vault">', "text: repository coordinate"),
            ("<template><b>acme%2Fvault</b>{n}</template>", "text: repository coordinate"),
            ("<style>/* acme/vault */ p{order:{n}}</style>", "text: repository coordinate"),
            ('<style>p{background:url("/drafts/{n}.png")}</style>', "text: local path"),
            ('<p>so ::note{id="{n}"} stays</p>', "runs: raw directive, text: raw directive"),
            ("<p>vb&#115;cript:f{n}()</p>", "runs: dangerous scheme, text: dangerous scheme"),
            ("<style>li::marker{content:'{n}'}</style><p onclick=\"f('x:{n}')\">x</p>", ""),
        ],
        _problems("html"),
    ),
    # D11, D12
    "css_vectors": Vectors(
        ("urls", "content", "error", "pseudo"),
        [
            ("a{background:url(x{n}.png)} @import 'y.css';", "x{n}.png y.css", "", None, ""),
            ('a::before{content:"p" "q{n}"}', "", "pq{n}", None, "1-9"),
            ("/* url(z) ::after */ b{color:red}", "", "", None, ""),
            ("a{content:'\\41 b'}", "", "Ab", None, ""),
            ("(" * 129, "", "", "style sheet nested too deep", ""),
            ("a " * 20_001, "", "", "style sheet has too many parts", ""),
        ],
        _css,
    ),
    # D13, D16: type|source
    "script_vectors": Vectors(
        ("kind", "problems"),
        [
            ("|x = 'acme/vault'", "javascript", COORDINATE),
            ("module|// fine {n}", "javascript", ""),
            ("text/JavaScript; charset=utf-8|`java${n}script` + 'data:x'", "javascript", SCHEME),
            ('application/ld+json|{"a": "drafts/x{n}"}', "json", PATH),
            ("importmap|{", "json", "not JSON"),
            ("text/plain|see acme/vault", "inert", COORDINATE),
            ("|f(<p>acme/vault</p>)", "javascript", COORDINATE),
            ("|x = 'acme\\x2f' + y; z = 'ac\\u006de\\u{2f}vault{n}'; w = 'acme\\x2fvault'", "javascript", COORDINATE),
            ("|a = `one ${f(`two ${'javascript' + `: {n}`} javascript:x`)} three`", "javascript", SCHEME),
            ("|a = `drafts${'/'}x{n}`", "javascript", ""),
            ("text/x-template|calm {n}", "inert", ""),
        ],
        _script,
    ),
    # F5, F7, F9
    "label_tables": Vectors(
        ("ru", "en", "panel", "word"),
        [("legend", "Легенда", "Legend", "era-panel-legend", "yes"), ("context", "Культурный контекст", "Cultural context", "era-panel-context", "yes"), ("confirmed", "Что подтверждено", "What is supported", "era-panel-confirmed", "yes"), ("other{n}", None, None, "era-panel-other{n}", "yes")],
        lambda v: [T.label(v, T.LAYER_LABELS, F.lit("ru")), T.label(v, T.LAYER_LABELS, F.lit("en")), T.panel_id(v), T.translated(F.lit("en"), F.lit("да"), F.lit("yes"))],
    ),
    # O7, F47
    "unsorted_ranges": Vectors(
        ("masked",),
        [("abcdefgh", "   d  gh"), ("привет, {n}", "   в  , {n}"), ("ab", "  ")],
        lambda v: [T.mask_ranges(v, F.array(*[F.struct(F.lit(a).alias("start"), F.least(F.lit(b), F.length(v)).alias("end")) for a, b in ((4, 6), (0, 3))]))],
    ),
}


def _links(text: str) -> str:
    try:
        return " ".join(extract.reader_links(text, DENIED, LINKS))
    except canonical.Unsafe as e:
        return str(e)


QUERIES = {name: v.query for name, v in VECTORS.items()}
SQL = {name: v.sql() for name, v in VECTORS.items()}
