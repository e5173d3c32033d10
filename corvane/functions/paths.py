"""Column functions on paths, routes and ids. All are built-in expressions.

Edge cases: a null path gives null; an empty one is the root of its base; names between
slashes may be empty, which is no exact path; each row is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCALES = ("ru", "en")
ERROR_ROUTE = "404"
#: Fixed patterns of public ids, by kind.
ID_PATTERNS = {
    "entry": r"^(?:prologue|chapter-[0-9]{2}|interlude-[a-z0-9-]+)$",
    "note": r"^note-[a-z0-9-]+$",
    "source": r"^source-[a-z0-9-]+$",
    "object": r"^object-[a-z0-9-]+$",
    "media": r"^media-[a-z0-9-]+$",
    "anchor": r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$",
    "slug": r"^[a-z0-9]+(?:-[a-z0-9]+)*$",
    "cycle": r"^cycle-(?:0[1-9]|[1-9][0-9])$",
    "commit": r"^[0-9a-f]{40}$",
    "sha256": r"^[0-9a-f]{64}$",
}
#: Fixed pattern of image names.
IMAGE_NAME = r"[a-z0-9](?!.*\.\.)[a-z0-9._-]*\.(?:svg|webp)"
#: Prefixes that a neutral slug must not have.
RESERVED_PREFIXES = ("claim", "object", "media", "source", "interlude")
#: Folders of a release tree, by kind of record; images are binary.
CONTENT_ROOT, IMAGE_ROOT = "src/content/book-release", "public/images/book-release"
FOLDERS = {"entry": "entries", "note": "notes", "source": "sources", "object": "objects", "media": "media"}


def _prefix(base: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(base, r"^/+|/+$", ""))


def with_base(path: Column, base: Column) -> Column:
    """path under base, once: outer slashes of base and leading ones of path don't count."""
    prefix, own = _prefix(base), F.concat(F.lit("/"), F.regexp_replace(path, r"^/+", ""))
    there = (own == prefix) | F.startswith(own, F.concat(prefix, F.lit("/")))
    return F.when(there, own).when(prefix == "/", own).otherwise(F.concat(prefix, own))


def without_base(path: Column, base: Column) -> Column:
    prefix = _prefix(base)
    under = (prefix != "/") & ((path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/"))))
    rest = F.substr(path, F.length(prefix) + 1)
    return F.when(under, F.when(rest == "", "/").otherwise(rest)).when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def locale_of(path: Column, base: Column) -> Column:
    """en if the first segment after the base is exactly en, else ru."""
    return F.when(without_base(path, base).rlike(r"^/en(?:/|$)"), "en").otherwise("ru")


def localize(path: Column, locale: Column, base: Column) -> Column:
    """The same page, query and fragment in another language; the error page has a form of its own per language."""
    head = F.regexp_extract(path, r"^([^?#]*)", 1)
    tail = F.substr(path, F.length(head) + 1)
    route = F.regexp_replace(without_base(F.when(head == "", "/").otherwise(head), base), r"^/en(?=/|$)", "")
    route = F.when(route == "", "/").otherwise(route)
    english = locale == "en"
    error = F.when(english, f"/{ERROR_ROUTE}/").otherwise(f"/{ERROR_ROUTE}.html")
    route = F.when(route.rlike(rf"^/{ERROR_ROUTE}(?:\.html|/)?$"), error).otherwise(route)
    return F.concat(with_base(F.concat(F.when(english, "/en").otherwise(""), route), base), tail)


def section_of(path: Column, known: tuple[str, ...], other: str = "home") -> Column:
    """The last segment if it is known, else `other`."""
    last = F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)
    return F.when(last.isin(*known), last).otherwise(other)


def is_error_route(path: Column) -> Column:
    return path.rlike(rf"(?:^|/){ERROR_ROUTE}(?:\.html|/)?$")


def is_active(link: Column, current: Column) -> Column:
    """The root is active on itself only, any other link on itself and below."""
    trim = lambda c: F.regexp_replace(c, r"/+$", "")
    return F.when(trim(link) == "", trim(current) == "").otherwise((trim(current) == trim(link)) | F.startswith(current, F.concat(trim(link), F.lit("/"))))


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def is_normal(path: Column) -> Column:
    """A POSIX path in normal form (.. at its start only), without backslash, percent sign or NUL."""
    clean = ~path.rlike(r"[\\%\x00]") & (path != "")
    up = r"^(?:\.\./)*"
    return clean & ~path.rlike(r"//|(?:^|/)\.(?:/|$)") & ~path.rlike(up + r"(?!\.\.(?:/|$)).*/\.\.(?:/|$)|^/\.\.(?:/|$)") | (path == ".")


def payload_kind(path: Column) -> Column:
    """entry, note, source, object, media or image for an exact payload path, else null."""
    out = F.when(path.rlike(rf"^{IMAGE_ROOT}/{IMAGE_NAME}$"), "image")
    for kind, folder in FOLDERS.items():
        name = ID_PATTERNS[kind][1:-1]
        out = out.when(path.rlike(rf"^{CONTENT_ROOT}/{folder}/{name}\.{'md' if kind == 'entry' else 'json'}$"), kind)
    return out


def is_neutral_slug(slug: Column) -> Column:
    return slug.rlike(ID_PATTERNS["slug"]) & ~slug.rlike(rf"^(?:{'|'.join(RESERVED_PREFIXES)})-")


def route_of(record_id: Column) -> Column:
    """/book/objects/x/ for object-x, /book/media/x/ for media-x, #note-x for notes."""
    cut = lambda k: F.substr(record_id, F.lit(k + 2))
    return (
        F.when(record_id.rlike("^object-"), F.concat(F.lit("/book/objects/"), cut(6), F.lit("/")))
        .when(record_id.rlike("^media-"), F.concat(F.lit("/book/media/"), cut(5), F.lit("/")))
        .when(record_id.rlike("^note-"), F.concat(F.lit("#"), record_id))
    )


def resolve_segments(path: Column) -> Column:
    """Backslashes as slashes; empty and single-dot segments go, double dots take the segment before; a root (/, // or a drive) stays."""
    slashed = F.translate(path, "\\", "/")
    root = F.regexp_extract(slashed, r"^(//|/|[A-Za-z]:/)", 1)
    segments = F.filter(F.split(F.substr(slashed, F.length(root) + 1), "/"), lambda s: ~s.isin("", "."))
    back = lambda a: (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit("..")) != "..")
    fold = lambda a, s: F.when((s == "..") & back(a), F.slice(a, 1, F.size(a) - 1)).otherwise(F.array_append(a, s))
    return F.concat(root, F.array_join(F.aggregate(segments, F.array().cast("array<string>"), fold), "/"))


def is_inside(relative: Column) -> Column:
    """A relative path that stays inside its root: not empty, not absolute (either system), not leading out."""
    return (relative != "") & ~relative.rlike(r"^(?:[/\\]|[A-Za-z]:)") & ~relative.rlike(r"^\.\.(?:[/\\]|$)")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))
