"""URL and path expressions. All are built from JVM-side functions, row by row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagelattice.functions import fixed
from pagelattice.functions.binding import let

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_SUFFIX = r"(?:^|/)\.*[^./][^/]*(\.[^./]*)\z"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, rf"^({_SCHEME}):", 1))


def authority(url: Column) -> Column:
    """Host with port and user part, '' when the URL has none."""
    return F.regexp_extract(url, rf"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def raw_path(url: Column) -> Column:
    """Path including any ;parameters of its last segment."""
    return F.regexp_extract(url, rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def path(url: Column) -> Column:
    """Path without the ;parameters of its last segment."""
    full = raw_path(url)
    return F.when(F.contains(url, F.lit(";")), F.regexp_replace(full, r";[^/]*\z", "")).otherwise(
        full
    )


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def origin(url: Column) -> Column:
    """scheme://authority"""
    return F.concat(scheme(url), F.lit("://"), authority(url))


def drop_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def suffix(file_path: Column) -> Column:
    """Last '.xyz' of the file name; dots that lead the name do not count."""
    return F.regexp_extract(file_path, _SUFFIX, 1)


def percent_decode(text: Column) -> Column:
    """Percent-decoding that leaves '+' and malformed escapes as they are."""

    def decode(t: Column) -> Column:
        guarded = F.regexp_replace(
            F.replace(t, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25"
        )
        return F.when(F.contains(t, F.lit("%")), F.try_url_decode(guarded)).otherwise(t)

    return let(text, decode)


def query_value(url: Column, name: str) -> Column:
    """First non-empty value of a query parameter, form-decoded; '' when there is none."""
    raw = F.regexp_extract(query(url), rf"(?:^|&){name}=([^&]+)", 1)
    return percent_decode(F.replace(raw, F.lit("+"), F.lit(" ")))


# --- resolving ------------------------------------------------------------------------------


# One pattern cuts a base URL into everything that resolving needs.
_BASE = rf"(?s)^(?:({_SCHEME}):)?(?://([^/?#]*))?((?:[^?#]*/)?)([^?#]*)((?:\?[^#]*)?).*\z"


def base_parts(base: Column) -> Column:
    """Pieces of a base URL as an array: scheme, authority, folder, file name, query.

    Make it a column of its own before using it inside a lambda. An array made by a split stays
    a computed column there, whereas Catalyst would move a struct of separate expressions into
    the lambda and evaluate them once per link.
    """
    flat = F.regexp_replace(F.translate(base, "\t\r\n", ""), _BASE, "$1\n$2\n$3\n$4\n$5")
    return F.split(flat, "\n", -1)


def base_authority(parts: Column) -> Column:
    return parts[1]


def base_site(parts: Column) -> Column:
    return F.concat(F.lower(parts[0]), F.lit("://"), parts[1])


def _fold_dots(merged: Column, rooted: Column) -> Column:
    """Walk '.' and '..' segments; empty inner segments go unless the reference was rooted."""

    def fold(pieces: Column) -> Column:
        last = F.element_at(pieces, -1)
        inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
        walked = F.aggregate(
            F.concat(
                F.array(pieces[0]), F.filter(inner, lambda s: rooted | (s != "")), F.array(last)
            ),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            )
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(walked, closing), "/")

    joined = let(F.split(merged, "/", -1), fold)
    return let(
        joined, lambda j: F.when(F.startswith(j, F.lit("/")), j).otherwise(F.concat(F.lit("/"), j))
    )


# One pattern cuts a reference into scheme, //authority, path and query; a lone '?' is dropped.
_REFERENCE = rf"(?s)^(?:({_SCHEME}):)?((?://[^/?]*)?)([^?]*)((?:\?.+)?)\??\z"


def _tidy(href: Column) -> Column:
    """Reference without fragment, line breaks and leading blanks."""
    cleaned = F.when(
        href.rlike(r"^[\x00-\x20]|[\t\r\n]"),
        F.regexp_replace(F.translate(href, "\t\r\n", ""), r"^[\x00-\x20]+", ""),
    ).otherwise(href)
    secure = F.when(F.startswith(href, F.lit("//")), F.lit("https:")).otherwise("")
    return drop_fragment(F.concat(secure, cleaned))


def _cut(reference: Column) -> Column:
    return F.split(F.regexp_replace(reference, _REFERENCE, "$1\n$2\n$3\n$4"), "\n", -1)


def resolve_all(hrefs: Column, parts: Column) -> Column:
    """Resolve an array of references against ``base_parts`` and drop the fragments.

    Protocol-relative references become https. Plain absolute and root-relative references,
    by far the most frequent, never reach the segment fold. The steps are separate passes over
    the array so that each intermediate value is computed once.
    """
    base_scheme = F.lower(parts[0])
    site = base_site(parts)

    def place(c: Column) -> Column:
        own_scheme, own_authority, own_path, own_query = F.lower(c[0]), c[1], c[2], c[3]
        foreign = ((own_scheme != "") & (own_scheme != base_scheme)) | (own_authority != "")
        head = F.when(own_scheme != "", own_scheme).otherwise(base_scheme)
        folder = F.when(parts[2] == "", F.lit("/")).otherwise(parts[2])
        rooted = F.startswith(own_path, F.lit("/"))
        merged = F.when(rooted, own_path).otherwise(F.concat(folder, own_path))
        whole = F.when(foreign, F.concat(head, F.lit(":"), own_authority, own_path, own_query)).when(
            own_path == "",
            F.concat(
                site, parts[2], parts[3], F.when(own_query == "", parts[4]).otherwise(own_query)
            ),
        )
        return F.struct(
            whole.alias("whole"),
            merged.alias("merged"),
            rooted.alias("rooted"),
            own_query.alias("query"),
        )

    def join(p: Column) -> Column:
        dotted = F.contains(p["merged"], F.lit("/."))
        doubled = ~p["rooted"] & F.contains(p["merged"], F.lit("//"))
        walked = F.when(dotted | doubled, _fold_dots(p["merged"], p["rooted"])).otherwise(p["merged"])
        return F.coalesce(p["whole"], F.concat(site, walked, p["query"]))

    pieces = F.transform(F.transform(hrefs, _tidy), _cut)
    return F.transform(F.transform(pieces, place), join)


def resolve(href: Column, parts: Column) -> Column:
    return resolve_all(F.array(href), parts)[0]


def normalize_url(href: Column, base: Column) -> Column:
    return let(base_parts(base), lambda parts: resolve(href, parts))


def same_site(url: Column, site_authority: Column) -> Column:
    """Authority equal (port included, case-sensitive) or absent."""
    return let(authority(url), lambda own: (own == "") | (own == site_authority))


def page_key(url: Column) -> Column:
    """Visited-set key: query dropped except for the image proxy; an empty path is '/'."""
    cut = F.when(
        F.contains(url, F.lit("?")) & ~F.contains(url, F.lit(fixed.IMAGE_PROXY)),
        F.regexp_replace(url, r"\?[^#]*", ""),
    ).otherwise(url)
    return F.regexp_replace(cut, rf"^({_SCHEME}://[^/?#]+)(?=[?#]|\z)", "$1/")


def captured_key(url: Column) -> Column:
    """Key under which a captured page answers links, which never carry a fragment."""
    return page_key(drop_fragment(url))


def site_key(url: Column) -> Column:
    host = F.replace(F.replace(authority(url), F.lit("www."), F.lit("")), F.lit("."), F.lit("_"))
    return F.concat(host, F.lit("_offline"))


# --- classification -------------------------------------------------------------------------


def _first_contained(text: Column, table: list[tuple[str, str]], default: str) -> Column:
    result = None
    for needle, value in table:
        hit = F.contains(text, F.lit(needle))
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result.otherwise(default)


def asset_category(url: Column, content_type: Column) -> Column:
    by_suffix = {s: c for c, suffixes in fixed.ASSET_CATEGORIES.items() for s in suffixes}
    lookup = F.create_map(*[F.lit(x) for pair in by_suffix.items() for x in pair])
    by_type = _first_contained(
        F.lower(F.coalesce(content_type, F.lit(""))), fixed.CATEGORY_BY_CONTENT_TYPE, "other"
    )
    return F.coalesce(F.try_element_at(lookup, F.lower(suffix(path(url)))), by_type)


def file_extension(url: Column, content_type: Column) -> Column:
    by_type = _first_contained(
        F.coalesce(content_type, F.lit("")), fixed.EXTENSION_BY_CONTENT_TYPE, ""
    )

    def pick(own_path: Column) -> Column:
        proxied = F.contains(own_path, F.lit(fixed.IMAGE_PROXY))
        inner = F.when(proxied, suffix(query_value(url, "url"))).otherwise("")
        own = suffix(own_path)
        kept = F.when(F.lower(own).isin(fixed.KEPT_EXTENSIONS), own).otherwise(by_type)
        return let(inner, lambda e: F.when(e != "", e).otherwise(kept))

    return let(path(url), pick)


def font_mime(file_path: Column) -> Column:
    """Type of an embeddable font, null for anything else."""
    result = None
    for ending, mime in fixed.FONT_MIME.items():
        hit = F.endswith(file_path, F.lit(ending))
        result = F.when(hit, mime) if result is None else result.when(hit, mime)
    return result


# --- local paths ----------------------------------------------------------------------------


def _without_parents(file_path: Column) -> Column:
    return F.when(
        F.contains(file_path, F.lit("..")),
        F.array_join(F.filter(F.split(file_path, "/", -1), lambda s: s != ".."), "/"),
    ).otherwise(file_path)


def proxied_target(url: Column) -> Column:
    """Decoded inner URL of an image-proxy URL; '' when it names none."""
    return percent_decode(query_value(url, "url"))


def image_proxy_path(url: Column) -> Column:
    """Inner path with '_w<width>' before its suffix; null when no inner URL is given."""

    def named(inner: Column) -> Column:
        ending = suffix(inner)
        stem = F.substring(inner, F.lit(1), F.length(inner) - F.length(ending))
        wide = let(
            query_value(url, "w"),
            lambda w: F.when(w != "", F.concat(stem, F.lit("_w"), w, ending)).otherwise(inner),
        )
        return F.when(inner != "", _without_parents(wide))

    return let(F.regexp_replace(proxied_target(url), r"^/+", ""), named)


def local_path(url: Column) -> Column:
    """Offline file of a URL. Parent steps are dropped so that no path leaves the folder."""

    def named(decoded: Column) -> Column:
        file = (
            F.when(decoded.isin("", "/"), F.lit("index.html"))
            .when(suffix(decoded) != "", decoded)
            .when(F.endswith(decoded, F.lit("/")), F.concat(decoded, F.lit("index.html")))
            .otherwise(F.concat(decoded, F.lit(".html")))
        )
        plain = let(F.regexp_replace(file, r"^/+", ""), _without_parents)
        return F.when(
            F.contains(decoded, F.lit(fixed.IMAGE_PROXY)), image_proxy_path(url)
        ).otherwise(plain)

    return let(percent_decode(path(url)), named)


def unwrap_image_proxy(url: Column, site: Column) -> Column:
    """Site + decoded inner URL for image-proxy URLs, the URL itself otherwise."""
    unwrapped = let(
        proxied_target(url), lambda t: F.when(t != "", F.concat(site, t)).otherwise(url)
    )
    return F.when(F.contains(url, F.lit(fixed.IMAGE_PROXY)), unwrapped).otherwise(url)


def first_srcset(srcset: Column) -> Column:
    """First URL of a candidate list; only proxy lists are cut at a comma."""
    head = F.when(
        F.contains(srcset, F.lit(fixed.IMAGE_PROXY)), F.substring_index(srcset, ",", 1)
    ).otherwise(srcset)
    return F.regexp_extract(head, r"(?U)^\s*(\S*)", 1)


def relative_path(target: Column, page: Column) -> Column:
    """POSIX relative path from the folder of ``page`` to ``target``."""

    def segments(text: Column) -> Column:
        return F.filter(F.split(text, "/", -1), lambda s: (s != "") & (s != "."))

    def walk(both: Column) -> Column:
        goal, folder = both["goal"], both["folder"]
        equal = F.zip_with(goal, folder, lambda a, b: a.eqNullSafe(b))
        return let(
            F.array_position(equal, F.lit(False)).cast("int"),
            lambda at: let(
                F.when(at == 0, F.size(goal)).otherwise(at - 1),
                lambda common: F.concat(
                    F.array_repeat(F.lit(".."), F.size(folder) - common),
                    F.slice(goal, common + 1, F.greatest(F.size(goal) - common, F.lit(0))),
                ),
            ),
        )

    folder = F.regexp_extract(page, r"^(.*)/", 1)
    both = F.struct(segments(target).alias("goal"), segments(folder).alias("folder"))
    walked = let(
        F.array_join(let(both, walk), "/"),
        lambda joined: F.when(joined == "", F.lit(".")).otherwise(joined),
    )
    # A page at the top with a tidy target, the most frequent case, needs no walk.
    tidy = ~F.contains(page, F.lit("/")) & ~target.rlike(r"//|(?:^|/)\.(?:/|\z)|^/")
    return F.when(tidy, target).otherwise(walked)
