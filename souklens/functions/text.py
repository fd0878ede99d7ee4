"""Text, URL and key expressions: Catalyst columns only, but for NFC, which Spark lacks."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it: for deep expressions, which would else double at every step."""
    return F.transform(F.array(value), f)[0]


# Query parameters that only track a visit, and their prefixes.
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_", "matomo_")
TRACKING_PARAMS = ("gclid", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "yclid", "twclid", "igshid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "ref_src", "referrer", "source", "spm")
# Characters without a shape of their own; ZWNJ and ZWJ stay.
INVISIBLE = r"[​‎‏‪-‮⁠-⁤⁦-⁩﻿]"
# Arabic marks, tatweel and ZWNJ, dropped for comparison; letter forms folded to the Persian ones.
MARKS = r"[ؐ-ؚـً-ٰٟۖ-ۭ‌]"
LETTERS = ("يىكۀة", "ییکهه")
SPACES = r"[\s   -     　﻿\u000B]+"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_text(df, columns: list[str], *, fold: bool = False):
    """df with its text columns clean (or, with fold, with `<column>_key` beside them). Texts beyond ASCII are brought to NFC
    first, which Spark lacks: one Arrow UDF for each column, to which ASCII texts go as nulls."""
    for c in columns:
        text = F.when(has_non_ascii(F.col(c)), F.col(c))
        composed = F.coalesce(nfc(text), F.col(c))
        df = df.withColumn(f"{c}_key" if fold else c, fold_for_compare(composed) if fold else clean_text(composed))
    return df


def has_non_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x20-\x7E]")


def clean_text(c: Column, normalise: bool = False) -> Column:
    """Drops invisible characters, makes runs of white space one blank, trims. normalise: NFC, for rows beyond ASCII only."""
    c = F.when(has_non_ascii(c), nfc(c)).otherwise(c) if normalise else c
    return F.trim(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), SPACES, " "))


def fold_for_compare(c: Column, normalise: bool = False) -> Column:
    """A key for comparing: clean, without marks, letter forms folded, lower case."""
    return F.lower(F.translate(F.regexp_replace(clean_text(c, normalise), MARKS, ""), *LETTERS))


def slugify(c: Column, ascii_only: bool = False, digits: int = 8) -> Column:
    """Letters and digits of the folded text, dashes between. ascii_only: where the slug isn't ASCII, a hash of the text instead.
    A text of plain ASCII has nothing to fold but case."""
    dashed = lambda x, other: F.btrim(F.regexp_replace(x, other, "-"), F.lit("-"))
    folded = dashed(fold_for_compare(c), r"[^\p{L}\p{N}]+")
    if ascii_only:
        folded = let(folded, lambda s: F.when(has_non_ascii(s), short_hash(c, digits)).otherwise(s))
    return F.when(has_non_ascii(c), folded).otherwise(dashed(F.lower(c), "[^a-z0-9]+"))


def short_hash(c: Column, n: int = 8) -> Column:
    """The first 64 bits of SHA-256, modulo 36^n, in n base-36 digits."""
    low = F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(36**n).cast("decimal(20,0)")
    return F.lpad(F.lower(F.conv(low.cast("string"), 10, 36)), n, "0")


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def url_part(c: Column, part: int) -> Column:
    return F.regexp_extract(F.trim(c), _URL, part)


_UNSAFE = r'\x00-\x20"<>`{}\x7F-\x{10FFFF}'


def encode_path(path: Column) -> Column:
    """A path with what may not stand in one percent-encoded (UTF-8) and its . and .. steps taken; what is encoded stays so."""

    def encoded(path: Column) -> Column:
        runs = F.regexp_extract_all(path, F.lit(f"[{_UNSAFE}]+|[^{_UNSAFE}]+"), F.lit(0))
        made = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(f"[{_UNSAFE}]"), F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))).otherwise(x)), "")
        return F.when(path.rlike(f"[{_UNSAFE}]"), made).otherwise(path)

    def walked(path: Column) -> Column:
        steps = F.split(path, "/")
        at = F.reduce(steps, F.array().cast("array<string>"), lambda at, x: F.when(x == ".", at).when(x == "..", F.when(F.size(at) > 1, F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(at)).otherwise(F.array_append(at, x)))
        last = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
        return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(at, "/"), last)).otherwise(path)

    return let(let(path, encoded), walked)


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no fragment, default port, tracking parameters or slash at a path's end; parameters in
    order of their names, form-encoded anew. What is no absolute URL comes back trimmed."""
    return let(F.trim(c), lambda t: F.when(t.rlike(_URL), _canonical(t)).otherwise(t))


def _canonical(c: Column) -> Column:
    named_host = let(F.lower(url_part(c, 2)), lambda host: let(F.lower(url_part(c, 1)), lambda scheme: F.concat(scheme, F.lit("://"), F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host))))
    path = let(encode_path(url_part(c, 3)), lambda p: F.when(p.rlike("^/*$"), "/").otherwise(F.regexp_replace(p, "/+$", "")))
    decoded = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    parts = F.filter(F.split(url_part(c, 4), "&"), lambda p: p != "")
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")
    named = F.transform(parts, lambda p, i: F.struct(decoded(F.substring_index(p, "=", 1)).alias("n"), i.alias("i"), decoded(value(p)).alias("v")))
    tracked = lambda n: reduce(lambda a, b: a | b, [F.startswith(n, F.lit(x)) for x in TRACKING_PREFIXES], n.isin(*TRACKING_PARAMS))
    kept = F.array_sort(F.filter(named, lambda s: ~tracked(F.lower(s["n"]))))
    query = F.array_join(F.transform(kept, lambda s: F.concat(F.url_encode(s["n"]), F.lit("="), F.url_encode(s["v"]))), "&")
    return F.concat(named_host, path, F.regexp_replace(F.concat(F.lit("?"), query), r"^\?$", ""))


def resolve_url(href: Column, base: Column, only_http: bool = False) -> Column:
    """A link against the absolute URL of its page: absolute, //host, /path, ?query, #fragment or relative; null if it is none
    (or, with only_http, of another scheme)."""

    def whole(h: Column) -> Column:
        scheme, host = F.lower(url_part(base, 1)), F.lower(url_part(base, 2))
        root, path, asked = F.concat(scheme, F.lit("://"), host), _path(base), F.regexp_extract(F.trim(base), r"(\?[^#]*)", 1)
        made = (
            F.when(h.rlike(_SCHEME), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, F.lit(":"), h)).when(F.startswith(h, F.lit("/")), F.concat(root, h)).when(F.startswith(h, F.lit("?")), F.concat(root, path, h))
            .when(h == "", F.concat(root, path, asked)).when(F.startswith(h, F.lit("#")), F.concat(root, path, asked, h)).otherwise(F.concat(root, F.regexp_replace(path, "[^/]*$", ""), h))
        )
        return F.when(h.rlike(_SCHEME) | base.rlike(_URL), made)

    def clean(u: Column) -> Column:
        made = F.concat(F.lower(url_part(u, 1)), F.lit("://"), F.lower(url_part(u, 2)), encode_path(_path(u)), F.regexp_extract(u, r"^[^?#]*(.*)$", 1))
        return F.when(u.rlike(_URL), made).otherwise(u)

    out = let(let(F.regexp_replace(F.trim(href), r"[\t\r\n]", ""), whole), clean)
    return let(out, lambda u: F.when(u.rlike("(?i)^https?:"), u)) if only_http else out


def _path(url: Column) -> Column:
    return F.when(url_part(url, 3) == "", "/").otherwise(url_part(url, 3))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def profile_domain(c: Column) -> Column:
    """Host, lower case, without a port or www."""
    host = F.regexp_replace(F.lower(url_part(c, 2)), r"^(?:[^@]*@)?(?:www\.)?|:\d+$", "")
    return F.when(host != "", host)


# Fixed values, in order: query parameters and path segments that stand before a page's number.
PAGE_PARAMS = ("page", "paged", "p", "pg", "offset_page", "product-page")
PAGE_SEGMENTS = ("page", "pagina", "seite", "صفحه")


def page_number(c: Column) -> Column:
    """A page number in a query parameter, else in a path segment behind a word for page (any case, percent-encoded or not);
    null if there is none."""
    q = F.concat(F.lit("&"), F.coalesce(url_part(c, 4), F.lit("")))
    path = F.lower(F.coalesce(F.try_url_decode(F.replace(url_part(c, 3), F.lit("+"), F.lit("%2B"))), url_part(c, 3)))
    found = [F.regexp_extract(q, rf"^(?:&(?!{p}=)[^&]*)*&{p}=(\d+)(?:&|$)", 1) for p in PAGE_PARAMS] + [F.regexp_extract(path, rf"/(?:{'|'.join(PAGE_SEGMENTS)})/+(\d+)(?:/|$)", 1)]
    return F.coalesce(*[F.when(x != "", x) for x in found]).try_cast("long")


def collection_handle(c: Column) -> Column:
    """The path segment behind `collections`."""
    x = F.regexp_extract(url_part(c, 3), r"/collections/([^/]+)", 1)
    return F.when(x != "", x)


def category_slug(c: Column, markers: tuple[str, ...] = ("product-category", "category", "shop")) -> Column:
    """The deepest path segment behind a category marker, pagination left out."""
    tail = F.regexp_replace(F.regexp_extract(url_part(c, 3), rf"/(?:{'|'.join(markers)})/(.+)$", 1), r"(?:^|/)page/\d+/?$|/+$", "")
    return F.when(tail != "", F.substring_index(tail, "/", -1))


def normalize_type(c: Column) -> Column:
    """The last word of a schema type in any spelling, lower case."""
    return F.lower(F.regexp_replace(F.substring_index(F.substring_index(F.trim(c), "/", -1), ":", -1), "#", ""))


def csv_field(c: Column, delimiter: str = ",", guard: bool = False) -> Column:
    """RFC 4180, quoted only where needed; guard puts an apostrophe before what a sheet would take for a formula."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    v = F.when(v.rlike(r"^[=+\-@\t\r]") & ~v.rlike(r"^-?\d+(\.\d+)?$"), F.concat(F.lit("'"), v)).otherwise(v) if guard else v
    return F.when(v.rlike(f'["\\r\\n{delimiter}]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def multi_value(c: Column) -> Column:
    """An array as one cell: commas inside escaped, items joined by a comma and a blank."""
    return F.array_join(F.transform(c, lambda x: F.replace(F.trim(x), F.lit(","), F.lit("\\,"))), ", ")


# Words for confidences, from the highest down.
CONFIDENCE_WORDS = ((0.95, "certain"), (0.7, "reliable"), (0.5, "probable"), (0.35, "rough"))


def describe_confidence(c: Column) -> Column:
    return reduce(lambda at, x: at.when(c >= x[0], x[1]), CONFIDENCE_WORDS[1:], F.when(c >= CONFIDENCE_WORDS[0][0], CONFIDENCE_WORDS[0][1])).otherwise("worth checking")


def escape_description(c: Column) -> Column:
    """A backslash before an n is doubled, so that an importer doesn't read a line end."""
    return F.replace(c, F.lit("\\n"), F.lit("\\\\n"))


def category_cell(path: Column) -> Column:
    """A path as one cell: commas in names escaped, names joined by >."""
    return F.array_join(F.transform(F.filter(F.transform(path, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.replace(x, F.lit(","), F.lit("\\,"))), " > ")


#: Fixed value: names whose values are secrets.
SECRET = r"(?i)(?:^|[._-])(?:api)?key$|token|secret|password|authorization|cookie"


def redact_fields(c: Column, longest: int = 500) -> Column:
    """A map of texts without the values of secret names and without long values."""
    return F.transform_values(c, lambda k, v: F.when(F.regexp_like(k, F.lit(SECRET)), F.lit("[redacted]")).when(F.length(v) > longest, F.concat(F.lit("["), F.length(v).cast("string"), F.lit(" chars]"))).otherwise(v))


def redact_values(c: Column, most: int = 20, longest: int = 500) -> Column:
    """A variant one level deep as redact_fields takes it: objects within by their own names, lists cut to `most` entries."""
    text = lambda v: F.try_variant_get(v, "$", "string")
    short = lambda v: F.when(F.length(text(v)) > longest, F.concat(F.lit("["), F.length(text(v)).cast("string"), F.lit(" chars]"))).otherwise(text(v))
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    inner = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    one = lambda k, v: F.when(F.regexp_like(k, F.lit(SECRET)), F.lit("[redacted]")).otherwise(short(v))
    value = lambda v: F.when(listed(v).isNotNull(), F.to_json(F.transform(F.slice(listed(v), 1, most), lambda x: short(x)))).when(inner(v).isNotNull(), F.to_json(F.transform_values(inner(v), one))).otherwise(short(v))
    return F.transform_values(F.try_variant_get(c, "$", "map<string,variant>"), lambda k, v: F.when(F.regexp_like(k, F.lit(SECRET)), F.lit("[redacted]")).otherwise(value(v)))
