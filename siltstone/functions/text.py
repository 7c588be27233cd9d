"""Column functions over text: tokens, identities, scores as text, the line forms of results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The retrieval rules that results depend on.
RRF_K, K1, B = 60, 1.2, 0.75
PENALTY, PENALTY_MARKS = 0.8, ("tests/", "test_", "docs/", "spec", "plan")
LOOKUP_BOOST, MAX_PER_FILE, POOL = 1.5, 3, 3
BONUS_FILES, BONUS_SCALE = 2, 0.85
LOOKUP_WORDS = ("function", "class", "method", "def")
LOOKUP_EXTENSIONS = ("py", "js", "jsx", "ts", "go", "rb", "rs", "java")
#: All characters with the Unicode property White_Space.
BLANK = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, lower-cased, in order."""
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def token_count(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def line_count(text: Column) -> Column:
    """Newline bytes and one."""
    return (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    """16 hex digits of SHA-256 over "path:start:end:" and the first 100 bytes."""
    head = F.encode(F.concat_ws(":", path, start.cast("string"), end.cast("string"), F.lit("")), "UTF-8")
    return F.left(F.sha2(F.concat(head, F.substring(F.encode(content, "UTF-8"), 1, 100)), 256), F.lit(16))


def score_key(x: Column) -> Column:
    """Millionths, half away from zero: what scores are ordered by."""
    return F.round(x * 1e6).cast("long")


def rounded(x: Column) -> Column:
    return F.round(x * 1e6) / 1e6


def six_decimals(x: Column) -> Column:
    """Never a negative zero."""
    key = score_key(x)
    return F.concat(F.when(key < 0, "-").otherwise(""), F.floor(F.abs(key) / 1000000).cast("string"), F.lit("."), F.lpad((F.abs(key) % 1000000).cast("string"), 6, "0"))


def signed_six(x: Column) -> Column:
    return F.concat(F.when(score_key(x) >= 0, "+").otherwise(""), six_decimals(x))


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def render_document(title: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), unicode_trim(title), F.lit("\n\n"), body)


def normalise_decision(text: Column) -> Column:
    """ASCII white space trimmed and collapsed."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\f\r]+", " "), "^ | $", "")


def decision_id(text: Column) -> Column:
    return F.left(F.sha2(normalise_decision(text), 256), F.lit(16))


def searchable(text: Column, tags: Column, area: Column) -> Column:
    return F.concat_ws(" ", text, F.when(F.size(tags) > 0, F.array_join(tags, " ")), area)


def provenance(title: Column, state: Column, updated_at: Column, url: Column) -> Column:
    clean = lambda c: F.nullif(F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]", " "), F.lit(""))
    facets = F.concat_ws(" · ", clean(state), clean(updated_at), clean(url))
    return F.concat(F.lit("[knowledge] "), F.coalesce(clean(title), F.lit("")), F.when(facets != "", F.concat(F.lit(" — "), facets)).otherwise(""))


def compact_line(rank: Column, score: Column, package: Column, path: Column, start: Column, end: Column, type_: Column, kind: Column, id_: Column) -> Column:
    own = F.when(package.isNotNull(), F.concat(package, F.lit(" · "))).otherwise("")
    return F.concat(F.lpad(rank.cast("string"), 2, " "), F.lit(". ["), six_decimals(score), F.lit("] "), own, path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" ("), type_, F.lit("/"), kind, F.lit(") #"), id_)


def verbose_block(rank: Column, score: Column, package: Column, path: Column, start: Column, end: Column, type_: Column, kind: Column, id_: Column) -> Column:
    own = F.when(package.isNotNull(), F.concat(F.lit("  package: "), package, F.lit("\n"))).otherwise("")
    fields = [("file path", path), ("start line", start.cast("string")), ("end line", end.cast("string")), ("chunk type", type_), ("chunk kind", kind), ("chunk id", id_)]
    return F.concat(F.lit("Result "), rank.cast("string"), F.lit(":\n  relevance score: "), six_decimals(score), F.lit("\n"), own, *[x for n, c in fields for x in (F.lit(f"  {n}: "), c, F.lit("\n"))])


def short_label(text: Column, limit: int = 60) -> Column:
    flat = unicode_trim(F.regexp_replace(text, f"[{BLANK}]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def snippet(text: Column, limit: int = 500) -> Column:
    """The text if it is short, else up to its last sentence end in the limit, else up to its last white space."""
    head = F.left(text, F.lit(limit))
    sentence = F.regexp_extract(head, r"(?s)^.*[.!?](?=\s|$)", 0)
    word = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= limit, text).when(sentence != "", sentence).otherwise(F.concat(F.when(word != "", word).otherwise(head), F.lit("…")))


def fence_query(raw: Column, limit: int = 500) -> Column:
    """Control characters to spaces, the first 500 characters, trimmed; null if nothing is left."""
    return F.nullif(unicode_trim(F.left(F.regexp_replace(raw, r"[\x00-\x1f\x7f-\x9f]", " "), F.lit(limit))), F.lit(""))


def percent_decoded(raw: Column) -> Column:
    """Plus signs and %xx of a URL's query as text; a per cent sign that begins no byte stays."""
    return F.url_decode(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"))


def trimmed(content: Column, tokens: Column) -> Column:
    """What of a text fits a number of tokens, cut between characters."""
    def head(n: Column) -> Column:
        own = F.substring(F.encode(content, "UTF-8"), F.lit(1), F.greatest(n.cast("int"), F.lit(0)))
        return F.when(F.is_valid_utf8(own), F.decode(own, "UTF-8"))

    return F.when(token_count(content) <= tokens, content).otherwise(F.coalesce(*[head(tokens * 4 - back) for back in range(4)]))


def extension(path: Column) -> Column:
    """With its dot, lower-cased; a leading dot makes none."""
    return F.nullif(ascii_lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "[^/]+$", 0), r"(?<=.)\.[^.]*$", "")


def direction(delta: Column) -> Column:
    return F.when(delta > 1e-9, "up").when(delta < -1e-9, "down").otherwise("flat")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def abbreviated(n: Column) -> Column:
    """Plain below 1,000; 7.9k below 100,000, rounded as the binary number n / 1000 lies (half to even only if it is exact); 123k above."""
    tenths, x = F.floor(n / 100), n / 1000.0
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of its bits, so that products are exact
    off = (high * 20 - x * 20) + (x - high) * 20 + (x * 20 - (tenths * 2 + 1))  # on which side of the tie x lies
    up = (n % 100 > 50) | ((n % 100 == 50) & ((off > 0) | ((off == 0) & (tenths % 2 == 1))))
    v = tenths + up.cast("int")
    short = F.concat(F.floor(v / 10).cast("string"), F.lit("."), (v % 10).cast("string"), F.lit("k"))
    return F.when(n < 1000, n.cast("string")).when(n < 100000, short).otherwise(F.concat(F.floor(n / 1000).cast("string"), F.lit("k")))


def quoted(line: Column) -> Column:
    """The first string literal of a line, by its own kind of quote; null without one or if it is empty."""
    body = F.regexp_extract(line, r"""^[^"']*("[^"]*"|'[^']*')""", 1)
    return F.nullif(F.substring(body, F.lit(2), F.greatest(F.length(body) - 2, F.lit(0))), F.lit(""))


def iso_seconds(text: Column) -> Column:
    """Epoch seconds of YYYY-MM-DD?HH:MM:SS with Z or an offset; null for fractions and impossible dates. Second 60 counts."""
    shape = r"^(\d{4})-(\d\d)-(\d\d).(\d\d):(\d\d):(\d\d)(Z|[+-]\d\d(?::?\d\d)?)$"
    part = lambda i: F.regexp_extract(text, shape, i)
    number = lambda i: F.try_to_number(part(i), F.lit("9999")).cast("int")
    zone = part(7)
    hours, minutes = F.substring(zone, 2, 2), F.coalesce(F.nullif(F.regexp_extract(zone, r"^.\d\d:?(\d\d)$", 1), F.lit("")), F.lit("00"))
    offset = F.when(zone == "Z", 0).otherwise((hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60) * F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1))
    day = F.unix_date(F.to_date(F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd"))))
    hour, minute, second = (part(i).try_cast("int") for i in (4, 5, 6))
    valid = text.rlike(shape) & (hour < 24) & (minute < 60) & (second <= 60)
    return F.when(valid, day.cast("long") * 86400 + hour * 3600 + minute * 60 + second - offset)


def iso_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_day(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def is_lookup(query: Column) -> Column:
    """Whether a query asks for a definition."""
    low = ascii_lower(query)
    words = F.arrays_overlap(tokens(query), F.array(*[F.lit(w) for w in LOOKUP_WORDS]))
    file = low.rlike(rf"\.(?:{'|'.join(LOOKUP_EXTENSIONS)})(?![a-z0-9_])")
    at = F.locate("find ", low)
    return words | file | F.contains(low, F.lit("where is ")) | F.contains(low, F.lit(" defined")) | ((at > 0) & F.contains(F.substring(low, at, F.length(low)), F.lit(" function")))


def file_hints(query: Column) -> Column:
    return F.filter(F.split(ascii_lower(unicode_trim(query)), f"[{BLANK}]+"), lambda t: F.contains(t, F.lit(".")))


def keyword_distance(content: Column, path: Column, words: Column, hints: Column) -> Column:
    """0 if a word of the query is anywhere in the content or a hint anywhere in the path, else 2."""
    low, low_path = ascii_lower(content), ascii_lower(path)
    hit = F.exists(words, lambda t: F.contains(low, t)) | F.exists(hints, lambda t: F.contains(low_path, t))
    return F.when(hit, 0.0).otherwise(2.0)


def penalised(path: Column) -> Column:
    return ascii_lower(path).rlike("|".join(PENALTY_MARKS))


def repo_id(origin: Column) -> Column:
    """host__path of a git remote, from its https or ssh form."""
    bare = F.regexp_replace(F.regexp_replace(unicode_trim(origin), r"^[a-z+]+://(?:[^@/]*@)?|^[^@/]+@", ""), r"(?:\.git)?/*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^([^/:]+):(?:\d+/)?", "$1/"), "/+", "__"), r"[^A-Za-z0-9._-]", "_")


def content_address(*segments: Column) -> Column:
    return F.concat_ws("/", *segments)


def valid_segment(name: Column) -> Column:
    """Safe as a folder name: no traversal, nothing but letters, digits and ._-"""
    return name.rlike(r"^[A-Za-z0-9._-]+$") & ~name.isin(".", "..")


def specifier_head(spec: Column) -> Column:
    """The first segment of an import specifier that isn't . or ..; @scope/name stays whole."""
    own = F.filter(F.split(spec, "/"), lambda s: ~s.isin("", ".", ".."))
    return F.when(F.left(F.get(own, F.lit(0)), F.lit(1)) == "@", F.array_join(F.slice(own, 1, 2), "/")).otherwise(F.get(own, F.lit(0)))


def first_line(content: Column) -> Column:
    """The first line that isn't blank, with how many follow: what is left of a text without a language."""
    lines = F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n")
    at = F.array_position(F.transform(lines, lambda x: unicode_trim(x) != ""), True).cast("int")
    rest = F.size(lines) - at
    line = F.element_at(lines, at)
    return F.when(at == 0, F.lit("")).when(rest > 0, F.concat(line, F.lit("\n… (+"), rest.cast("string"), F.lit(" lines)"))).otherwise(line)
