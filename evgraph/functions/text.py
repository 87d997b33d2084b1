"""Text expressions. Every function maps a Column to a Column and stays in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a Java character class body, and as the characters themselves.
_SPACE = r"\s\x85\p{Z}"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Identifier shapes.
ARXIV_PATTERN = r"(\d{4}\.\d{4,5})"
DOI_PATTERN = r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"

# Markup that carries no text, tags that end a line, entity table in decode order.
SILENT_TAGS = ["script", "style", "noscript", "svg", "nav"]
BLOCK_TAGS = [
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "section", "article",
    "figcaption", "blockquote", "pre", "br",
]
ENTITIES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&middot;", "·"),
    ("&times;", "×"),
]

# Marks of a paper's parts in its page, what titles end in, label of an image, shortest parts in bytes.
PAGE_MARK, DOCUMENT_MARK, ARTICLE_MARK = 'class="ltx_page_content"', 'class="ltx_document"', "<article"
FOOTER = r"(?s)<footer.*\z"
TITLE_ENDINGS = (" | arXiv", " – ar5iv")
ABSTRACT_BLOCK = r'(?is)<div[^>]*class="[^"]*ltx_abstract[^"]*"[^>]*>(.*?)</div>'
ABSTRACT_HEADING = r"\A(?:Abstract)*\.*"
AUTHOR_SPAN = r'(?is)<span[^>]*class="[^"]*ltx_personname[^"]*"[^>]*>(.*?)</span>'
IMAGE_LABEL, IMAGE_UNNAMED = ("\n[IMAGE: ", "]\n"), "figure"
LONGER_THAN_ABSTRACT, SHORTEST_NAME, MOST_AUTHORS = 40, 2, 40
YEAR_MARKS = (r'when="(\d{4})', r"when='(\d{4})")
YEAR_IN_TEXT = r"(?<!\d)((?:19|20)\d{2})(?!\d)"


def strip(c: Column) -> Column:
    """Trim any Unicode white space (F.trim removes the blank only)."""
    return F.btrim(c, F.lit(_SPACES))


def squeeze(c: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{_SPACE}]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_title(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), rf"[^\p{{IsAlphabetic}}\p{{N}}{_SPACE}]", "")
    return squeeze(kept)


def parse_arxiv_id(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, ARXIV_PATTERN, 1))


def parse_doi(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, DOI_PATTERN, 1))


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    """Text outside tags; an unclosed tag swallows the rest, a stray '>' vanishes."""
    return F.regexp_replace(c, r"<[^>]*(?:>|\z)|>", "")


def strip_markup_joined(c: Column) -> Column:
    """Tags removed without a gap, white space squeezed."""
    return squeeze(strip_tags(c))


def strip_markup_spaced(c: Column) -> Column:
    """Every closing '>' leaves a blank, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"<[^>]*\z", ""), r"<[^>]*>|>", " "))


def _attribute(attrs: Column, name: str) -> Column:
    """Attribute value: the double-quoted form if there is one, else the single-quoted form."""
    double, single = rf'(?i){name}\s*=\s*"([^"]*)"', rf"(?i){name}\s*=\s*'([^']*)'"
    return F.when(F.regexp_like(attrs, F.lit(double)), F.regexp_extract(attrs, double, 1)).otherwise(
        F.regexp_extract(attrs, single, 1)
    )


def _image_label(attrs: Column) -> Column:
    alt, src = _attribute(attrs, "alt"), _attribute(attrs, "src")
    label = (
        F.when(alt != "", alt)
        .when(src != "", F.substring_index(src, "/", -1))
        .otherwise(F.lit(IMAGE_UNNAMED))
    )
    return F.concat(F.lit(IMAGE_LABEL[0]), label, F.lit(IMAGE_LABEL[1]))


def _images_to_labels(c: Column) -> Column:
    labels = F.transform(F.regexp_extract_all(c, F.lit(r"(?is)<img\b([^>]*)>"), F.lit(1)), _image_label)
    pieces = F.split(c, r"(?is)<img\b[^>]*>")
    woven = F.zip_with(pieces, labels, lambda piece, label: F.concat(piece, F.coalesce(label, F.lit(""))))
    return F.when(F.size(labels) > 0, F.array_join(woven, "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Readable text of an HTML page; images become a label line, blocks end a line."""
    for tag in SILENT_TAGS:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?is)<!--.*?-->", " ")
    c = _images_to_labels(c)
    c = F.regexp_replace(c, rf"(?i)</(?:{'|'.join(BLOCK_TAGS)})\s*>|<br\s*/?>", "\n")
    c = decode_entities(F.regexp_replace(c, r"<[^>]+>", " "))
    c = F.replace(c, F.lit("\r"), F.lit(""))
    c = F.regexp_replace(c, r"[\t\x0b\f\x85\p{Z}]+", " ")
    c = F.regexp_replace(c, r"\n *\n[ \n]*", "\n\n")
    return strip(F.regexp_replace(c, r"\n +", "\n"))


def main_content(html: Column) -> Column:
    """Part of the page that holds the paper: marked content block, document block, article, all."""
    after = lambda mark: F.substring(html, F.locate(mark, html), F.length(html))
    has = lambda mark: F.contains(html, F.lit(mark))
    return (
        F.when(has(PAGE_MARK), F.regexp_replace(after(PAGE_MARK), FOOTER, ""))
        .when(has(DOCUMENT_MARK), after(DOCUMENT_MARK))
        .when(has(ARTICLE_MARK), after(ARTICLE_MARK))
        .otherwise(html)
    )


def html_title(html: Column) -> Column:
    raw = decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    for suffix in TITLE_ENDINGS:
        raw = F.replace(raw, F.lit(suffix), F.lit(""))
    return blank_to_null(strip(raw))


def html_abstract(body: Column) -> Column:
    block = F.regexp_extract(body, ABSTRACT_BLOCK, 1)
    cleaned = strip(F.regexp_replace(html_to_text(block), ABSTRACT_HEADING, ""))
    return F.when(F.octet_length(cleaned) > LONGER_THAN_ABSTRACT, cleaned)


def html_authors(body: Column, limit: int | None = MOST_AUTHORS) -> Column:
    """Names on the page, each once; the first `limit` of them, or all."""
    names = F.transform(F.regexp_extract_all(body, F.lit(AUTHOR_SPAN), F.lit(1)), lambda s: squeeze(html_to_text(s)))
    found = F.array_distinct(F.filter(names, lambda n: F.octet_length(n) >= SHORTEST_NAME))
    return found if limit is None else F.slice(found, 1, limit)


def _non_blank(items: Column) -> Column:
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), strip), lambda s: s != "")


def aspect_text(summary: Column, bullets: Column) -> Column:
    """Embedding input of one aspect: summary line, then the bullets on one line."""
    joined = F.array_join(_non_blank(bullets), "; ")
    return F.concat_ws("\n", blank_to_null(strip(summary)), blank_to_null(joined))


def method_line(method: Column) -> Column:
    return F.when(method["description"] == "", method["name"]).otherwise(
        F.concat(method["name"], F.lit(": "), method["description"])
    )


def title_abstract_methods_text(title: Column, abstract: Column, methods: Column) -> Column:
    """Embedding input of a paper without aspects. `methods` is array<struct<name,description>>."""
    return F.concat(
        F.lit("title: "), title,
        F.lit("\nabstract: "), F.substring(abstract, 1, 4000),
        F.lit("\nmethods: "), F.array_join(F.transform(methods, method_line), "; "),
    )


def _once(value: Column, use) -> Column:
    """use(value) with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip_code_fence(c: Column) -> Column:
    """JSON text of a model reply, without the Markdown fence around it."""
    opening, closing = r"\A```(?:json)?\n?", r"```\z"
    return _once(
        strip(c),
        lambda t: F.when(
            F.startswith(t, F.lit("```")), strip(F.regexp_replace(F.regexp_replace(t, opening, ""), closing, ""))
        ).otherwise(t),
    )


def is_json(c: Column) -> Column:
    """True for exactly one JSON value. The list around it exposes text after the value."""
    listed = F.concat(F.lit("["), c, F.lit(",0]"))
    strict = F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 2)
    return F.coalesce(strict, F.lit(False))


def lenient_json(c: Column) -> Column:
    """JSON text of a model reply, fenced or not; null when it is not valid JSON."""
    return _once(strip_code_fence(c), lambda t: F.when(is_json(t), t))


def display_title(version_title: Column, title_norm: Column) -> Column:
    return F.coalesce(version_title, title_norm)


def parse_cursor(c: Column) -> Column:
    """RFC 3339 text with offset -> timestamp; anything else is null."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"
    iso = F.regexp_replace(F.regexp_replace(c, "[t ]", "T"), "z$", "Z")
    return F.when(F.regexp_like(c, F.lit(shape)), F.try_to_timestamp(iso))


def publication_year(block: Column) -> Column:
    """Year of a bibliography entry: when="YYYY…", else the first 4-digit number 1900-2099 in the text."""
    dated = F.coalesce(
        *[blank_to_null(F.regexp_extract(block, mark, 1)) for mark in YEAR_MARKS],
    )
    loose = F.regexp_extract(strip_tags(block), YEAR_IN_TEXT, 1)
    return F.coalesce(dated, blank_to_null(loose)).cast("int")
