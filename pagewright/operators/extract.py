"""Pages of HTML as related tables: documents, headings, sections, passages and links.

The one stage in Python is tokenising HTML. It makes one nested row a page; the tables are projections of it.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intake import PAGE_BYTES

KINDS = {"p": "paragraph", "li": "listitem", "td": "cell", "th": "cell", "dd": "definition", "dt": "definition", "blockquote": "quote", "pre": "pre", "figcaption": "caption"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ROLES = frozenset(("navigation", "contentinfo", "banner", "complementary"))
#: The entities that are decoded, by name.
ENTITIES = dict(
    amp="&", lt="<", gt=">", quot='"', apos="'", nbsp=" ", hellip="…", mdash="—", ndash="–", lsquo="‘", rsquo="’", ldquo="“", rdquo="”", copy="©", reg="®", trade="™",
    eacute="é", egrave="è", agrave="à", ccedil="ç", uuml="ü", ouml="ö", auml="ä", szlig="ß", ntilde="ñ", deg="°", euro="€", pound="£", yen="¥", cent="¢", sect="§", para="¶", middot="·",
    bull="•", dagger="†", permil="‰", prime="′", laquo="«", raquo="»", times="×", divide="÷", plusmn="±", frac12="½", frac14="¼", sup2="²", sup3="³",
)
#: The same text under two headings is boilerplate; so many characters of it are compared.
PREFIX = 160

FIELDS = (
    "title string, meta_description string, lang string, canonical string, meta_robots string, json_ld array<string>, script_chars long, text_chars long, has_noscript boolean, "
    "headings array<struct<level:int,text:string,section_ord:int>>, passages array<struct<section_ord:int,idx:int,kind:string,text:string,boilerplate:boolean>>, links array<struct<href:string,text:string,rel:string>>"
)

_SPACE = re.compile(r"\s+")
_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});")


def decoded(text: str) -> str:
    """Entities of the table and numeric ones as characters; others stay."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] != "#":
            return ENTITIES.get(name) or ENTITIES.get(name.lower()) or m[0]
        try:
            code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        except ValueError:
            return m[0]
        return m[0] if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)

    return _ENTITY.sub(one, text) if "&" in text else text


def normal(chunks: list[str]) -> str:
    """White space collapsed and trimmed, then entities decoded, so that a decoded no-break space stays."""
    return decoded(_SPACE.sub(" ", "".join(chunks)).strip())


class Reader(HTMLParser):
    """Reads one page. An end tag closes all that is open above its start tag; end tags without one are ignored."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=False)
        self.base = base
        self.out: dict = dict(title=None, meta_description=None, lang=None, canonical=None, meta_robots=None, json_ld=[], script_chars=0, text_chars=0, has_noscript=False, headings=[], passages=[], links=[])
        self.open: list[tuple[str, str | None]] = []
        self.off = 0  # depth of chrome and script
        self.target: str | None = None  # what text goes to: title, json, heading or passage
        self.chunks: list[str] = []
        self.kind, self.level, self.sections = "paragraph", 0, 1
        self.link: int | None = None
        self.link_chunks: list[str] = []
        self.code = 0

    def passage(self) -> None:
        text, self.chunks = normal(self.chunks), []
        if len(text) >= 2:
            self.out["passages"].append((self.sections - 1, self.kind, text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {}
        for k, v in attrs:
            at.setdefault(k, v or "")
        end = None
        chrome = tag in ("nav", "footer", "aside") or (tag == "header" and bool(self.open) and self.open[-1][0] == "body") or at.get("role") in ROLES
        if chrome:
            self.off += 1
            end = "off"
        if tag in ("script", "style", "template"):
            if at.get("type", "").lower() == "application/ld+json":
                self.target, self.chunks, end = "json", [], "json"
            else:
                self.off += 1
                self.code += 1
                end = "code"
        elif tag == "noscript":
            self.out["has_noscript"] = True
        elif tag == "html":
            self.out["lang"] = at.get("lang")
        elif tag == "title" and self.out["title"] is None:
            self.target, self.chunks, end = "title", [], "title"
        elif tag == "meta":
            name = at.get("name", "").lower()
            if name in ("description", "robots"):
                self.out["meta_description" if name == "description" else "meta_robots"] = at.get("content")
        elif tag == "link" and at.get("rel") == "canonical":
            self.out["canonical"] = at.get("href")
        elif not self.off and re.fullmatch("h[1-6]", tag):
            if self.target == "passage":
                self.passage()
            self.target, self.chunks, self.level, end = "heading", [], int(tag[1]), "heading"
        elif not self.off and tag in KINDS:
            if self.target == "passage":
                self.passage()
            self.target, self.chunks, self.kind, end = "passage", [], KINDS[tag], "passage"
        elif not self.off and tag == "a" and at.get("href"):
            self.out["links"].append([resolved(at["href"], self.base), "", at.get("rel")])
            self.link, self.link_chunks, end = len(self.out["links"]) - 1, [], f"link{len(self.out['links']) - 1}"
        if tag not in VOID:
            self.open.append((tag, end))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while True:
                t, end = self.open.pop()
                if end:
                    self.ended(end)
                if t == tag:
                    return

    def ended(self, end: str) -> None:
        if end in ("off", "code"):
            self.off = max(0, self.off - 1)
            self.code -= end == "code"
        elif end == "json":
            self.out["json_ld"].append("".join(self.chunks))
            self.target, self.chunks = None, []
        elif end == "title":
            self.out["title"] = normal(self.chunks) or None
            self.target, self.chunks = None, []
        elif end == "heading":
            self.out["headings"].append((self.level, normal(self.chunks), self.sections))
            self.sections += 1
            self.target, self.chunks = None, []
        elif end == "passage":
            if self.target == "passage":
                self.passage()
            self.target = None
        else:
            self.out["links"][int(end[4:])][1] = normal(self.link_chunks)
            self.link, self.link_chunks = None, []

    def handle_data(self, data: str) -> None:
        if self.code:
            self.out["script_chars"] += len(data)
        elif self.target in ("json", "title"):
            self.chunks.append(data)
        elif not self.off and self.target in ("heading", "passage"):
            self.chunks.append(data)
            self.out["text_chars"] += len(data)
        if self.link is not None:
            self.link_chunks.append(data)

    def closing(self, n: int) -> str:
        """The semicolon, if there is one, n characters behind the place that is being read."""
        line, offset = self.getpos()
        if self.starts is None:
            self.starts = [0, *(m.end() for m in re.finditer("\n", self.source))]
        at = self.starts[line - 1] + offset + n
        return ";" if self.source[at : at + 1] == ";" else ""

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name}{self.closing(len(name) + 1)}")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name}{self.closing(len(name) + 2)}")

    def feed(self, data: str) -> None:
        self.source, self.starts = data, None
        super().feed(data)


def resolved(href: str, base: str) -> str:
    """The absolute address; as it stands where it can't be resolved."""
    try:
        return urljoin(base, href) if urlsplit(base).scheme else href
    except ValueError:
        return href


def read_page(html: str, url: str, most: int = PAGE_BYTES) -> dict:
    """One page's nested row; bytes beyond `most` are cut off."""
    data = html.encode()
    reader = Reader(url)
    reader.feed(html if len(data) <= most else data[:most].decode(errors="replace"))
    reader.close()
    if reader.target == "passage":
        reader.passage()
    spread, count, rows = {}, {}, reader.out["passages"]
    for section, _, text in rows:
        spread.setdefault(text[:PREFIX], set()).add(section)
    for k, (section, kind, text) in enumerate(rows):
        rows[k] = (section, count.get(section, 0), kind, text, len(spread[text[:PREFIX]]) >= 2)
        count[section] = count.get(section, 0) + 1
    return reader.out


def extract(pages: DataFrame, most: int = PAGE_BYTES) -> DataFrame:
    """page_id, url and FIELDS for each page; a null html has no tables."""
    env = pages.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    schema = f"page_id long, url string, {FIELDS}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [read_page(h or "", u or "", most) for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True)]
                columns = [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string())]
                for field in list(arrow)[2:]:
                    values = [r[field.name] for r in rows]
                    if field.name in ("headings", "passages", "links"):
                        names = [f.name for f in field.type.value_type]
                        values = [[dict(zip(names, v, strict=True)) for v in vs] for vs in values]
                    columns.append(pa.array(values, field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def docs(extracted: DataFrame) -> DataFrame:
    js = (F.col("text_chars") < 500) & (F.col("script_chars") > 3 * F.col("text_chars"))
    return extracted.select("page_id", "url", "title", "meta_description", "lang", "canonical", "meta_robots", "json_ld", "script_chars", "text_chars", "has_noscript", js.alias("js_likely"))


def headings(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", F.posexplode("headings").alias("ord", "h")).select("page_id", "ord", "h.level", "h.text", "h.section_ord")


def sections(extracted: DataFrame) -> DataFrame:
    """Sections with a heading or passages: page_id, section_ord, heading, level. Section 0 is what comes before the first."""
    headed = headings(extracted).select("page_id", "section_ord", F.when(F.col("text") != "", F.col("text")).alias("heading"), "level")
    first = extracted.where(F.exists("passages", lambda p: p["section_ord"] == 0)).select("page_id", F.lit(0).alias("section_ord"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"))
    filled = extracted.select("page_id", F.explode(F.array_distinct(F.transform("passages", lambda p: p["section_ord"]))).alias("section_ord"), F.lit(True).alias("some"))
    return headed.unionByName(first).join(filled, ["page_id", "section_ord"], "left").where(F.col("heading").isNotNull() | F.col("some")).drop("some")


def passages(extracted: DataFrame) -> DataFrame:
    """page_id, passage_ord, section_ord, idx (in the section), kind, text, boilerplate (its beginning is also in another
    section of the page)."""
    return extracted.select("page_id", F.posexplode("passages").alias("passage_ord", "p")).select("page_id", "passage_ord", "p.*")


def boilerplate(passage_rows: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """The same flag for passages from any table (page_id, section_ord, text), by a window."""
    own = Window.partitionBy("page_id", F.left("text", F.lit(prefix)))
    return passage_rows.withColumn("boilerplate", F.size(F.collect_set("section_ord").over(own)) >= 2)


def links(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", F.posexplode("links").alias("link_ord", "l")).select("page_id", "link_ord", "l.href", "l.text", "l.rel")
